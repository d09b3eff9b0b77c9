"""Shape jobs: select, clip, erase, profile, append. Shapes and attributes meet on record number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.numparse import scale_and_shift

Box = tuple[float, float, float, float]


def with_attributes(shapes: DataFrame, attributes: DataFrame) -> DataFrame:
    """C27."""
    return shapes.join(attributes, "rec_no")


def select_records(df: DataFrame, column: str, values: Sequence[int], keep: bool = True) -> DataFrame:
    """B17. Records whose field is (not) one of the values; null is none of them."""
    hit = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.where(hit if keep else ~hit)


def overlaps(box: Box) -> Column:
    """B19. The shape's box and the box have a point in common."""
    return (F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1])


def contained(box: Box) -> Column:
    """B19. The shape's box is inside the box."""
    return (F.col("minx") >= box[0]) & (F.col("maxx") <= box[2]) & (F.col("miny") >= box[1]) & (F.col("maxy") <= box[3])


def _vertex_in(box: Box, any_axis: bool) -> Column:
    in_x = lambda x: (x >= box[0]) & (x <= box[2])
    in_y = lambda y: (y >= box[1]) & (y <= box[3])
    both = F.zip_with("x", "y", lambda x, y: (in_x(x) | in_y(y)) if any_axis else (in_x(x) & in_y(y)))
    return F.exists(both, lambda b: b)


def clip(shapes: DataFrame, box: Box, mode: str = "cut", erase: bool = False) -> DataFrame:
    """B18. Shapes clipped to (or erased from) a box.

    inside: whole shapes in the box. touch: shapes that cross an axis range of the box, or with a
    vertex in one. cut: vertices outside go (of erasing: inside), and shapes with two left or a
    point stay. Whole shapes inside or outside are told by their boxes first.
    """
    whole = contained(box)
    if mode == "inside":
        return shapes.where(~whole if erase else whole)
    if mode == "touch":
        spans = ((F.col("minx") <= box[0]) & (F.col("maxx") >= box[2])) | ((F.col("miny") <= box[1]) & (F.col("maxy") >= box[3]))
        hit = overlaps(box) & (whole | spans | _vertex_in(box, True))
        return shapes.where(~hit if erase else hit)
    if mode != "cut":
        raise ValueError(f"no clip mode {mode}")
    inside = lambda x, y: (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
    pairs = F.filter(F.arrays_zip("x", "y"), lambda p: ~inside(p["x"], p["y"]) if erase else inside(p["x"], p["y"]))
    near = shapes if erase else shapes.where(overlaps(box))
    cut = near.withColumn("__p", pairs).withColumn("__n", F.size("x")).where((F.size("__p") >= 2) | ((F.col("__n") == 1) & (F.size("__p") == 1)))
    return cut.withColumn("x", F.col("__p.x")).withColumn("y", F.col("__p.y")).drop("__p", "__n")


def moved(shapes: DataFrame, factor: float, dx: float, dy: float) -> DataFrame:
    """H23. Coordinates scaled, then shifted, with new bounds."""
    out = shapes.withColumn("x", scale_and_shift(F.col("x"), factor, dx)).withColumn("y", scale_and_shift(F.col("y"), factor, dy))
    return with_bounds(out)


def with_bounds(shapes: DataFrame) -> DataFrame:
    """D2. The smallest and largest x and y, and z and m where shapes have them, from the vertices."""
    for c in [c for c in ("x", "y", "z", "m") if c in shapes.columns]:
        shapes = shapes.withColumn(f"min{c}", F.array_min(c)).withColumn(f"max{c}", F.array_max(c))
    return shapes


def append_by_name(target: DataFrame, more: DataFrame) -> DataFrame:
    """G4. Records of `more` appended: fields match by name (any case) and type; others are added only
    while the target has no field or no record, else left out."""
    known = {f.name.lower(): f for f in target.schema.fields}
    kept, extra = [], []
    for f in more.schema.fields:
        mine = known.get(f.name.lower())
        if mine is not None and mine.dataType == f.dataType:
            kept.append(F.col(f.name).alias(mine.name))
        elif mine is None:
            extra.append(F.col(f.name))
    if extra and target.isEmpty():
        kept += extra
    return target.unionByName(more.select(*kept), allowMissingColumns=True)


def profile(df: DataFrame) -> DataFrame:
    """D17. (field, low, high, mean, n): smallest and largest value of each field and the mean of
    numbers; texts in any case, blanks ignored."""
    out: list[Column] = []
    names = [f for f in df.schema.fields if f.dataType.typeName() in ("string", "integer", "long", "double", "float", "boolean")]
    for f in names:
        c = F.col(f.name)
        text = f.dataType.typeName() == "string"
        value = F.nullif(F.trim(F.lower(c)), F.lit("")) if text else c
        numeric = f.dataType.typeName() in ("integer", "long", "double", "float")
        out.append(
            F.struct(
                F.lit(f.name).alias("field"), F.min(value).cast("string").alias("low"), F.max(value).cast("string").alias("high"),
                (F.avg(c) if numeric else F.lit(None)).cast("double").alias("mean"), F.count(value).alias("n"),
            )
        )
    return df.agg(F.array(*out).alias("all")).select(F.inline("all"))
