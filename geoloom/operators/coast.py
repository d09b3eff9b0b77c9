"""K8's ground: areas of land and water from the coast lines of a box, or a background."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.geometry import polygonize_coast
from geoloom.session import cut_lineage

COASTLINE = ("natural", "coastline")


def coast_areas(objects: DataFrame, boxes: DataFrame) -> DataFrame:
    """Map objects that lie under the others: one for each ring of land or water that the coast lines
    make in a box (I13), and a background for every box that gets none.

    objects: tile, id, types, pts (structs x, y; 31-bit units, y downwards), those of type
    natural=coastline being coast lines; boxes: tile, min_x, min_y, max_x, max_y. Returned: tile, id
    (negative, by ring), types, additional, names, area, pts. Water is an area natural=coastline, land
    natural=land, a background natural=coastline_broken, which is no area; all with layer=lowest. A box
    whose coast lines are broken, or don't reach it, has a background too.
    """
    coast = objects.where(F.exists("types", lambda t: (t["tag"] == COASTLINE[0]) & (t["value"] == COASTLINE[1])))
    lines = coast.select(F.col("tile").cast("string").alias("tile"), F.col("id").alias("line_id"), F.posexplode("pts").alias("ord", "p"))
    lines = lines.select("tile", "line_id", "ord", F.col("p.x").cast("double").alias("x"), (-F.col("p.y")).cast("double").alias("y"))
    turned = boxes.select(F.col("tile").cast("string").alias("tile"), *(v.cast("double").alias(n) for n, v in (("min_x", F.col("min_x")), ("min_y", -F.col("max_y")), ("max_x", F.col("max_x")), ("max_y", -F.col("min_y")))))
    rings = cut_lineage(polygonize_coast(lines, turned))
    pts = F.arrays_zip(F.transform("xs", lambda v: F.round(v).cast("long")).alias("x"), F.transform("ys", lambda v: F.round(-v).cast("long")).alias("y"))
    made = rings.select("tile", F.when(F.col("kind") == "water", "coastline").otherwise("land").alias("value"), F.lit(True).alias("area"), pts.alias("pts"))
    corner = lambda x, y: F.struct(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    frame = F.array(*(corner(*c) for c in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y"))))
    bare = boxes.withColumn("tile", F.col("tile").cast("string")).join(rings.select("tile").distinct(), "tile", "left_anti")
    bare = bare.select("tile", F.lit("coastline_broken").alias("value"), F.lit(False).alias("area"), frame.alias("pts"))
    both = made.unionByName(bare)
    return both.select(
        "tile", (-F.pmod(F.xxhash64("tile", "value", "pts"), F.lit(2**62)) - 1).alias("id"), F.array(F.struct(F.lit(COASTLINE[0]).alias("tag"), F.col("value"))).alias("types"),
        F.array(F.lit("layer=lowest")).alias("additional"), F.create_map().cast("map<string,string>").alias("names"), "area", "pts",
    )
