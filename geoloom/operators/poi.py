"""Points of interest: tile pyramid, dictionaries, search, private-leisure filter, packed positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, tags


def with_tile(points: DataFrame, zoom: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds tx, ty at a zoom level."""
    return points.withColumn("tx", F.floor(geo.tile_x(F.col(lon), zoom)).cast("long")).withColumn("ty", F.floor(geo.tile_y(F.col(lat), zoom)).cast("long"))


def tile_pyramid(pois: DataFrame, low: int = 6, high: int = 16) -> DataFrame:
    """D5. (zoom, tx, ty, n, kinds): POIs and their distinct category/subtype by tile of every zoom.

    The deepest level is counted by tile and kind first; the levels above are rolled up from these
    counts, so what is repeated for each level are counts, not POIs, and they are added up before
    they are dealt out. A tile's list is only made of its distinct kinds, which the dictionary of
    categories bounds.
    """
    kind = F.concat_ws("/", "category", "subtype")
    base = with_tile(pois, high).groupBy("tx", "ty", kind.alias("kind")).agg(F.count("*").alias("n"))
    levels = base.withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high))))
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(high) - F.col("zoom"))
    by_kind = levels.groupBy("zoom", up("tx").alias("tx"), up("ty").alias("ty"), "kind").agg(F.sum("n").alias("n"))
    return by_kind.groupBy("zoom", "tx", "ty").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("kind")).alias("kinds"))


def pyramid_root(pyramid: DataFrame, most: int = 8, low: int = 6) -> DataFrame:
    """D6. The deepest zoom with at most `most` tiles, `low` if none."""
    per = pyramid.groupBy("zoom").agg(F.count("*").alias("tiles"))
    return per.agg(F.coalesce(F.max(F.when(F.col("tiles") <= most, F.col("zoom"))), F.lit(low)).alias("zoom"))


def category_dictionary(pois: DataFrame) -> DataFrame:
    """D7. (category, subtype, category_id, subtype_id, packed): dense ids in sorted order;
    subtypes with several values are split on , and ;."""
    kinds = pois.select("category", F.explode(F.split("subtype", "[,;]")).alias("subtype")).distinct()
    by_category = kinds.select("category").distinct()
    ids = by_category.withColumn("category_id", F.row_number().over(Window.orderBy("category")) - 1)
    numbered = kinds.withColumn("subtype_id", F.row_number().over(Window.partitionBy("category").orderBy("subtype")) - 1)
    return numbered.join(ids, "category").withColumn(
        "packed", F.shiftleft(F.col("subtype_id"), 7).bitwiseOR(F.col("category_id"))
    )


def attribute_dictionary(rules: DataFrame) -> DataFrame:
    """D8. (tag, value, kind text or additional): a text rule has an id of its own; additional
    rules share the tag's id and have sub-ids. packed is (v << 6) | (c << 1), or
    (v << 16) | (c << 1) | 1 when c is over 31."""
    ids = rules.select("tag", "kind").distinct().withColumn("c", F.row_number().over(Window.orderBy("tag", "kind")) - 1)
    sub = Window.partitionBy("tag", "kind").orderBy("value")
    both = rules.join(ids, ["tag", "kind"]).withColumn("v", F.when(F.col("kind") == "text", 0).otherwise(F.row_number().over(sub) - 1))
    c, v = F.col("c"), F.col("v")
    small = F.shiftleft(v, 6).bitwiseOR(F.shiftleft(c, 1))
    return both.withColumn("packed", F.when(c > 31, F.shiftleft(v, 16).bitwiseOR(F.shiftleft(c, 1)).bitwiseOR(F.lit(1))).otherwise(small))


def drop_private_leisure(pois: DataFrame, object_col: str = "obj", most: int = 3) -> DataFrame:
    """B7. Drops leisure POIs of private objects or of objects with more than `most` POIs, and
    POIs without a location."""
    n = F.count("*").over(Window.partitionBy(object_col))
    marked = pois.withColumn("__n", n)
    private = (F.col("category") == "leisure") & ((F.coalesce(F.col("access"), F.lit("")) == "private") | (F.col("__n") > most))
    return marked.where(~private & F.col("lat").isNotNull() & F.col("lon").isNotNull()).drop("__n")


def search(
    pois: DataFrame,
    box: tuple[float, float, float, float],
    categories: list[tuple[str, str | None]],
    one_per_tile_zoom: int | None = None,
) -> DataFrame:
    """B10. POIs of a box (min lat, min lon, max lat, max lon) with a category, any subtype if that
    is None; on demand one a tile, the one with the smallest id."""
    inside = pois.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    wanted: Column = F.lit(False)
    for category, subtype in categories:
        one = F.col("category") == category
        wanted = wanted | (one if subtype is None else one & (F.col("subtype") == subtype))
    found = inside.where(wanted)
    if one_per_tile_zoom is None:
        return found
    tiled = with_tile(found, one_per_tile_zoom)
    best = tiled.groupBy("tx", "ty").agg(F.min_by(F.struct(*found.columns), "id").alias("one"))
    return best.select("one.*")


def tile_offsets(points: DataFrame, zoom: int) -> DataFrame:
    """A17. Position inside the tile at 24-bit precision: (id, tx, ty, dx, dy)."""
    placed = points.select("id", geo.x31(F.col("lon")).alias("x"), geo.y31(F.col("lat")).alias("y"))
    tx, ty = geo.tile_of_x31(F.col("x"), zoom), geo.tile_of_x31(F.col("y"), zoom)
    inside = lambda v, t: F.shiftright(v, 7) - F.shiftleft(t, 24 - zoom)
    return placed.select("id", tx.alias("tx"), ty.alias("ty"), inside(F.col("x"), tx).alias("dx"), inside(F.col("y"), ty).alias("dy"))


def name_index(named: DataFrame, zoom: int = 16) -> DataFrame:
    """K1. (prefix, tile): the tiles in which a name prefix occurs, a row each, so that a prefix that
    stands everywhere isn't one row."""
    tiled = with_tile(named.where("name IS NOT NULL"), zoom)
    spread = tiled.select(F.explode(tags.name_prefixes(F.col("name"))).alias("prefix"), geo.tile_key(F.col("tx"), F.col("ty"), zoom).alias("tile"))
    return spread.distinct()
