"""Map objects of all levels: full geometry at the deepest one, simplified and merged ones above."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import geometry, mapobj, multipolygon, rules
from geoloom.session import cut_lineage, in_parts, written

#: fixed values: pixel boxes up to which merged lines are too small to draw, closed and open ones
SMALL_CLOSED, SMALL_OPEN = (3, 4), (2, 8)
ENTITY_ROWS = 50_000  # entities that a task encodes
OUT = ("level", "id", "form", "types", "add_types", "name", "lats", "lons", "holes")


def _picked(lines: DataFrame) -> DataFrame:
    """The points that `kept` names."""
    pick = lambda c: F.transform("kept", lambda i: F.get(F.col(c), i))
    return lines.withColumns({c: pick(c) for c in ("lats", "lons")})


def generalise(
    entities: DataFrame, shapes: DataFrame, nodes: DataFrame, rule_table: DataFrame, zooms: str = "11;12;13-14;15-", smoothness: int = 2, coastline: int | None = None,
    polygons: DataFrame | None = None,
) -> DataFrame:
    """I4. (level, id, form, types, add_types, name, lats, lons, holes, min_lat, max_lat, min_lon, max_lon).

    entities: id, tags, is_node; shapes: id, node_ids, lats, lons; nodes: id, lat, lon. Objects appear
    at every level where they have a main type (H1). Level 0 has them in full (form full). At the
    others points stay (point), closed ways are simplified (cycle) and go where they are too small
    (I2), and open ways of equal types are merged (C24; line): small ones go unless they are of type
    `coastline`, the others are simplified. A merged line has the smallest of its ids. Objects
    without points go. polygons (of I6: id, rel_id, lats, lons, holes) stand at the levels where the
    entity rel_id has a type, under their own ids (polygon): in full at level 0, simplified with their
    holes at the others. holes is empty for all other forms.
    """
    levels = geo.parse_zooms(zooms)
    named = in_parts(entities.select("id", "tags", "is_node", F.col("tags")["name"].alias("name")), ENTITY_ROWS, "id")
    typed = rules.encode_levels(named, rule_table, {level: high for level, _, high in levels}, "name").select("level", "id", "types", "add_types", "name")
    if polygons is not None:
        typed = cut_lineage(typed)
    # a shape is written once, beside all its levels
    seen = typed.groupBy("id").agg(F.collect_list(F.struct("level", "types", "add_types", "name")).alias("seen"))
    objects = written(seen.join(shapes.where(F.size("lats") > 0).select("id", "node_ids", "lats", "lons"), "id"))
    objects = objects.select("id", F.inline("seen"), "node_ids", "lats", "lons").withColumn("holes", F.array().cast(f"array<{multipolygon.RING}>"))
    closed = (F.size("node_ids") > 1) & (F.element_at("node_ids", 1) == F.element_at("node_ids", -1))
    low = objects.where("level > 0")
    full = objects.where("level = 0").withColumn("form", F.lit("full")).select(*OUT)
    points = low.where(F.size("node_ids") == 1).withColumn("form", F.lit("point")).select(*OUT)

    kinds = F.concat(F.col("types").cast("array<int>"), F.array(F.lit(-1)), F.col("add_types").cast("array<int>"))
    chains = geometry.merge_lines(low.where((F.size("node_ids") > 1) & ~closed).select("id", "level", kinds.alias("types"), "name", "node_ids"))
    chains = chains.select("level", F.array_min("line_ids").alias("id"), "types", "name", closed.alias("round"), F.posexplode("node_ids").alias("ord", "node"))
    placed = chains.join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node").groupBy("level", "id", "types", "name", "round")
    placed = placed.agg(F.array_sort(F.collect_list(F.struct("ord", "lat", "lon"))).alias("pts"))
    cut = F.array_position("types", F.lit(-1)).cast("int")
    placed = placed.withColumns({"add_types": F.slice("types", cut + 1, F.size("types") - cut), "types": F.slice("types", F.lit(1), cut - 1)})
    placed = written(placed.select("level", "id", "types", "add_types", "name", "round", F.col("pts.lat").alias("lats"), F.col("pts.lon").alias("lons")))
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    placed = placed.withColumns({"pts": F.zip_with("lats", "lons", point), "holes": F.array().cast(f"array<{multipolygon.RING}>")})

    parts = [full, points]
    if polygons is not None:
        areas = typed.withColumnRenamed("id", "rel_id").join(polygons.select("rel_id", "id", "lats", "lons", "holes"), "rel_id").withColumn("form", F.lit("polygon")).select(*OUT)
        areas = cut_lineage(areas)
        parts.append(areas.where("level = 0"))
    for level, _, high in levels:
        if level == 0:
            continue
        if polygons is not None:
            parts.append(multipolygon.simplify_polygons(areas.where(F.col("level") == level), high - 1, smoothness))
        keep = tuple(c for c in OUT if c not in ("id", "form"))
        rings = geometry.simplify_cycles(low.where(closed & (F.col("level") == level)), high - 1, smoothness, keep)
        parts.append(_picked(rings).withColumn("form", F.lit("cycle")).select(*OUT))
        lines = placed.where(F.col("level") == level).where(~_too_small(high + min(smoothness // 2, 3), coastline))
        lines = geometry.simplify_lines(lines, high - 1 + 8 + smoothness, 3.0, keep=keep).where(F.size("kept") > 0)
        parts.append(_picked(lines).withColumn("form", F.lit("line")).select(*OUT))
    box = {f"{n}_{c}": f(f"{c}s") for c in ("lat", "lon") for n, f in (("min", F.array_min), ("max", F.array_max))}
    return reduce(DataFrame.unionByName, parts).withColumns(box)


def _too_small(zoom: int, coastline: int | None) -> Column:
    open_ = mapobj.is_small_area(F.col("pts"), zoom, *SMALL_OPEN)
    if coastline is not None:
        open_ = open_ & ~F.array_contains("types", coastline)
    return F.when(F.col("round"), mapobj.is_small_area(F.col("pts"), zoom, *SMALL_CLOSED)).otherwise(open_)
