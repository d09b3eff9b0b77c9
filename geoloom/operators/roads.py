"""Roads: selection, restrictions, shared vertices, adjacency, sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.session import bounded

#: fixed values: codes of turn restrictions
RESTRICTIONS = {
    "no_right_turn": 1, "no_left_turn": 2, "no_u_turn": 3, "no_straight_on": 4, "only_right_turn": 5, "only_left_turn": 6, "only_straight_on": 7,
}
#: fixed values: classes of the base network
BASE_CLASSES = ("trunk", "motorway", "primary", "secondary", "tertiary", "ferry")


def select_roads(ways: DataFrame, accepted: DataFrame, class_col: str = "highway") -> DataFrame:
    """B22. Ways with an accepted class, and whether they belong to the base network: a base class
    and two vertices at least. accepted: tag, value (null value: the tag with any value)."""
    values = accepted.where(F.col("tag") == class_col)
    exact = values.where("value IS NOT NULL").select(F.col("value").alias(class_col)).distinct()
    if values.where("value IS NULL").isEmpty():
        kept = ways.join(bounded(exact), class_col, "left_semi")
    else:
        kept = ways.where(F.col(class_col).isNotNull())
    kept = kept.select(*ways.columns)
    base = F.col(class_col).rlike("^(" + "|".join(BASE_CLASSES) + ")") & (F.col("n_vertices") >= 2)
    return kept.withColumn("base", F.coalesce(base, F.lit(False)))


def restriction_code(kind: Column) -> Column:
    """1 to 7, null for other kinds."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in RESTRICTIONS.items() for x in pair)), F.lower(kind))


def turn_restrictions(relations: DataFrame, members: DataFrame) -> DataFrame:
    """B23, C15. (rel_id, from_way, to_way, code) of restriction relations whose kind is known and
    whose from member is a way. relations: id, rel_type, restriction."""
    kinds = relations.where("rel_type = 'restriction'").select(F.col("id").alias("rel_id"), restriction_code(F.col("restriction")).alias("code")).where("code IS NOT NULL")
    side = lambda role: members.where((F.col("role") == role) & (F.col("member_type") == 1)).select("rel_id", F.col("member_id").alias(f"{role}_way"))
    return kinds.join(side("from"), "rel_id").join(side("to"), "rel_id").select("rel_id", "from_way", "to_way", "code")


def vertex_usage(way_nodes: DataFrame) -> DataFrame:
    """D15. (node_id, ways): distinct ways at each vertex."""
    return way_nodes.groupBy("node_id").agg(F.countDistinct("way_id").alias("ways"))


def adjacent_roads(way_nodes: DataFrame) -> DataFrame:
    """D16. (way_id, ord, adjacent): other ways at each vertex."""
    return way_nodes.join(vertex_usage(way_nodes), "node_id").select("way_id", "ord", (F.col("ways") - 1).alias("adjacent"))


def reinsert_shared(kept: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """C25. Kept vertices (way_id, ord, node_id) and those dropped ones that two ways or more use."""
    shared = vertex_usage(way_nodes).where("ways >= 2").select("node_id")
    back = way_nodes.join(shared, "node_id", "left_semi").select("way_id", "ord", "node_id")
    return kept.select("way_id", "ord", "node_id").union(back).distinct()


def collapse_roundabouts(way_nodes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I10. Closed ways become their mean point; other ways' shared vertices move there.

    Returns (points: way_id, lat, lon; way_nodes with the collapsed vertices replaced by the id
    -way_id of the roundabout). A vertex of several roundabouts goes to the smallest.
    """
    ends = way_nodes.groupBy("way_id").agg(F.min_by("node_id", "ord").alias("a"), F.max_by("node_id", "ord").alias("b"), F.count("*").alias("n"))
    closed = ends.where("a = b AND n > 2").select("way_id")
    ring = way_nodes.join(closed, "way_id", "left_semi")
    last = F.max("ord").over(Window.partitionBy("way_id"))
    open_ring = ring.withColumn("last", last).where("ord < last")
    points = open_ring.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy("way_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
    moved = open_ring.groupBy("node_id").agg((-F.min("way_id")).alias("to"))
    rest = way_nodes.join(closed, "way_id", "left_anti").join(moved, "node_id", "left")
    return points, rest.select("way_id", "ord", F.coalesce("to", "node_id").alias("node_id"))


def write_roads(roads: DataFrame, path: str, tile: Column) -> None:
    """A15. Parquet by base network, clustered by tile."""
    placed = roads.withColumn("tile", tile)
    placed.repartitionByRange("base", "tile").sortWithinPartitions("tile").write.partitionBy("base").parquet(path)


def _joined_path(parts: list[tuple[list[int], list[float], list[float]]]) -> tuple[list[int], list[float], list[float]]:
    """Roads one after the other, each turned so that it begins where the one before ends; the first so
    that it ends where the second begins or ends. Where both ways fit a road is taken as it is."""
    first, *rest = parts
    if rest and first[0][-1] not in (rest[0][0][0], rest[0][0][-1]) and first[0][0] in (rest[0][0][0], rest[0][0][-1]):
        first = tuple(c[::-1] for c in first)
    nodes, lats, lons = (list(c) for c in first)
    for part in rest:
        if part[0][0] != nodes[-1] and part[0][-1] == nodes[-1]:
            part = tuple(c[::-1] for c in part)
        skip = int(part[0][0] == nodes[-1])
        for whole, more in zip((nodes, lats, lons), part, strict=True):
            whole += more[skip:]
    return nodes, lats, lons


def merged_roads(roads: DataFrame, chains: DataFrame, zoom: int = 15) -> DataFrame:
    """I11. Chains as roads: (chain, road_ids, class, ref, name, add_types, node_ids, lats, lons, clusters).

    roads: id, class, ref, name, add_types array<int>, node_ids, lats, lons (arrays of equal length);
    chains: chain, road_ids in order. class, ref and name are those that all roads of a chain share;
    add_types keeps what they have in common (G5), a null being none; clusters are the tiles of `zoom`
    (their keys) that the chain has vertices in. Roads without points add nothing to the path.
    """
    own = roads.select(F.col("id").alias("road_id"), "class", "ref", "name", F.coalesce("add_types", F.array().cast("array<int>")).alias("add_types"), "node_ids", "lats", "lons")
    placed = chains.select("chain", "road_ids", F.posexplode("road_ids").alias("pos", "road_id")).join(own, "road_id")
    rows = placed.groupBy("chain").agg(
        F.first("road_ids").alias("road_ids"), *(F.first(c).alias(c) for c in ("class", "ref", "name")),
        F.array_sort(F.collect_list(F.struct("pos", "add_types", "node_ids", "lats", "lons"))).alias("parts"),
    )
    types = F.aggregate("parts", F.col("parts")[0]["add_types"], lambda kept, p: F.array_intersect(kept, p["add_types"]))

    @F.pandas_udf("struct<node_ids:array<bigint>,lats:array<double>,lons:array<double>>")
    def path(nodes: pd.Series, lats: pd.Series, lons: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(nodes, lats, lons, strict=True):
            parts = [tuple(list(c) for c in p) for p in zip(*row, strict=True) if p[0] is not None and len(p[0])]
            out.append(_joined_path(parts) if parts else ([], [], []))
        return pd.DataFrame(out, columns=["node_ids", "lats", "lons"])

    made = rows.withColumn("path", path("parts.node_ids", "parts.lats", "parts.lons")).select("chain", "road_ids", "class", "ref", "name", types.alias("add_types"), "path.*")
    tile = lambda lat, lon: geo.tile_key(F.floor(geo.tile_x(lon, zoom)), F.floor(geo.tile_y(lat, zoom)), zoom)
    return made.withColumn("clusters", F.array_sort(F.array_distinct(F.zip_with("lats", "lons", tile))))
