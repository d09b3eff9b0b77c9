"""Staging and assembly: delta decoding, ways, relations, lengths and centres."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from geoloom.functions.geo import distance_m

NODE, WAY, RELATION = 0, 1, 2  # fixed values: member types


def decode_dense(deltas: DataFrame, granularity: int = 100, lat_offset: int = 0, lon_offset: int = 0) -> DataFrame:
    """A2. (blob, pos, d_id, d_lat, d_lon) deltas to (blob, pos, id, lat, lon) in degrees."""
    w = Window.partitionBy("blob").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    degrees = lambda c, offset: (F.sum(c).over(w) * granularity + offset) * F.lit(1e-9)
    return deltas.select("blob", "pos", F.sum("d_id").over(w).alias("id"), degrees("d_lat", lat_offset).alias("lat"), degrees("d_lon", lon_offset).alias("lon"))


def decode_plain(nodes: DataFrame, strings: DataFrame, granularity: int = 100) -> DataFrame:
    """A3. (blob, id, lat, lon, keys, vals) with indexes into the blob's (blob, strings) table."""
    at = lambda i: F.get(F.col("strings"), i)
    tags = F.map_from_entries(F.zip_with("keys", "vals", lambda k, v: F.struct(at(k), at(v))))
    return nodes.join(strings, "blob").select(
        "id", (F.col("lat") * granularity * F.lit(1e-9)).alias("lat"), (F.col("lon") * granularity * F.lit(1e-9)).alias("lon"), tags.alias("tags")
    )


def explode_ways(ways: DataFrame) -> DataFrame:
    """A4. (id, refs as deltas, tags) to (way_id, ord, node_id, is_boundary): a running sum by way."""
    spread = ways.select(F.col("id").alias("way_id"), F.map_contains_key("tags", "boundary").alias("is_boundary"), F.posexplode("refs").alias("ord", "step"))
    so_far = Window.partitionBy("way_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return spread.select("way_id", "ord", F.sum("step").over(so_far).alias("node_id"), "is_boundary")


def explode_members(members: DataFrame) -> DataFrame:
    """A5. (rel_id, pos, member_id, member_type, role): the first occurrence of a member id stays
    (whatever its type), and positions are numbered anew from 0 as ord."""
    first = Window.partitionBy("rel_id", "member_id").orderBy("pos")
    again = Window.partitionBy("rel_id").orderBy("pos")
    return (
        members.withColumn("n", F.row_number().over(first))
        .where("n = 1")
        .select("rel_id", (F.row_number().over(again) - 1).alias("ord"), "member_id", "member_type", "role")
    )


def assemble_ways(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """C1. One row per way: node_ids in order, and the vertices that exist, in order.

    (id, node_ids array<bigint>, nodes array<struct<ord, id, lat, lon>>). Vertices without a node
    stay in node_ids only.
    """
    joined = way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id", "left")
    vertex = F.struct("ord", F.col("node_id").alias("id"), "lat", "lon")
    all_ = F.array_sort(F.collect_list(vertex))
    return joined.groupBy(F.col("way_id").alias("id")).agg(all_.alias("vertices")).select(
        "id", F.col("vertices.id").alias("node_ids"), F.filter("vertices", lambda v: v["lat"].isNotNull()).alias("nodes")
    )


def resolve_members(members: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """C3. Members with what they refer to: (rel_id, ord, member_id, member_type, role, lat, lon,
    n_vertices, members).

    A node that is missing is dropped; a way is kept even without vertices; a nested relation has its
    member list (structs ord, member_id, role, in order), but what these refer to isn't looked up.
    nodes: id, lat, lon; ways: way_id, ord, node_id; relations: rel_id, ord, member_id, role.
    """
    base = ["rel_id", "ord", "member_id", "member_type", "role"]
    none = F.lit(None).cast("bigint")
    nobody = F.lit(None).cast(f"array<struct<ord:{dict(relations.dtypes)['ord']},member_id:{dict(relations.dtypes)['member_id']},role:string>>")
    of = lambda kind: members.where(F.col("member_type") == kind).select(base)
    as_node = of(NODE).join(nodes.select(F.col("id").alias("member_id"), "lat", "lon"), "member_id")
    as_node = as_node.select(*base, "lat", "lon", none.alias("n_vertices"), nobody.alias("members"))
    empty = F.lit(None).cast("double")
    sizes = ways.groupBy(F.col("way_id").alias("member_id")).agg(F.count("*").alias("n_vertices"))
    as_way = of(WAY).join(sizes, "member_id", "left").select(
        *base, empty.alias("lat"), empty.alias("lon"), F.coalesce("n_vertices", F.lit(0)).alias("n_vertices"), nobody.alias("members")
    )
    nested = relations.join(of(RELATION).select(F.col("member_id").alias("rel_id")).distinct(), "rel_id", "left_semi")
    lists = nested.groupBy(F.col("rel_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("ord", "member_id", "role"))).alias("members"))
    as_relation = of(RELATION).join(lists, F.col("member_id") == F.col("of"), "left").select(
        *base, empty.alias("lat"), empty.alias("lon"), none.alias("n_vertices"), "members"
    )
    return as_node.unionByName(as_way).unionByName(as_relation)


def members_by_role(members: DataFrame, *roles: str) -> DataFrame:
    """C4."""
    return members.where(F.col("role").isin(*roles))


def way_ends(way_nodes: DataFrame) -> DataFrame:
    """E2. First and last node of each way."""
    return way_nodes.groupBy("way_id").agg(
        F.min_by("node_id", "ord").alias("first_node"), F.max_by("node_id", "ord").alias("last_node"), F.count("*").alias("n_vertices")
    )


def drop_repeats(points: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """E4. Without points whose value equals the one before, by group and order."""
    w = Window.partitionBy(key).orderBy(order)
    return points.withColumn("__before", F.lag(value).over(w)).where(F.col("__before").isNull() | (F.col("__before") != value)).drop("__before")


def segments(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways' segments between vertices that exist: (way_id, ord, lat, lon, lat2, lon2, length_m)."""
    w = Window.partitionBy("way_id").orderBy("ord")
    placed = way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    return (
        placed.select("way_id", "ord", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
        .where("lat2 IS NOT NULL")
        .withColumn("length_m", distance_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    )


def way_lengths(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """E5."""
    return segments(way_nodes, nodes).groupBy("way_id").agg(F.count("*").alias("segs"), F.sum("length_m").alias("len_m"))


def way_centres(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """D3. Mean of the vertices that exist."""
    placed = way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    return placed.groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def relation_centres(members: DataFrame, nodes: DataFrame, way_centres_: DataFrame) -> DataFrame:
    """D3. Mean of the members' centres; sub-relations don't count."""
    points = members.where(F.col("member_type") == NODE).join(nodes.select(F.col("id").alias("member_id"), "lat", "lon"), "member_id")
    lines = members.where(F.col("member_type") == WAY).join(way_centres_.withColumnRenamed("way_id", "member_id"), "member_id")
    both = points.select("rel_id", "lat", "lon").unionByName(lines.select("rel_id", "lat", "lon"))
    return both.groupBy("rel_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def weighted_centres(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """D4. Segment midpoints weighted by length."""
    s = segments(way_nodes, nodes)
    mean = lambda a, b: F.try_divide(F.sum((F.col(a) + F.col(b)) / 2 * F.col("length_m")), F.sum("length_m"))
    return s.groupBy("way_id").agg(mean("lat", "lat2").alias("lat"), mean("lon", "lon2").alias("lon")).where("lat IS NOT NULL")


def tagged(elements: DataFrame, *columns: str) -> DataFrame:
    """B1, B3. Elements with a tag: a value in one of `columns`, or any entry of a map among them."""
    some = F.lit(False)
    for c in columns:
        some = some | (F.size(c) > 0 if isinstance(elements.schema[c].dataType, MapType) else F.col(c).isNotNull())
    return elements.where(F.coalesce(some, F.lit(False)))


def boundary_ways(ways: DataFrame) -> DataFrame:
    """B2. Ways with a boundary tag. ways: is_boundary."""
    return ways.where(F.coalesce("is_boundary", F.lit(False)))


def ordered(rows: DataFrame, key: str, ord_: str, value: str) -> DataFrame:
    """F1. (key, value as an array in the order of `ord_`): the vertices of ways, the members of relations."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ord_, value)))[value].alias(value))


def union_elements(nodes: DataFrame, ways: DataFrame, relations: DataFrame, *columns: str) -> DataFrame:
    """G1. (kind, columns): nodes (0), ways (1) and relations (2) as one table; columns that one of
    them lacks are null there."""
    kinds = ((0, nodes), (1, ways), (2, relations))
    parts = [df.select(F.lit(k).alias("kind"), *(c for c in columns if c in df.columns)) for k, df in kinds]
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


def line_headings(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """K10. (way_id, heading): degrees of the way from the first vertex to the last, east being 0 and
    north 90. Ways that end where they begin have none."""
    placed = way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    v = F.struct("lat", "lon")
    ends = placed.groupBy("way_id").agg(F.min_by(v, "ord").alias("a"), F.max_by(v, "ord").alias("b")).where("a <> b")
    return ends.select("way_id", F.degrees(F.atan2(F.col("b.lat") - F.col("a.lat"), F.col("b.lon") - F.col("a.lon"))).alias("heading"))


def element_counts(nodes: DataFrame, way_nodes: DataFrame, ways: DataFrame, relations: DataFrame, tagged: dict[str, Column]) -> DataFrame:
    """D1. One row for each kind of element; `tagged` has the conditions for nodes and relations."""
    boundary = way_nodes.join(ways.where("is_boundary").select(F.col("id").alias("way_id")), "way_id", "left_semi")
    kinds = (
        ("nodes", nodes.where(tagged["nodes"])), ("way_rows", way_nodes), ("boundary_rows", boundary), ("relations", relations.where(tagged["relations"])),
    )
    out = None
    for kind, df in kinds:
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def for_each_element(elements: DataFrame, callback: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str) -> DataFrame:
    """U1. A user's function over batches of elements of one kind."""
    return elements.mapInPandas(callback, schema)


def for_each_kind(
    elements: DataFrame, callbacks: dict[str, tuple[Sequence[str], Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], StructType | str]]
) -> dict[str, DataFrame]:
    """U1. kind -> (columns, callback, its schema): each callback gets batches of the elements of its
    kind, with the columns that the kind has; nothing else is sent to it. elements: kind and all columns."""
    return {kind: for_each_element(elements.where(F.col("kind") == kind).select(*columns), f, schema) for kind, (columns, f, schema) in callbacks.items()}


class Indexers:
    """U2. Indexers by name: functions DataFrame -> DataFrame, applied to element rows one by one
    (register, run), or routes, which all share one scan (route, write)."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._routes: dict[str, tuple[Column, list[Column]]] = {}

    def route(self, name: str, when: Column, *columns: Column) -> None:
        """An indexer that takes `columns` of the elements for which `when` holds."""
        self._routes[name] = (when, list(columns))

    def routed(self, elements: DataFrame) -> DataFrame:
        """(indexer, and a struct column for each route): a row for every element and route that takes it."""
        shape = {name: elements.select(F.struct(*columns).alias("s")).schema["s"].dataType for name, (_, columns) in self._routes.items()}

        def sent(name: str) -> Column:
            when, columns = self._routes[name]
            fields = [F.struct(*columns).alias(n) if n == name else F.lit(None).cast(t).alias(n) for n, t in shape.items()]
            return F.when(when, F.struct(F.lit(name).alias("indexer"), *fields))

        return elements.select(F.explode(F.array_compact(F.array(*map(sent, self._routes)))).alias("to")).select("to.*")

    def write(self, elements: DataFrame, path: str) -> dict[str, DataFrame]:
        """One scan of the elements and one job write all routes, a folder each; what each holds."""
        self.routed(elements).write.partitionBy("indexer").parquet(path)
        back = elements.sparkSession.read.parquet(path)
        return {name: back.where(F.col("indexer") == name).select(f"{name}.*") for name in self._routes}

    def register(self, name: str, indexer: Callable[[DataFrame], DataFrame]) -> None:
        self._by_name[name] = indexer

    def run(self, elements: DataFrame) -> dict[str, DataFrame]:
        return {name: elements.transform(f) for name, f in self._by_name.items()}
