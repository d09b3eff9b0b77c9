"""Queries of the file sources: the given tables are written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import rules
from geoloom.session import cut_lineage, shared_folder
from geoloom.sources import pbf, shapefile

from .registry import Tables, query


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/geoloom-{uuid.uuid4().hex}"


def _elements(t: Tables) -> DataFrame:
    """Nodes, ways and relations in the schema of an extract."""
    tags = lambda *cs: F.map_filter(F.create_map(*(x for c in cs for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull())
    none = {f.split(" ")[0]: F.lit(None).cast(f.split(" ", 1)[1]) for f in ("lat double", "lon double", "refs array<bigint>")}
    members = F.lit(None).cast("array<struct<id:bigint,type:int,role:string>>")
    nodes = t.osm_node.select(F.lit("node").alias("kind"), "id", "lat", "lon", tags("amenity", "name").alias("tags"), none["refs"].alias("refs"), members.alias("members"))
    refs = t.osm_way_node.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]).alias("refs"))
    ways = t.osm_way.join(refs, F.col("id") == F.col("way_id"))
    ways = ways.select(F.lit("way").alias("kind"), "id", none["lat"].alias("lat"), none["lon"].alias("lon"), tags("highway", "name", "oneway").alias("tags"), "refs", members.alias("members"))
    held = t.osm_relation_member.groupBy("rel_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("member_id").alias("id"), F.col("member_type").alias("type"), "role"))).alias("m"))
    relations = t.osm_relation.withColumnRenamed("rel_type", "type").join(held, F.col("id") == F.col("rel_id"))
    relations = relations.select(
        F.lit("relation").alias("kind"), "id", none["lat"].alias("lat"), none["lon"].alias("lon"), tags("name", "type").alias("tags"), none["refs"].alias("refs"),
        F.transform("m", lambda m: F.struct(m["id"].alias("id"), m["type"].alias("type"), m["role"].alias("role"))).alias("members"),
    )
    return nodes.unionByName(ways).unionByName(relations)


@query(
    "a1_extract_scan",
    """SELECT 'node' AS kind, id, round(lat,5) AS lat, round(lon,5) AS lon, concat_ws(';', CASE WHEN amenity IS NOT NULL THEN concat('amenity=',amenity) END, CASE WHEN name IS NOT NULL THEN concat('name=',name) END) AS tags, '' AS parts FROM osm_node
 UNION ALL SELECT 'way', y.id, NULL, NULL, concat_ws(';', concat('highway=',highway), concat('name=',name), CASE WHEN oneway IS NOT NULL THEN concat('oneway=',oneway) END), w.refs FROM osm_way y JOIN (SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY ord) AS refs FROM osm_way_node GROUP BY way_id) w ON w.way_id=y.id
 UNION ALL SELECT 'relation', r.id, NULL, NULL, concat_ws(';', concat('name=',name), concat('type=',rel_type)), m.parts FROM osm_relation r JOIN (SELECT rel_id, string_agg(concat(member_id, '/', member_type, '/', role), ',' ORDER BY ord) AS parts FROM osm_relation_member GROUP BY rel_id) m ON m.rel_id=r.id""",
)
def _(t: Tables) -> DataFrame:
    """An extract of all elements, scanned in ranges of 64 KB, so that blobs are found inside files."""
    path = _folder(t)
    pbf.write_extract(_elements(t), path, per_block=500)
    t.spark.dataSource.register(pbf.PbfSource)
    back = t.spark.read.format("osmpbf").option("rangeBytes", 1 << 16).load(path)
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    members = F.transform("members", lambda m: F.concat_ws("/", m["id"].cast("string"), m["type"].cast("string"), m["role"]))
    parts = F.coalesce(F.array_join(F.col("refs").cast("array<string>"), ","), F.array_join(members, ","), F.lit(""))
    return back.select("kind", "id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), tags.alias("tags"), parts.alias("parts"))


@query(
    "a9_rule_catalogue",
    """SELECT c_mktsegment AS tag, c_name AS value, CASE WHEN c_custkey%3=0 THEN 'additional' ELSE 'main' END AS kind, 5+c_nationkey AS minzoom, CAST(31 AS INT) AS maxzoom, c_custkey%2=0 AS only_point, CAST(row_number() OVER (ORDER BY 5+c_nationkey, c_mktsegment, c_name) AS INT) AS rule_id FROM customer""",
)
def _(t: Tables) -> DataFrame:
    """A catalogue with a category for each nation and a rule for each customer."""
    rule = F.struct(
        F.col("c_mktsegment").alias("_tag"), F.col("c_name").alias("_value"), F.when(F.col("c_custkey") % 3 == 0, "additional").alias("_kind"),
        F.when(F.col("c_custkey") % 2 == 0, "true").alias("_point"),
    )
    path = _folder(t)
    categories = t.customer.groupBy((5 + F.col("c_nationkey")).alias("_minzoom")).agg(F.array_sort(F.collect_list(rule)).alias("type"))
    categories.orderBy("_minzoom").write.format("xml").option("rootTag", "rules").option("rowTag", "category").save(path)
    back = rules.read_rules(t.spark, path)
    return back.select("tag", "value", "kind", "minzoom", "maxzoom", "only_point", "rule_id")


FIELDS = [("ID", "N", 12, 0), ("STREET", "C", 20, 0), ("SHARE", "N", 12, 2), ("EVEN", "L", 1, 0)]


def _layers(t: Tables) -> tuple[str, DataFrame]:
    """A layer for each postcode: a square around each address, with attributes; every 50th is deleted."""
    k = F.col("id")
    corner = lambda c, *steps: F.array(*(F.col(c) + s * 1e-3 for s in steps))
    rings = t.address.select(
        F.col("postcode").alias("layer"), k.alias("order"), (k % 50 == 0).alias("deleted"), corner("lon", 0, 0, 1, 1, 0).alias("x"), corner("lat", 0, 1, 1, 0, 0).alias("y"),
        k.alias("ID"), F.col("street").alias("STREET"), F.when(k % 7 != 0, (k % 1000) / 4).alias("SHARE"), F.when(k % 5 != 0, k % 2 == 0).alias("EVEN"),
    )
    path = _folder(t)
    return path, cut_lineage(shapefile.write_layers(rings, path, "layer", FIELDS))


LAYER = "SELECT postcode AS layer, CAST(row_number() OVER (PARTITION BY postcode ORDER BY id)-1 AS INT) AS rec_no, id, street, lat, lon FROM address"


def _layer() -> Column:
    return F.regexp_extract("file", r"([^/]+)\.[^.]+$", 1).alias("layer")



@query(
    "a11_shape_scan",
    f"SELECT layer, rec_no, 5 AS type, 5 AS n_points, round(lon,6) AS minx, round(lat,6) AS miny, round(lon+1e-3,6) AS maxx, round(lat+1e-3,6) AS maxy FROM ({LAYER}) q",
)
def _(t: Tables) -> DataFrame:
    path, _ = _layers(t)
    back = shapefile.read_shapes(t.spark, path, records_per_task=50)
    box = [F.round(c, 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")]
    return back.select(_layer(), "rec_no", "type", F.size("x").alias("n_points"), *box)


@query(
    "a12_attribute_scan",
    f"SELECT layer, rec_no, id%50=0 AS deleted, id AS ID, street AS STREET, CASE WHEN id%7<>0 THEN (id%1000)/4e0 END AS SHARE, CASE WHEN id%5<>0 THEN id%2=0 END AS EVEN FROM ({LAYER}) q",
)
def _(t: Tables) -> DataFrame:
    path, _ = _layers(t)
    back = shapefile.read_attributes(t.spark, path, records_per_task=50)
    return back.select(_layer(), "rec_no", "deleted", *(f[0] for f in FIELDS))


@query("a13_file_discovery", "SELECT DISTINCT concat(postcode, '.shp') AS name FROM address WHERE postcode LIKE 'p1000_'")
def _(t: Tables) -> DataFrame:
    path, _ = _layers(t)
    return shapefile.files(t.spark, path, "P1000?.SHP").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
