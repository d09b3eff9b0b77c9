"""Queries: staging, assembly, lengths, centres, set operations, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, tags
from geoloom.operators import assembly, mapobj, roads
from geoloom.session import ranked

from .registry import Tables, query

HAVERSINE = "2*6372.8e0*1000*ASIN(SQRT(POWER(SIN(RADIANS({b}-{a})/2),2)+COS(RADIANS({a}))*COS(RADIANS({b}))*POWER(SIN(RADIANS({d}-{c})/2),2)))"
SEGMENTS = f"""p AS (SELECT w.way_id,w.ord,n.lat,n.lon, lead(n.lat) OVER (PARTITION BY w.way_id ORDER BY w.ord) AS lat2, lead(n.lon) OVER (PARTITION BY w.way_id ORDER BY w.ord) AS lon2 FROM osm_way_node w JOIN osm_node n ON w.node_id=n.id),
s AS (SELECT *, {HAVERSINE.format(a="lat", b="lat2", c="lon", d="lon2")} AS len FROM p WHERE lat2 IS NOT NULL)"""


def way_segments_length_by_class(t: Tables) -> DataFrame:
    """Road segments and their length by class: the flagship query."""
    lengths = assembly.way_lengths(t.osm_way_node, t.osm_node)
    return lengths.join(t.osm_way, F.col("way_id") == F.col("id")).groupBy("highway").agg(
        F.sum("segs").alias("segs"), F.round(F.sum("len_m"), 2).alias("len_m")
    )


query(
    "e5_road_length_by_class",
    f"WITH {SEGMENTS} SELECT y.highway, CAST(COUNT(*) AS BIGINT) AS segs, ROUND(SUM(len),2) AS len_m FROM s JOIN osm_way y ON y.id=s.way_id GROUP BY y.highway",
)(way_segments_length_by_class)


@query(
    "a2_dense_node_decode",
    """SELECT user_id AS blob, event_id AS pos, CAST(sum(event_id) OVER w AS BIGINT) AS id, round(CAST(sum(event_id%1000-500) OVER w * 100 AS DOUBLE)*1e-9, 9) AS lat,
 round(CAST(sum(event_id%777-388) OVER w * 100 AS DOUBLE)*1e-9, 9) AS lon FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    deltas = t.events.select(F.col("user_id").alias("blob"), e.alias("pos"), e.alias("d_id"), (e % 1000 - 500).alias("d_lat"), (e % 777 - 388).alias("d_lon"))
    out = assembly.decode_dense(deltas)
    return out.withColumn("lat", F.round("lat", 9)).withColumn("lon", F.round("lon", 9))


@query(
    "a3_plain_node_decode",
    """SELECT p_partkey AS id, round(CAST(p_partkey AS DOUBLE)*100*1e-9, 9) AS lat, round(CAST(p_size AS DOUBLE)*100*1e-9, 9) AS lon, p_type AS kind, p_name AS name FROM part""",
)
def _(t: Tables) -> DataFrame:
    strings = t.part.select(F.col("p_partkey").alias("blob"), F.array(F.lit(""), F.lit("kind"), F.lit("name"), "p_type", "p_name").alias("strings"))
    nodes = t.part.select(
        F.col("p_partkey").alias("blob"), F.col("p_partkey").alias("id"), F.col("p_partkey").cast("double").alias("lat"), F.col("p_size").cast("double").alias("lon"),
        F.array(F.lit(1), F.lit(2)).alias("keys"), F.array(F.lit(3), F.lit(4)).alias("vals"),
    )
    out = assembly.decode_plain(nodes, strings)
    return out.select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.col("tags")["kind"].alias("kind"), F.col("tags")["name"].alias("name"))


@query("a4_way_explode", "SELECT w.way_id, w.ord, w.node_id, y.is_boundary FROM osm_way_node w JOIN osm_way y ON y.id=w.way_id")
def _(t: Tables) -> DataFrame:
    refs = t.osm_way_node.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id")))["node_id"].alias("ids"))
    deltas = F.transform("ids", lambda v, i: v - F.when(i > 0, F.get(F.col("ids"), i - 1)).otherwise(0))
    flag = F.when(F.col("is_boundary"), F.create_map(F.lit("boundary"), F.lit("x"))).otherwise(F.create_map(F.lit("highway"), F.lit("x")))
    ways = refs.join(t.osm_way, F.col("id") == F.col("way_id")).select("id", deltas.alias("refs"), flag.alias("tags"))
    return assembly.explode_ways(ways)


@query(
    "a5_relation_member_explode",
    """WITH m AS (SELECT o_custkey AS rel_id, o_orderkey AS pos, o_orderkey%7 AS member_id, CAST(o_orderkey%3 AS INT) AS member_type, o_orderstatus AS role FROM orders),
 f AS (SELECT *, row_number() OVER (PARTITION BY rel_id, member_id ORDER BY pos) AS n FROM m)
 SELECT rel_id, CAST(row_number() OVER (PARTITION BY rel_id ORDER BY pos)-1 AS INT) AS ord, member_id, member_type, role FROM f WHERE n=1""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    members = t.orders.select(
        F.col("o_custkey").alias("rel_id"), key.alias("pos"), (key % 7).alias("member_id"), (key % 3).cast("int").alias("member_type"), F.col("o_orderstatus").alias("role")
    )
    return assembly.explode_members(members)


@query(
    "a6_tag_blob_parse",
    "SELECT c_custkey AS id, c_mktsegment AS segment, c_name AS name, 2 AS n FROM customer",
)
def _(t: Tables) -> DataFrame:
    blob = F.concat(F.lit("~segment~"), "c_mktsegment", F.lit("~~name~"), "c_name", F.lit("~name~other~"))
    parsed = t.customer.select(F.col("c_custkey").alias("id"), tags.parse_tags(blob).alias("tags"))
    return parsed.select("id", F.col("tags")["segment"].alias("segment"), F.col("tags")["name"].alias("name"), F.size("tags").alias("n"))


@query("b1_tagged_nodes", "SELECT id, lat, lon FROM osm_node WHERE amenity IS NOT NULL OR name IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return assembly.tagged(t.osm_node, "amenity", "name").select("id", "lat", "lon")


@query("b2_boundary_ways", "SELECT id, highway FROM osm_way WHERE is_boundary")
def _(t: Tables) -> DataFrame:
    return assembly.boundary_ways(t.osm_way).select("id", "highway")


@query("b3_tagged_relations", "SELECT id, rel_type FROM osm_relation WHERE rel_type IS NOT NULL")
def _(t: Tables) -> DataFrame:
    relations = t.osm_relation.select("id", "rel_type", F.create_map(F.lit("type"), "rel_type").alias("tags"))
    return assembly.tagged(relations, "tags").select("id", "rel_type")


ASSEMBLED = """SELECT w.way_id AS id, count(*) AS n_ids, count(n.id) AS n_nodes, arg_min(w.node_id, w.ord) AS first_id, arg_max(w.node_id, w.ord) AS last_id,
 CAST(sum(CASE WHEN n.id IS NOT NULL THEN w.ord ELSE 0 END) AS BIGINT) AS ord_sum FROM osm_way_node w {join} LEFT JOIN osm_node n ON n.id=w.node_id GROUP BY w.way_id"""


def _summary(ways: DataFrame) -> DataFrame:
    return ways.select(
        "id", F.size("node_ids").cast("long").alias("n_ids"), F.size("nodes").cast("long").alias("n_nodes"), F.element_at("node_ids", 1).alias("first_id"),
        F.element_at("node_ids", -1).alias("last_id"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, v: a + v["ord"]).alias("ord_sum"),
    )


@query("c1_way_assembly", ASSEMBLED.format(join=""))
def _(t: Tables) -> DataFrame:
    return _summary(assembly.assemble_ways(t.osm_way_node, t.osm_node))


@query("c2_boundary_way_assembly", ASSEMBLED.format(join="JOIN osm_way y ON y.id=w.way_id AND y.is_boundary"))
def _(t: Tables) -> DataFrame:
    boundary = t.osm_way.where("is_boundary").select(F.col("id").alias("way_id"))
    return _summary(assembly.assemble_ways(t.osm_way_node.join(boundary, "way_id", "left_semi"), t.osm_node))


MEMBERS = """m AS (SELECT rel_id, ord, CASE member_id%3 WHEN 0 THEN member_id%2000 WHEN 1 THEN member_id ELSE member_id%1500 END AS member_id, CAST(member_id%3 AS INT) AS member_type, role FROM osm_relation_member)"""


def mixed_members(t: Tables) -> DataFrame:
    """The members with nodes and relations among them."""
    m = F.col("member_id")
    kind = (m % 3).cast("int")
    return t.osm_relation_member.select("rel_id", "ord", F.when(kind == 0, m % 2000).when(kind == 1, m).otherwise(m % 1500).alias("member_id"), kind.alias("member_type"), "role")


@query(
    "c3_member_resolution",
    f"""WITH {MEMBERS}, v AS (SELECT way_id, count(*) AS n FROM osm_way_node GROUP BY way_id), l AS (SELECT rel_id, string_agg(concat(ord, ':', member_id, ':', role), ',' ORDER BY ord) AS n FROM osm_relation_member GROUP BY rel_id)
 SELECT m.rel_id, m.ord, m.member_id, m.member_type, m.role, n.lat, n.lon, CASE WHEN member_type=1 THEN coalesce(v.n,0) END AS n_vertices, CASE WHEN member_type=2 THEN l.n END AS members
 FROM m LEFT JOIN osm_node n ON member_type=0 AND n.id=m.member_id LEFT JOIN v ON member_type=1 AND v.way_id=m.member_id LEFT JOIN l ON member_type=2 AND l.rel_id=m.member_id WHERE member_type<>0 OR n.id IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    found = assembly.resolve_members(mixed_members(t), t.osm_node, t.osm_way_node, t.osm_relation_member)
    return found.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["ord"].cast("string"), m["member_id"].cast("string"), m["role"])), ","))


@query("c4_members_by_role", "SELECT rel_id, ord, member_id FROM osm_relation_member WHERE role IN ('inner','outer')")
def _(t: Tables) -> DataFrame:
    return assembly.members_by_role(t.osm_relation_member, "inner", "outer").select("rel_id", "ord", "member_id")


@query(
    "d1_element_counts",
    """SELECT 'nodes' AS kind, count(*) AS n FROM osm_node WHERE amenity IS NOT NULL OR name IS NOT NULL UNION ALL SELECT 'way_rows', count(*) FROM osm_way_node
 UNION ALL SELECT 'boundary_rows', count(*) FROM osm_way_node w JOIN osm_way y ON y.id=w.way_id WHERE y.is_boundary UNION ALL SELECT 'relations', count(*) FROM osm_relation WHERE rel_type IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    tagged = {"nodes": F.expr("amenity IS NOT NULL OR name IS NOT NULL"), "relations": F.col("rel_type").isNotNull()}
    return assembly.element_counts(t.osm_node, t.osm_way_node, t.osm_way, t.osm_relation, tagged)


@query("d2_extent", "SELECT category, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM poi GROUP BY category")
def _(t: Tables) -> DataFrame:
    return t.poi.groupBy("category").agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))


@query("d3_way_centroid", "SELECT w.way_id, round(avg(n.lat),9) AS lat, round(avg(n.lon),9) AS lon FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id GROUP BY w.way_id")
def _(t: Tables) -> DataFrame:
    return assembly.way_centres(t.osm_way_node, t.osm_node).select("way_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    "d3_relation_centroid",
    f"""WITH {MEMBERS}, c AS (SELECT w.way_id, avg(n.lat) AS lat, avg(n.lon) AS lon FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id GROUP BY w.way_id),
 b AS (SELECT rel_id, n.lat, n.lon FROM m JOIN osm_node n ON n.id=m.member_id WHERE member_type=0 UNION ALL SELECT rel_id, c.lat, c.lon FROM m JOIN c ON c.way_id=m.member_id WHERE member_type=1)
 SELECT rel_id, round(avg(lat),9) AS lat, round(avg(lon),9) AS lon FROM b GROUP BY rel_id""",
)
def _(t: Tables) -> DataFrame:
    out = assembly.relation_centres(mixed_members(t), t.osm_node, assembly.way_centres(t.osm_way_node, t.osm_node))
    return out.select("rel_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    "d4_weighted_centroid",
    f"WITH {SEGMENTS} SELECT way_id, round(sum((lat+lat2)/2*len)/sum(len),7) AS lat, round(sum((lon+lon2)/2*len)/sum(len),7) AS lon FROM s GROUP BY way_id HAVING sum(len)>0",
)
def _(t: Tables) -> DataFrame:
    return assembly.weighted_centres(t.osm_way_node, t.osm_node).select("way_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("e2_way_ends", "SELECT way_id, arg_min(node_id, ord) AS first_node, arg_max(node_id, ord) AS last_node, count(*) AS n_vertices FROM osm_way_node GROUP BY way_id")
def _(t: Tables) -> DataFrame:
    return assembly.way_ends(t.osm_way_node)


@query(
    "e4_repeat_removal",
    "WITH b AS (SELECT way_id, ord, node_id%5 AS place, lag(node_id%5) OVER (PARTITION BY way_id ORDER BY ord) AS p FROM osm_way_node) SELECT way_id, ord, place FROM b WHERE p IS NULL OR p<>place",
)
def _(t: Tables) -> DataFrame:
    points = t.osm_way_node.select("way_id", "ord", (F.col("node_id") % 5).alias("place"))
    return assembly.drop_repeats(points, "way_id", "ord", F.col("place"))


@query("e5_polyline_length", f"WITH {SEGMENTS} SELECT way_id, count(*) AS segs, round(sum(len),3) AS len_m FROM s GROUP BY way_id")
def _(t: Tables) -> DataFrame:
    return assembly.way_lengths(t.osm_way_node, t.osm_node).select("way_id", "segs", F.round("len_m", 3).alias("len_m"))


@query("f1_order_by_ord", "SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY ord) AS path FROM osm_way_node GROUP BY way_id")
def _(t: Tables) -> DataFrame:
    paths = assembly.ordered(t.osm_way_node, "way_id", "ord", "node_id")
    return paths.select("way_id", F.array_join(F.col("node_id").cast("array<string>"), ",").alias("path"))


@query(
    "g1_union_elements",
    "SELECT 0 AS kind, id, name FROM osm_node UNION ALL SELECT 2, id, name FROM osm_relation UNION ALL SELECT 1, id, name FROM osm_way",
)
def _(t: Tables) -> DataFrame:
    return assembly.union_elements(t.osm_node, t.osm_way, t.osm_relation, "id", "name")


@query("g5_type_intersection", "SELECT id, CASE WHEN id%2=0 AND id%3=0 THEN '2,3' WHEN id%2=0 THEN '2' WHEN id%3=0 THEN '3' ELSE '' END AS types FROM osm_way")
def _(t: Tables) -> DataFrame:
    own = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, 2), F.when(F.col("id") % 3 == 0, 3), F.lit(7)))
    return t.osm_way.select("id", F.array_join(mapobj.common_types(own, F.array(F.lit(2), F.lit(3), F.lit(5))).cast("array<string>"), ",").alias("types"))


@query("g6_union_with_coastline", "SELECT id, highway AS type FROM osm_way UNION ALL SELECT -id, 'coastline' FROM osm_way WHERE is_boundary")
def _(t: Tables) -> DataFrame:
    base = t.osm_way.select("id", F.col("highway").alias("type"))
    coast = t.osm_way.where("is_boundary").select((-F.col("id")).alias("id"), F.lit("coastline").alias("type"))
    return mapobj.with_coast(base, coast)


@query("d15_vertex_usage", "SELECT node_id, count(DISTINCT way_id) AS ways FROM osm_way_node GROUP BY node_id")
def _(t: Tables) -> DataFrame:
    return roads.vertex_usage(t.osm_way_node)


@query(
    "d16_adjacent_roads",
    "WITH u AS (SELECT node_id, count(DISTINCT way_id) AS ways FROM osm_way_node GROUP BY node_id) SELECT w.way_id, w.ord, u.ways-1 AS adjacent FROM osm_way_node w JOIN u USING (node_id)",
)
def _(t: Tables) -> DataFrame:
    return roads.adjacent_roads(t.osm_way_node)


@query(
    "c25_shared_vertex_reinsertion",
    """WITH m AS (SELECT w.* FROM osm_way_node w JOIN osm_way y ON y.id=w.way_id WHERE y.highway IN ('motorway','primary')), u AS (SELECT node_id FROM m GROUP BY node_id HAVING count(DISTINCT way_id)>=9)
 SELECT way_id, ord, node_id FROM m WHERE ord%2=0 OR node_id IN (SELECT node_id FROM (SELECT node_id FROM m GROUP BY node_id HAVING count(DISTINCT way_id)>=2))""",
)
def _(t: Tables) -> DataFrame:
    main = t.osm_way.where("highway IN ('motorway','primary')").select(F.col("id").alias("way_id"))
    vertices = t.osm_way_node.join(main, "way_id", "left_semi")
    return roads.reinsert_shared(vertices.where("ord % 2 = 0"), vertices)


@query(
    "b23_turn_restriction_filter",
    """SELECT r.id, CASE o_lower WHEN 'no_right_turn' THEN 1 WHEN 'no_left_turn' THEN 2 WHEN 'no_u_turn' THEN 3 WHEN 'only_left_turn' THEN 6 END AS code FROM
 (SELECT id, CASE id%5 WHEN 0 THEN 'no_right_turn' WHEN 1 THEN 'no_left_turn' WHEN 2 THEN 'no_u_turn' WHEN 3 THEN 'only_left_turn' ELSE 'unknown' END AS o_lower FROM osm_relation WHERE rel_type='restriction') r WHERE o_lower<>'unknown'""",
)
def _(t: Tables) -> DataFrame:
    return _restriction_relations(t).where("rel_type = 'restriction'").select("id", roads.restriction_code(F.col("restriction")).alias("code")).where("code IS NOT NULL")


def _restriction_relations(t: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, ("NO_RIGHT_TURN", "no_left_turn", "No_U_Turn", "only_left_turn", "unknown")))
    return t.osm_relation.withColumn("restriction", F.get(kinds, (F.col("id") % 5).cast("int")))


@query(
    "c15_turn_restrictions",
    """SELECT a.rel_id, a.member_id AS from_way, b.member_id AS to_way, CASE r.id%5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 6 END AS code
 FROM osm_relation r JOIN osm_relation_member a ON a.rel_id=r.id AND a.role='from' JOIN osm_relation_member b ON b.rel_id=r.id AND b.role='to' WHERE r.rel_type='restriction' AND r.id%5<4""",
)
def _(t: Tables) -> DataFrame:
    return roads.turn_restrictions(_restriction_relations(t), t.osm_relation_member)


@query(
    "b22_road_selection",
    """SELECT y.id, y.highway, (y.highway IN ('motorway','primary','secondary') AND coalesce(v.n,0)>=2) AS base FROM osm_way y LEFT JOIN (SELECT way_id, count(*) AS n FROM osm_way_node GROUP BY way_id) v ON v.way_id=y.id
 WHERE y.highway IN ('motorway','primary','secondary','residential')""",
)
def _(t: Tables) -> DataFrame:
    sizes = t.osm_way_node.groupBy(F.col("way_id").alias("id")).agg(F.count("*").alias("n_vertices"))
    ways = t.osm_way.join(sizes, "id", "left").withColumn("n_vertices", F.coalesce("n_vertices", F.lit(0)))
    accepted = t.spark.createDataFrame([("highway", v) for v in ("motorway", "primary", "secondary", "residential")], "tag string, value string")
    return roads.select_roads(ways, accepted).select("id", "highway", "base")


@query(
    "i10_roundabout_collapse",
    """WITH w AS (SELECT way_id, ord, node_id FROM osm_way_node UNION ALL SELECT way_id, max(ord)+1, arg_min(node_id, ord) FROM osm_way_node WHERE way_id%10=0 GROUP BY way_id),
 e AS (SELECT way_id, max(ord) AS last FROM w GROUP BY way_id HAVING arg_min(node_id, ord)=arg_max(node_id, ord) AND count(*)>2)
 SELECT w.way_id, round(avg(n.lat),8) AS lat, round(avg(n.lon),8) AS lon FROM w JOIN e ON e.way_id=w.way_id AND w.ord<e.last JOIN osm_node n ON n.id=w.node_id GROUP BY w.way_id""",
)
def _(t: Tables) -> DataFrame:
    closing = t.osm_way_node.where("way_id % 10 = 0").groupBy("way_id").agg((F.max("ord") + 1).alias("ord"), F.min_by("node_id", "ord").alias("node_id"))
    points, _ = roads.collapse_roundabouts(t.osm_way_node.unionByName(closing), t.osm_node)
    return points.select("way_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query(
    "k10_line_heading",
    f"""WITH p AS (SELECT w.way_id, arg_min(n.lat, w.ord) AS a, arg_max(n.lat, w.ord) AS b, arg_min(n.lon, w.ord) AS c, arg_max(n.lon, w.ord) AS d FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id GROUP BY w.way_id)
 SELECT way_id, round(degrees(atan2(b-a, d-c)), 6) AS heading FROM p WHERE a<>b OR c<>d""",
)
def _(t: Tables) -> DataFrame:
    return assembly.line_headings(t.osm_way_node, t.osm_node).select("way_id", F.round("heading", 6).alias("heading"))


@query(
    "f2_sort_by_distance",
    f"""WITH d AS (SELECT id, {HAVERSINE.format(a="lat", b="40.1e0", c="lon", d="(-4.9e0)")} AS m FROM osm_node) SELECT id, round(m,4) AS m, row_number() OVER (ORDER BY round(m,4), id) AS rank FROM d""",
)
def _(t: Tables) -> DataFrame:
    near = t.osm_node.select("id", F.round(geo.distance_m(F.col("lat"), F.col("lon"), F.lit(40.1), F.lit(-4.9)), 4).alias("m"))
    return ranked(near, "m", "id").select("id", "m", F.col("n").alias("rank"))
