"""Queries: tag rules, map objects, geometry, style, shapes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import coast, generalise, geometry, labels, mapobj, multipolygon, roads, rules, shapes, style
from geoloom.session import shared_folder

from .registry import Tables, query
from .staging import mixed_members

#: a small catalogue of our own
CATALOGUE = [
    {"tag": "highway", "value": "motorway", "minzoom": 11},
    {"tag": "highway", "value": "primary", "minzoom": 12},
    {"tag": "highway", "value": "residential", "minzoom": 14},
    {"tag": "highway", "value": "footway", "minzoom": 15, "target_id": 5},
    {"tag": "highway"},
    {"tag": "amenity", "value": "restaurant", "only_point": True, "poi_category": "sustenance", "poi_prefix": "r_"},
    {"tag": "amenity", "value": "cafe", "only_point": True, "poi_category": "sustenance"},
    {"tag": "amenity", "value": "bank", "only_point": True, "poi_category": "finance"},
    {"tag": "amenity", "poi_category": "other"},
    {"tag": "oneway", "value": "yes", "kind": "additional", "apply_to": [("highway", None)]},
    {"tag": "name", "kind": "text"},
    {"tag": "name:en", "kind": "text"},
    {"tag": "route", "kind": "additional", "relation": True},
]
RULE_SQL = """r(rule_id, tag, value, kind, minzoom, maxzoom, point) AS (VALUES (1,'highway','motorway','main',11,31,false),(2,'highway','primary','main',12,31,false),(3,'highway','residential','main',14,31,false),(5,'highway','footway','main',15,31,false),
 (5,'highway',NULL,'main',15,31,false),(6,'amenity','restaurant','main',15,31,true),(7,'amenity','cafe','main',15,31,true),(8,'amenity','bank','main',15,31,true),(9,'amenity',NULL,'main',15,31,false),(10,'oneway','yes','additional',5,31,false),(11,'name',NULL,'text',5,31,false))"""


def _rules(t: Tables) -> DataFrame:
    return rules.rule_table(t.spark, CATALOGUE)


def _tagged(df: DataFrame, *columns: str) -> DataFrame:
    pairs = [x for c in columns for x in (F.lit(c), F.col(c))]
    return df.withColumn("tags", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))


def _ways(t: Tables) -> DataFrame:
    return _tagged(t.osm_way, "highway", "name", "oneway").select("id", "tags", F.lit(False).alias("is_node"), F.lit(False).alias("is_relation"))


def _nodes(t: Tables) -> DataFrame:
    return _tagged(t.osm_node, "amenity", "name").select("id", "tags", F.lit(True).alias("is_node"), F.lit(False).alias("is_relation"))


LONG = "l AS (SELECT id, 'highway' AS k, highway AS v FROM osm_way UNION ALL SELECT id, 'name', name FROM osm_way UNION ALL SELECT id, 'oneway', oneway FROM osm_way WHERE oneway IS NOT NULL)"
MATCH = f"{RULE_SQL}, {LONG}, m AS (SELECT l.*, r.rule_id, r.kind, r.minzoom FROM l JOIN r ON r.tag=l.k AND (r.value=l.v OR (r.value IS NULL AND NOT EXISTS (SELECT 1 FROM r x WHERE x.tag=l.k AND x.value=l.v))))"


@query("c22_tag_rule_lookup", f"WITH {MATCH} SELECT id, k, v, CASE WHEN k='highway' AND v='footway' THEN 4 ELSE rule_id END AS rule_id FROM m")
def _(t: Tables) -> DataFrame:
    return rules.lookup(_ways(t).select("id", F.explode("tags").alias("k", "v")), _rules(t)).select("id", "k", "v", "rule_id")


@query(
    "h1_feature_encoding",
    f"""WITH {MATCH} SELECT id, CAST(max(CASE WHEN kind='main' THEN rule_id END) AS VARCHAR) AS types, coalesce(CAST(max(CASE WHEN kind='additional' THEN rule_id END) AS VARCHAR), '') AS add_types, max(CASE WHEN kind='text' THEN v END) AS name
 FROM m WHERE 14 >= minzoom GROUP BY id HAVING max(CASE WHEN kind='main' THEN rule_id END) IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    out = rules.encode_features(_ways(t), _rules(t), 14)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("id", text("types").alias("types"), text("add_types").alias("add_types"), F.col("names")[11].alias("name"))


@query("b5_zoom_visibility", f"WITH {MATCH} SELECT CAST(z.range AS INT) AS zoom, count(*) AS n FROM m, range(10,16) z WHERE z.range>=minzoom AND kind='main' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    found = rules.lookup(_ways(t).select("id", "is_node", F.explode("tags").alias("k", "v")), _rules(t)).where("kind = 'main'")
    counts = [rules.visible(found, z, F.col("is_node")).agg(F.lit(z).alias("zoom"), F.count("*").alias("n")) for z in range(10, 16)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.where("n > 0")


@query("b6_point_only_rules", "SELECT id, amenity FROM osm_node WHERE amenity IN ('restaurant','cafe','bank') AND id%2=0 UNION ALL SELECT id, amenity FROM osm_node WHERE amenity='pharmacy'")
def _(t: Tables) -> DataFrame:
    long_tags = _nodes(t).select("id", (F.col("id") % 2 == 0).alias("is_node"), F.explode("tags").alias("k", "v"))
    return rules.visible(rules.lookup(long_tags, _rules(t)), 15, F.col("is_node")).where("k = 'amenity'").select("id", F.col("v").alias("amenity"))


@query("h2_road_encoding", "SELECT id, CASE highway WHEN 'motorway' THEN '1' WHEN 'primary' THEN '2' ELSE '3' END || CASE WHEN oneway IS NOT NULL THEN ',4' ELSE '' END AS types, name FROM osm_way WHERE highway IN ('motorway','primary','secondary')")
def _(t: Tables) -> DataFrame:
    rows = [(1, "register", "highway", "motorway"), (2, "register", "highway", "primary"), (3, "register", "highway", "secondary"), (4, "amend", "one", None), (5, "text", "name", None)]
    table = t.spark.createDataFrame([(*r, None, None) for r in rows], "rule_id int, mode string, tag string, value string, tag2 string, value2 string")
    out = rules.encode_roads(_ways(t), table)
    return out.select("id", F.array_join(F.col("types").cast("array<string>"), ",").alias("types"), F.col("names")[5].alias("name"))


@query("h5_amenities", "SELECT id, CASE amenity WHEN 'restaurant' THEN 'sustenance' WHEN 'cafe' THEN 'sustenance' WHEN 'bank' THEN 'finance' ELSE 'other' END AS category, CASE WHEN amenity='restaurant' THEN 'r_restaurant' ELSE amenity END AS subtype FROM osm_node WHERE amenity IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return rules.amenities(_nodes(t), _rules(t))


@query("h6_additional_info", "SELECT id, oneway, name FROM osm_way")
def _(t: Tables) -> DataFrame:
    info = rules.additional_info(_ways(t), _rules(t))
    return info.select("id", F.col("info")["oneway"].alias("oneway"), F.col("info")["name"].alias("name"))


@query(
    "c7_tag_propagation",
    """WITH m AS (SELECT m.member_id, r.id AS rel_id, r.name FROM osm_relation_member m JOIN osm_relation r ON r.id=m.rel_id WHERE r.rel_type='route'), g AS (SELECT member_id, count(DISTINCT rel_id) AS n, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM m GROUP BY member_id)
 SELECT y.id, CASE WHEN g.n IS NOT NULL THEN 'road' END AS route, CASE WHEN y.id%2=0 THEN y.name ELSE g.names END AS name FROM osm_way y LEFT JOIN g ON g.member_id=y.id""",
)
def _(t: Tables) -> DataFrame:
    tags = F.when(F.col("rel_type") == "route", F.create_map(F.lit("route"), F.lit("road"), F.lit("name"), F.col("name"))).otherwise(F.create_map(F.lit("name"), F.col("name")))
    handed = rules.propagate(t.osm_relation.select("id", tags.alias("tags")), t.osm_relation_member, _rules(t))
    own = _tagged(t.osm_way.withColumn("name", F.when(F.col("id") % 2 == 0, F.col("name"))), "name", "highway").select("id", "tags")
    out = rules.with_propagated(own, handed)
    return out.select("id", F.col("tags")["route"].alias("route"), F.col("tags")["name"].alias("name"))


@query(
    "c7_road_propagation",
    """SELECT m.member_id, arg_min(r.name, r.id) AS name, arg_min(CAST(r.id%3 AS VARCHAR), r.id) AS lanes, CASE WHEN count(*) FILTER (WHERE r.id%2=0) > 0 THEN 'yes' END AS oneway
 FROM osm_relation_member m JOIN osm_relation r ON r.id=m.rel_id WHERE r.rel_type='route' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    modes = [("relation", "route", "road"), ("text", "name", None), ("amend", "lanes", None), ("register", "oneway", "yes")]
    route_rules = t.spark.createDataFrame(modes, "mode string, tag string, value string")
    k = F.col("id")
    relations = t.osm_relation.withColumns(
        {"route": F.when(F.col("rel_type") == "route", "road"), "lanes:forward": (k % 3).cast("string"), "oneway": F.when(k % 2 == 0, "true").otherwise("false"), "left": F.lit("x")}
    )
    handed = rules.propagate_roads(_tagged(relations, "route", "name", "lanes:forward", "oneway", "left").select("id", "tags"), t.osm_relation_member, route_rules)
    return handed.select("member_id", F.col("tags")["name"].alias("name"), F.col("tags")["lanes:forward"].alias("lanes"), F.col("tags")["oneway"].alias("oneway"))


@query(
    "c7_poi_propagation",
    """WITH g AS (SELECT m.member_id, CASE min(r.id%3) WHEN 0 THEN 'cafe' END AS amenity FROM osm_relation_member m JOIN osm_relation r ON r.id=m.rel_id GROUP BY 1)
 SELECT y.id, coalesce(CASE WHEN y.id%4=0 THEN 'bank' END, g.amenity) AS amenity FROM osm_way y LEFT JOIN g ON g.member_id=y.id""",
)
def _(t: Tables) -> DataFrame:
    catalogue = [{"tag": "amenity", "value": "cafe", "poi_category": "food", "relation": True}, {"tag": "amenity", "value": "bank", "poi_category": "finance"}]
    kind = F.when(F.col("id") % 3 == 0, "cafe").when(F.col("id") % 3 == 1, "bank")
    relations = _tagged(t.osm_relation.withColumn("amenity", kind), "amenity", "name").select("id", "tags")
    handed = rules.propagate_pois(relations, t.osm_relation_member, rules.rule_table(t.spark, catalogue))
    ways = _tagged(t.osm_way.withColumn("amenity", F.when(F.col("id") % 4 == 0, "bank")), "amenity").select("id", "tags")
    return rules.with_propagated(ways, handed).select("id", F.col("tags")["amenity"].alias("amenity"))


@query("c16_exclude_polygon_types", "SELECT y.id, CASE WHEN EXISTS (SELECT 1 FROM osm_relation_member m JOIN osm_relation r ON r.id=m.rel_id AND r.rel_type='multipolygon' WHERE m.member_id=y.id) THEN '2' ELSE '1,2' END AS types FROM osm_way y")
def _(t: Tables) -> DataFrame:
    members = t.osm_relation_member.join(t.osm_relation.where("rel_type = 'multipolygon'").select(F.col("id").alias("rel_id")), "rel_id")
    features = t.osm_way.select("id", F.array(F.lit(1), F.lit(2)).alias("types"))
    out = rules.exclude_polygon_types(features, members.select(F.col("member_id").alias("id"), F.array(F.lit(1), F.lit(7)).alias("rel_types")))
    return out.select("id", F.array_join(F.col("types").cast("array<string>"), ",").alias("types"))


@query("d9_rule_usage", "WITH n AS (SELECT category AS rule_id, count(*) AS n FROM poi GROUP BY category UNION ALL SELECT 'unused', 0) SELECT rule_id, n, CAST(row_number() OVER (ORDER BY CASE WHEN n=0 THEN 1 ELSE 0 END, n, rule_id) AS INT) AS code FROM n")
def _(t: Tables) -> DataFrame:
    known = t.poi.select(F.col("category").alias("rule_id")).distinct().union(t.spark.createDataFrame([("unused",)], "rule_id string"))
    return rules.rule_usage(t.poi.select(F.col("category").alias("rule_id")), known)


@query(
    "g7_seamark_split",
    """SELECT id, 0 AS part, concat('light|', id) AS made FROM osm_node WHERE id%3=0 UNION ALL SELECT id, 1, concat('buoy|', id) FROM osm_node WHERE id%3=0 UNION ALL SELECT id, 0, concat('buoy|', id) FROM osm_node WHERE id%3=1 UNION ALL SELECT id, 0, concat('none|', id) FROM osm_node WHERE id%3=2""",
)
def _(t: Tables) -> DataFrame:
    k, i = F.col("id") % 3, F.col("id").cast("string")
    light = F.map_from_arrays(F.array(*map(F.lit, ("seamark:type", "seamark:light_major:colour", "seamark:buoy:shape", "ref"))), F.array(F.lit("light_major"), F.lit("red"), F.lit("can"), i))
    buoy = F.map_from_arrays(F.array(F.lit("seamark:buoy:shape"), F.lit("ref")), F.array(F.lit("can"), i))
    entities = t.osm_node.select("id", F.when(k == 0, light).when(k == 1, buoy).otherwise(F.create_map(F.lit("ref"), i)).alias("tags"))
    tags = F.col("tags")
    kind = F.when(F.map_contains_key(tags, "seamark:light_major:colour"), "light").when(F.map_contains_key(tags, "seamark:buoy:shape"), "buoy").otherwise("none")
    return rules.split_seamarks(entities).select("id", "part", F.concat_ws("|", kind, tags["ref"]).alias("made"))


# ---- map objects

OBJECTS = "ob AS (SELECT o_orderkey AS id, o_orderkey%4 AS level, o_orderkey*911%100000 AS minx, o_custkey*733%100000 AS miny, o_orderkey*911%100000+o_orderkey%500 AS maxx, o_custkey*733%100000+o_custkey%300 AS maxy FROM orders)"


def _objects(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS id", "o_orderkey%4 AS level", "o_orderkey*911%100000 AS minx", "o_custkey*733%100000 AS miny",
        "o_orderkey*911%100000+o_orderkey%500 AS maxx", "o_custkey*733%100000+o_custkey%300 AS maxy",
    )


def _levels(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(geo.parse_zooms("11;12;13-14;15-"), "level int, minzoom int, maxzoom int")


BOX = (20000, 20000, 60000, 50000)
HIT = "minx<=60000 AND maxx>=20000 AND miny<=50000 AND maxy>=20000"


@query("b8_box_intersects", f"WITH {OBJECTS} SELECT id FROM ob WHERE {HIT}")
def _(t: Tables) -> DataFrame:
    return _objects(t).where(mapobj.box_intersects(*BOX)).select("id")


@query("i16_quad_box_query", f"WITH {OBJECTS} SELECT id FROM ob WHERE {HIT}")
def _(t: Tables) -> DataFrame:
    """The same box over a table in the order of quad keys."""
    return mapobj.quad_query(_written(t, lambda path: mapobj.write_quad_map(_objects(t), path, 30)), BOX, 30).select("id")


@query("b9_map_query", f"WITH {OBJECTS} SELECT id, level FROM ob WHERE {HIT} AND level=1")
def _(t: Tables) -> DataFrame:
    return mapobj.map_query(_objects(t), _levels(t), BOX, 13).select("id", "level")


@query("b11_object_has_type", "SELECT id FROM osm_way WHERE id%5=3")
def _(t: Tables) -> DataFrame:
    return t.osm_way.where(mapobj.has_type(F.array((F.col("id") % 5).cast("int"), F.lit(9)), 3)).select("id")


VERTICES = "v AS (SELECT way_id, ord, node_id%1000 AS x, node_id%700 AS y FROM osm_way_node)"


def _lines(t: Tables) -> DataFrame:
    """Ways as arrays of structs (x, y), every tenth closed."""
    point = F.struct("ord", (F.col("node_id") % 1000).alias("x"), (F.col("node_id") % 700).alias("y"))
    pts = t.osm_way_node.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    pts = pts.select("id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    return pts.withColumn("pts", F.when(F.col("id") % 10 == 0, F.concat("pts", F.slice("pts", 1, 1))).otherwise(F.col("pts")))


@query("b12_closed_figures", f"WITH {VERTICES} SELECT way_id AS id FROM v GROUP BY way_id HAVING way_id%10=0 OR (count(*)>1 AND arg_min(x,ord)=arg_max(x,ord) AND arg_min(y,ord)=arg_max(y,ord))")
def _(t: Tables) -> DataFrame:
    return _lines(t).where(mapobj.is_closed(F.col("pts"))).select("id")


@query("b13_layer_sign", "SELECT id, CASE id%4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS sign FROM osm_way")
def _(t: Tables) -> DataFrame:
    k = F.col("id") % 4
    types = F.when(k == 0, F.array(F.lit(5), F.lit(20))).when(k == 1, F.array(F.lit(9), F.lit(21), F.lit(20))).when(k == 2, F.array(F.lit(20), F.lit(21))).otherwise(F.array(F.lit(9)))
    return t.osm_way.select("id", mapobj.layer_sign(types, [20, 5], [21]).alias("sign"))


PX = "floor((lon+180)/360*{n}e0*256) AS x, floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*{n}e0*256) AS y"


@query(
    "b14_small_areas",
    f"""WITH p AS (SELECT w.way_id AS id, {PX.format(n=1024)} FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id), b AS (SELECT id, count(*) AS c, max(x)-min(x) AS w, max(y)-min(y) AS h FROM p GROUP BY id)
 SELECT id, c<2 OR (w<=20 AND h<=40) OR (w<=40 AND h<=20) AS small FROM b""",
)
def _(t: Tables) -> DataFrame:
    pts = t.osm_way_node.join(t.osm_node.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy(F.col("way_id").alias("id")).agg(F.collect_list(F.struct("lat", "lon")).alias("pts"))
    return pts.select("id", mapobj.is_small_area(F.col("pts"), 10, 20, 40).alias("small"))


CLOSED = f"{VERTICES}, c AS (SELECT * FROM v UNION ALL SELECT way_id, max(ord)+1, arg_min(x,ord), arg_min(y,ord) FROM v WHERE way_id%10=0 GROUP BY way_id), e AS (SELECT *, lead(x) OVER (PARTITION BY way_id ORDER BY ord) AS x2, lead(y) OVER (PARTITION BY way_id ORDER BY ord) AS y2 FROM c), a AS (SELECT way_id AS id, count(*) AS n, abs(sum(x*y2-x2*y))/2e0 AS area FROM e GROUP BY way_id), k AS (SELECT way_id FROM c GROUP BY way_id HAVING count(*)>1 AND arg_min(x,ord)=arg_max(x,ord) AND arg_min(y,ord)=arg_max(y,ord))"


@query("i8_ring_area31", f"WITH {CLOSED} SELECT id, round(coalesce(area,0),3) AS area FROM a WHERE id IN (SELECT way_id FROM k)")
def _(t: Tables) -> DataFrame:
    return _lines(t).where(mapobj.is_closed(F.col("pts"))).select("id", F.round(mapobj.ring_area31(F.col("pts")), 3).alias("area"))


@query("b15_drawable_polygons", f"WITH {CLOSED} SELECT id, round(5+1/(area/1024e0/1024e0),6) AS z FROM a WHERE id IN (SELECT way_id FROM k) AND n>2 AND area/1024e0/1024e0>0.05e0")
def _(t: Tables) -> DataFrame:
    objects = _lines(t).withColumn("order", F.lit(5.0))
    return mapobj.drawable_polygons(objects, 13, 0.05).select("id", F.round("z", 6).alias("z"))


@query(
    "i8_ring_area_m2",
    """WITH b AS (SELECT *, 2*6372.8e0*1000*asin(sqrt(power(sin(radians(max_lat-min_lat)/2),2))) AS h, 2*6372.8e0*1000*asin(sqrt(power(cos(radians(min_lat)),2)*power(sin(radians(max_lon-min_lon)/2),2))) AS w FROM boundary) SELECT id, round(w*h, 1) AS area FROM b""",
)
def _(t: Tables) -> DataFrame:
    from geoloom.operators.places import box_ring

    ring = box_ring(*(F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")))
    return t.boundary.select("id", F.round(mapobj.ring_area_m2(ring), 1).alias("area"))


@query("f4_draw_order", "SELECT id, row_number() OVER (ORDER BY id%7, id%5, id%3, id) AS n FROM osm_way")
def _(t: Tables) -> DataFrame:
    return mapobj.draw_ranks(t.osm_way.selectExpr("id", "id%7 AS z", "id%5 AS type_index", "id%3 AS n_points")).select("id", "n")


@query(
    "d13_density_thinning",
    f"""WITH {VERTICES}, t AS (SELECT DISTINCT way_id AS id, way_id%13 AS z, (x>>7)*100000+(y>>7) AS tile FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY z DESC, id DESC) AS n FROM t) SELECT DISTINCT id FROM r WHERE n<=5""",
)
def _(t: Tables) -> DataFrame:
    lines = _lines(t).withColumn("z", F.col("id") % 13)
    return mapobj.thin_by_density(lines, 20, 4, 5)


@query("i19_label_points", "SELECT w.way_id AS id, round(avg(n.lat),9) AS lat, round(avg(n.lon),9) AS lon FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    pts = t.osm_way_node.join(t.osm_node.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy(F.col("way_id").alias("id")).agg(F.collect_list(F.struct("lat", "lon")).alias("pts"))
    return mapobj.label_points(pts.withColumn("kind", F.lit("polygon"))).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    "f7_viewport_tiles",
    "WITH t AS (SELECT b.id, x.v AS x, y.v AS y, abs(x.v+0.5e0-(b.id+1.75e0))+abs(y.v+0.5e0-(b.id+1.0e0)) AS d FROM boundary b, LATERAL (SELECT unnest(range(b.id, b.id+4)) AS v) x, LATERAL (SELECT unnest(range(b.id, b.id+3)) AS v) y) SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY d, x, y)-1 AS n FROM t",
)
def _(t: Tables) -> DataFrame:
    i = F.col("id").cast("double")
    tiles = mapobj.viewport_tiles(i, i, i + 3.5, i + 2.0)
    return t.boundary.select("id", F.posexplode(tiles).alias("n", "tile")).select("id", F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), F.col("n").cast("long").alias("n"))


@query(
    "i16_quad_key",
    f"""WITH {OBJECTS}, z AS (SELECT ob.*, CAST(g.range AS INT) AS zoom FROM ob, range(0,32) g WHERE minx>>(31-g.range)=maxx>>(31-g.range) AND miny>>(31-g.range)=maxy>>(31-g.range)), b AS (SELECT id, max(zoom) AS zoom FROM z GROUP BY id)
 SELECT ob.id, b.zoom, ob.minx>>(31-b.zoom) AS x, ob.miny>>(31-b.zoom) AS y FROM ob JOIN b USING (id)""",
)
def _(t: Tables) -> DataFrame:
    k = mapobj.quad_key(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), 31)
    return _objects(t).select("id", k["zoom"].alias("zoom"), k["x"].alias("x"), k["y"].alias("y"))


@query(
    "i14_segment_clip",
    """WITH s AS (SELECT o_orderkey AS id, CAST(o_orderkey%1000 AS DOUBLE) AS ax, CAST(o_orderkey%777 AS DOUBLE) AS ay, CAST(o_custkey%900 AS DOUBLE) AS bx, CAST(o_custkey%650 AS DOUBLE) AS b_y FROM orders
 UNION ALL SELECT -o_orderkey, CAST(o_orderkey%1000 AS DOUBLE), CAST(o_orderkey%777 AS DOUBLE), CAST(CASE WHEN o_custkey%2=0 THEN o_orderkey%1000 ELSE o_custkey%900 END AS DOUBLE), CAST(CASE WHEN o_custkey%3<>1 THEN o_orderkey%777 ELSE o_custkey%650 END AS DOUBLE) FROM orders),
 p AS (SELECT id, ax, ay, bx-ax AS dx, b_y-ay AS dy FROM s),
 k AS (SELECT *, greatest(0, CASE WHEN dx<>0 THEN least((200-ax)/dx,(600-ax)/dx) ELSE 0 END, CASE WHEN dy<>0 THEN least((100-ay)/dy,(500-ay)/dy) ELSE 0 END) AS t0,
  least(1, CASE WHEN dx<>0 THEN greatest((200-ax)/dx,(600-ax)/dx) ELSE 1 END, CASE WHEN dy<>0 THEN greatest((100-ay)/dy,(500-ay)/dy) ELSE 1 END) AS t1
  FROM p WHERE (dx<>0 OR ax BETWEEN 200 AND 600) AND (dy<>0 OR ay BETWEEN 100 AND 500))
 SELECT id, round(ax+t0*dx,6) AS ax, round(ay+t0*dy,6) AS ay, round(ax+t1*dx,6) AS bx, round(ay+t1*dy,6) AS b_y FROM k WHERE t0<=t1""",
)
def _(t: Tables) -> DataFrame:
    """A segment an order, and under its negative key one that may be upright, level or a point."""
    start = ["CAST(o_orderkey%1000 AS DOUBLE) AS ax", "CAST(o_orderkey%777 AS DOUBLE) AS ay"]
    s = t.orders.selectExpr("o_orderkey AS id", *start, "CAST(o_custkey%900 AS DOUBLE) AS bx", "CAST(o_custkey%650 AS DOUBLE) AS by")
    straight = t.orders.selectExpr(
        "-o_orderkey AS id", *start,
        "CAST(IF(o_custkey%2=0, o_orderkey%1000, o_custkey%900) AS DOUBLE) AS bx", "CAST(IF(o_custkey%3<>1, o_orderkey%777, o_custkey%650) AS DOUBLE) AS by",
    )
    out = geometry.clip_segments(s.unionByName(straight), (200.0, 100.0, 600.0, 500.0))
    return out.select("id", *(F.round(c, 6).alias(n) for c, n in (("ax", "ax"), ("ay", "ay"), ("bx", "bx"), ("by", "b_y"))))


# ---- geometry without an SQL equivalent


def _placed(t: Tables) -> DataFrame:
    v = F.struct("ord", "lat", "lon")
    pts = t.osm_way_node.join(t.osm_node.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(v)).alias("p"))
    return pts.select("id", F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"))


@query("i1_douglas_peucker")
def _(t: Tables) -> DataFrame:
    return geometry.simplify_lines(_placed(t), 15, 3.0)


@query("i2_cycle_simplification")
def _(t: Tables) -> DataFrame:
    closed = _placed(t).select("id", *(F.concat(c, F.slice(c, 1, 1)).alias(c) for c in ("lats", "lons")))
    return geometry.simplify_cycles(closed, 12)


@query("i3_road_simplification")
def _(t: Tables) -> DataFrame:
    return geometry.simplify_roads(_placed(t).withColumn("fixed", F.transform("lats", lambda v, i: i % 3 == 0)), 15.0)


@query("e7_close_point_skipping")
def _(t: Tables) -> DataFrame:
    return geometry.skip_close(_lines(t).select("id", F.col("pts.x").cast("array<double>").alias("xs"), F.col("pts.y").cast("array<double>").alias("ys")))


# the same simplifications with texts of the kept points' numbers, which SQL can give as well

OFF = "sqrt(pow({p}.x-{a}.x-{share}*({b}.x-{a}.x),2)+pow({p}.y-{a}.y-{share}*({b}.y-{a}.y),2))"
SHARE = "(CASE WHEN pow({b}.x-{a}.x,2)+pow({b}.y-{a}.y,2)>0 THEN greatest(0e0,least(1e0,(({p}.x-{a}.x)*({b}.x-{a}.x)+({p}.y-{a}.y)*({b}.y-{a}.y))/(pow({b}.x-{a}.x,2)+pow({b}.y-{a}.y,2)))) ELSE 0e0 END)"


def _off(p: str, a: str, b: str) -> str:
    """The distance of a point from a segment."""
    return OFF.format(p=p, a=a, b=b, share=SHARE.format(p=p, a=a, b=b))


PLACED = """pts AS (SELECT w.way_id AS id, row_number() OVER (PARTITION BY w.way_id ORDER BY w.ord)-1 AS k, n.lat, n.lon FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id)"""
AS_TILES = "(lon+180)/360*{n}e0 AS x, (1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*{n}e0 AS y"


def _split_sql(points: str, epsilon: float, fixed: str = "false") -> str:
    """CTEs that split lines p (id, k, x, y) at their farthest points, from the first to the last point
    that isn't where the first is; kept (id, k) at the end."""
    return f"""p AS ({points}), b AS (SELECT q.id, max(q.k) AS last FROM p q JOIN p f ON f.id=q.id AND f.k=0 WHERE abs(q.x-f.x)+abs(q.y-f.y)>=1e-3 GROUP BY q.id),
 stops AS (SELECT p.id, p.k, lead(p.k) OVER (PARTITION BY p.id ORDER BY p.k) AS nxt FROM p JOIN b ON b.id=p.id WHERE p.k<=b.last AND (p.k=0 OR p.k=b.last OR ({fixed}))),
 seg AS (SELECT id, k AS a, nxt AS b FROM stops WHERE nxt IS NOT NULL UNION ALL
  SELECT q.id, CASE WHEN side=0 THEN q.a ELSE -q.far.k END, CASE WHEN side=0 THEN -q.far.k ELSE q.b END FROM
  (SELECT s.id, s.a, s.b, max({{'d': {_off('m', 'u', 'v')}, 'k': -m.k}}) AS far FROM seg s JOIN p u ON u.id=s.id AND u.k=s.a JOIN p v ON v.id=s.id AND v.k=s.b JOIN p m ON m.id=s.id AND m.k>s.a AND m.k<s.b GROUP BY s.id, s.a, s.b) q, (SELECT unnest([0,1]) AS side) t WHERE q.far.d>={epsilon}e0),
 kept AS (SELECT DISTINCT id, k FROM (SELECT id, a AS k FROM seg UNION ALL SELECT id, b FROM seg) q)"""


ENDS_MEET = "(SELECT f.id FROM p f JOIN (SELECT id, max(k) AS k FROM p GROUP BY id) m ON m.id=f.id JOIN p l ON l.id=m.id AND l.k=m.k WHERE f.k=0 AND l.k>0 AND abs(f.x-l.x)+abs(f.y-l.y)<1e-3)"


def _numbers(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query(
    "i1_kept_points",
    f"WITH RECURSIVE {PLACED}, {_split_sql(f'SELECT id, k, {AS_TILES.format(n=2**15)} FROM pts', 3.0)} SELECT i.id, coalesce(string_agg(CAST(kept.k AS VARCHAR), ',' ORDER BY kept.k), '') || CASE WHEN count(kept.k)>0 AND i.id IN {ENDS_MEET} THEN ',0' ELSE '' END AS kept FROM (SELECT DISTINCT id FROM p) i LEFT JOIN kept ON kept.id=i.id GROUP BY i.id",
)
def _(t: Tables) -> DataFrame:
    return _numbers(geometry.simplify_lines(_placed(t), 15, 3.0))


RINGED = f"{PLACED}, ring AS (SELECT id, k, lat, lon FROM pts UNION ALL SELECT id, max(k)+1, arg_min(lat,k), arg_min(lon,k) FROM pts GROUP BY id)"


@query(
    "i2_kept_points",
    f"""WITH RECURSIVE {RINGED}, {_split_sql(f'SELECT id, k, {AS_TILES.format(n=2**22)} FROM ring', 3.0)},
 w AS (SELECT id, max(floor(x/2))-min(floor(x/2)) AS w, max(floor(y/2))-min(floor(y/2)) AS h FROM (SELECT id, x, y FROM p) q GROUP BY id)
 SELECT kept.id, string_agg(CAST(kept.k AS VARCHAR), ',' ORDER BY kept.k) || ',0' AS kept FROM kept JOIN w ON w.id=kept.id WHERE NOT ((w.w<=2 AND w.h<=4) OR (w.w<=4 AND w.h<=2)) GROUP BY kept.id""",
)
def _(t: Tables) -> DataFrame:
    """Every way closed; the bound of small ones is in pixels of zoom 13, half a unit of zoom 22's tiles."""
    closed = _placed(t).select("id", *(F.concat(c, F.slice(c, 1, 1)).alias(c) for c in ("lats", "lons")))
    return _numbers(geometry.simplify_cycles(closed, 12))


METRES = "radians(1)*6372800e0"


@query(
    "i3_kept_points",
    f"""WITH RECURSIVE {PLACED}, {_split_sql(f'SELECT id, k, lon*{METRES}*cos(radians(avg(lat) OVER (PARTITION BY id))) AS x, lat*{METRES} AS y FROM pts', 15.0, 'p.k%3=0')} SELECT i.id, coalesce(string_agg(CAST(kept.k AS VARCHAR), ',' ORDER BY kept.k), '') AS kept FROM (SELECT DISTINCT id FROM p) i LEFT JOIN kept ON kept.id=i.id GROUP BY i.id""",
)
def _(t: Tables) -> DataFrame:
    return _numbers(geometry.simplify_roads(_placed(t).withColumn("fixed", F.transform("lats", lambda v, i: i % 3 == 0)), 15.0))


@query(
    "e7_kept_points",
    f"""WITH RECURSIVE {{CLOSED}}, p AS (SELECT way_id AS id, row_number() OVER (PARTITION BY way_id ORDER BY ord)-1 AS k, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM c),
 n AS (SELECT id, max(k) AS last FROM p GROUP BY id), run AS (SELECT id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a FROM n UNION ALL
 SELECT r.id, r.i+1, CASE WHEN {_off('m', 'u', 'v')}>31e0 THEN r.i+1 ELSE r.a END FROM run r JOIN p u ON u.id=r.id AND u.k=r.a JOIN p m ON m.id=r.id AND m.k=r.i+1 JOIN p v ON v.id=r.id AND v.k=r.i+2)
 SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS kept FROM (SELECT DISTINCT id, a AS k FROM run UNION SELECT id, last FROM n) q GROUP BY id""".replace("{CLOSED}", CLOSED),
)
def _(t: Tables) -> DataFrame:
    return _numbers(geometry.skip_close(_lines(t).select("id", F.col("pts.x").cast("array<double>").alias("xs"), F.col("pts.y").cast("array<double>").alias("ys"))))


def _box_ways(t: Tables) -> DataFrame:
    """Boundaries as four two-vertex ways each, every second reversed."""
    i = F.col("id")
    way = lambda a, b, turn: F.array(*((i * 10 + b, i * 10 + a) if turn else (i * 10 + a, i * 10 + b)))
    ways = F.array(way(0, 1, False), way(2, 3, False), way(1, 2, True), way(3, 0, True))
    return t.boundary.select(i.alias("rel_id"), F.lit("outer").alias("role"), F.posexplode(ways).alias("ord", "node_ids"))


@query("i5_ring_assembly", "SELECT id AS rel_id, true AS closed, 5 AS n FROM boundary")
def _(t: Tables) -> DataFrame:
    return geometry.assemble_rings(_box_ways(t)).select("rel_id", "closed", F.size("node_ids").alias("n"))


@query("i6_multipolygon_build", "SELECT id AS rel_id, 0 AS outer_ring, 1 AS holes FROM boundary")
def _(t: Tables) -> DataFrame:
    from geoloom.operators.places import box_ring

    c = [F.col(n) for n in ("min_lat", "min_lon", "max_lat", "max_lon")]
    d = 0.01
    outer = t.boundary.select(F.col("id").alias("rel_id"), F.lit("outer").alias("role"), F.lit(0).alias("ring"), box_ring(*c).alias("p"))
    inner = t.boundary.select(F.col("id").alias("rel_id"), F.lit("inner").alias("role"), F.lit(1).alias("ring"), box_ring(c[0] + d, c[1] + d, c[2] - d, c[3] - d).alias("p"))
    rings = outer.unionByName(inner).select("rel_id", "role", "ring", F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"), F.lit(True).alias("closed"))
    built, _ = geometry.build_multipolygons(rings)
    return built.select("rel_id", F.col("outer").alias("outer_ring"), F.size("inners").alias("holes"))


def _double_outlines(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Relations of two outlines with a hole each, the second a degree further north; rings cut into
    four ways, every second one backwards; and their nodes."""
    k = F.col("k")
    both = t.outline.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    base = F.col("place_id") * 1000 + F.col("copy") * 100 + F.when(F.col("role") == "inner", 50).otherwise(0)
    nodes = both.select((base + k).alias("id"), (F.col("lat") + F.col("copy")).alias("lat"), "lon")
    part = both.where("k % 6 = 0").withColumn("ids", F.transform(F.sequence(k, k + 6), lambda v: base + v % 24))
    order = (F.pmod(k * 7, F.lit(4)) * 2 + F.col("copy")).cast("int")
    ways = part.select(F.col("place_id").alias("rel_id"), "role", order.alias("ord"), F.when(k % 12 == 6, F.reverse("ids")).otherwise(F.col("ids")).alias("node_ids"))
    return ways, nodes


SHOELACE = """e AS (SELECT place_id, role, lat, lon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2 FROM outline WINDOW w AS (PARTITION BY place_id, role ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 s AS (SELECT place_id, sum(CASE WHEN role='outer' THEN a ELSE -a END) AS area FROM (SELECT place_id, role, abs(sum((lon+5e0)*(lat2-4e1)-(lon2+5e0)*(lat-4e1)))/2 AS a FROM e GROUP BY 1,2) q GROUP BY 1)"""


@query("i6_polygon_areas", f"WITH {SHOELACE}, c AS (SELECT CAST(range AS INTEGER) AS polygon FROM range(2)) SELECT place_id AS rel_id, polygon, 25 AS n_points, 1 AS holes, round(area*1e6, 4) AS area FROM s, c")
def _(t: Tables) -> DataFrame:
    """Two outers with a hole each, from their ways; areas in square degrees, by the shoelace formula."""
    polygons, _ = multipolygon.polygons_of_ways(*_double_outlines(t))
    south = F.floor(F.array_min("lats"))

    def area(lats: Column, lons: Column) -> Column:
        k = F.sequence(F.lit(1), F.size(lats) - 1)
        y, x = (lambda i: F.element_at(lats, i) - south), (lambda i: F.element_at(lons, i) + 5)
        return F.abs(F.aggregate(k, F.lit(0.0), lambda s, i: s + x(i) * y(i + 1) - x(i + 1) * y(i))) / 2

    holes = F.aggregate("holes", F.lit(0.0), lambda s, h: s + area(h["lats"], h["lons"]))
    return polygons.select("rel_id", "polygon", F.size("lats").alias("n_points"), F.size("holes").alias("holes"), F.round((area(F.col("lats"), F.col("lons")) - holes) * 1e6, 4).alias("area"))


@query("i6_polygon_levels")
def _(t: Tables) -> DataFrame:
    """The polygons in I4's output: every relation is a place of a type that is drawn from zoom 12 on."""
    polygons, _ = multipolygon.polygons_of_ways(*_double_outlines(t))
    tags = F.create_map(F.lit("highway"), F.lit("primary"), F.lit("name"), F.concat(F.lit("Area "), F.col("id").cast("string")))
    entities = t.place.select("id", tags.alias("tags"), F.lit(False).alias("is_node"))
    shapes = t.spark.createDataFrame([], "id long, node_ids array<long>, lats array<double>, lons array<double>")
    return generalise.generalise(entities, shapes, t.osm_node.select("id", "lat", "lon"), _rules(t), polygons=polygons)


@query(
    "i5_outline_rings",
    """WITH c AS (SELECT CAST(range AS INTEGER) AS copy FROM range(2)) SELECT place_id AS rel_id, role, copy, true AS closed, CAST(count(*) + 1 AS INTEGER) AS n, CAST(sum(place_id*1000 + copy*100 + CASE WHEN role='inner' THEN 50 ELSE 0 END + k) AS BIGINT) AS ids, CAST(round(sum(lat-4e1)*1e5) AS BIGINT) + 2400000*copy AS lats FROM outline, c GROUP BY 1,2,3""",
)
def _(t: Tables) -> DataFrame:
    """Rings put together from ways in either direction; sums over their distinct nodes."""
    ways, nodes = _double_outlines(t)
    made = geometry.assemble_rings(ways).select("rel_id", "role", "closed", F.size("node_ids").alias("n"), F.explode(F.array_distinct("node_ids")).alias("id"), "ring")
    copy = F.floor((F.col("id") - F.col("rel_id") * 1000) / 100).cast("int")
    placed = made.join(nodes, "id").groupBy("rel_id", "role", "ring", "closed", "n", copy.alias("copy"))
    return placed.agg(F.sum("id").alias("ids"), F.round(F.sum(F.col("lat") - 40.0) * 1e5).cast("long").alias("lats")).drop("ring")


SHIFTED = """sh AS (SELECT place_id, role, k, lat, lon + CASE WHEN role='inner' THEN CAST((place_id%5)*400 AS DOUBLE)/1e5 ELSE 0e0 END AS lon FROM outline),
 e AS (SELECT place_id, role, lat AS ay, lon AS ax, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS bty, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS bx FROM sh WINDOW w AS (PARTITION BY place_id, role ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 h AS (SELECT p.place_id, p.role, p.k, count(*) FILTER (WHERE (e.ay > p.lat) <> (e.bty > p.lat) AND p.lon < e.ax + (p.lat - e.ay) * (e.bx - e.ax) / (e.bty - e.ay)) % 2 AS inside FROM sh p JOIN e ON e.place_id=p.place_id AND e.role<>p.role GROUP BY 1,2,3)"""


@query(
    "c20_ring_homes",
    f"WITH {SHIFTED} SELECT place_id AS rel_id, min(CASE WHEN role='inner' THEN inside ELSE 1-inside END)=1 AS has_home FROM h GROUP BY place_id",
)
def _(t: Tables) -> DataFrame:
    """Holes moved to the east, some of them across or beyond their outer ring: which of them have a home."""
    lon = F.col("lon") + F.when(F.col("role") == "inner", (F.col("place_id") % 5 * 400).cast("double") / 1e5).otherwise(0.0)
    p = F.array_sort(F.collect_list(F.struct("k", "lat", lon.alias("lon"))))
    rings = t.outline.groupBy(F.col("place_id").alias("rel_id"), "role").agg(p.alias("p")).withColumn("p", F.concat("p", F.slice("p", 1, 1)))
    rings = rings.select("rel_id", "role", F.lit(0).alias("ring"), F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"), F.lit(True).alias("closed"))
    built, rejected = geometry.build_multipolygons(rings)
    return built.where(F.size("inners") > 0).select("rel_id", F.lit(True).alias("has_home")).unionByName(rejected.select("rel_id", F.lit(False).alias("has_home")))


@query(
    "i20_place_viewports",
    """WITH v AS (SELECT id, (lon+180)/360*8192e0 AS x, (1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*8192e0 AS y FROM place), b AS (SELECT id, x-1.3e0 AS x0, y-0.8e0 AS y0, x+0.9e0 AS x1, y+1.7e0 AS y1 FROM v),
 c AS (SELECT id, CAST(floor(x0) AS BIGINT)+i.range AS tx, CAST(floor(y0) AS BIGINT)+j.range AS ty, x0, y0, x1, y1 FROM b, range(6) i, range(6) j),
 d AS (SELECT id, tx, ty, abs(tx+0.5e0-(x0+x1)/2)+abs(ty+0.5e0-(y0+y1)/2) AS d FROM c WHERE tx<=floor(x1) AND ty<=floor(y1))
 SELECT id, tx AS x, ty AS y FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tx, ty) AS n FROM d) q WHERE n=1""",
)
def _(t: Tables) -> DataFrame:
    """The nearest tile of a viewport around every place."""
    x, y = geo.tile_x(F.col("lon"), 13), geo.tile_y(F.col("lat"), 13)
    first = mapobj.viewport_tiles(x - 1.3, y - 0.8, x + 0.9, y + 1.7)[0]
    return t.place.select("id", first["x"].cast("long").alias("x"), first["y"].cast("long").alias("y"))


@query("c20_inner_rings_rejected", "SELECT id AS rel_id FROM boundary")
def _(t: Tables) -> DataFrame:
    """Holes outside their outer ring come back as rejects."""
    from geoloom.operators.places import box_ring

    c = [F.col(n) for n in ("min_lat", "min_lon", "max_lat", "max_lon")]
    outer = t.boundary.select(F.col("id").alias("rel_id"), F.lit("outer").alias("role"), F.lit(0).alias("ring"), box_ring(*c).alias("p"))
    inner = t.boundary.select(F.col("id").alias("rel_id"), F.lit("inner").alias("role"), F.lit(1).alias("ring"), box_ring(*(v + 5 for v in c)).alias("p"))
    rings = outer.unionByName(inner).select("rel_id", "role", "ring", F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"), F.lit(True).alias("closed"))
    _, rejected = geometry.build_multipolygons(rings)
    return rejected.select("rel_id")


@query(
    "i4_multi_level_generalisation",
    """WITH b AS (SELECT w.way_id AS id, count(n.id) AS c FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id GROUP BY 1) SELECT y.id, z.level, CASE WHEN z.level=0 THEN 'full' ELSE 'line' END AS form FROM osm_way y JOIN b ON b.id=y.id
 JOIN (VALUES (0,22),(1,14),(2,12),(3,11)) z(level,maxzoom) ON z.maxzoom >= CASE y.highway WHEN 'motorway' THEN 11 WHEN 'primary' THEN 12 WHEN 'residential' THEN 14 ELSE 15 END""",
)
def _(t: Tables) -> DataFrame:
    """Each level's objects: full geometry at level 0, lines for generalisation at the others."""
    levels = {level: high for level, _, high in geo.parse_zooms("11;12;13-14;15-")}
    form = F.when(F.col("level") == 0, "full").otherwise("line")
    found = rules.encode_levels(_ways(t), _rules(t), levels).select("id", "level", form.alias("form"))
    return found.join(_placed(t).select("id"), "id")


@query("i4_generalised_levels")
def _(t: Tables) -> DataFrame:
    """Every level's objects with their geometry; every third way is closed."""
    v = F.struct("ord", "node_id", "lat", "lon")
    pts = t.osm_way_node.join(t.osm_node.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(v)).alias("p"))
    again = F.when((F.col("id") % 3 == 0) & (F.size("p") > 2), F.slice("p", 1, 1)).otherwise(F.slice("p", 1, 0))
    shapes = pts.select("id", F.concat("p", again).alias("p")).select("id", F.col("p.node_id").alias("node_ids"), F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"))
    return generalise.generalise(_ways(t), shapes, t.osm_node.select("id", "lat", "lon"), _rules(t))


CHAINS = """WITH RECURSIVE lines AS (SELECT w.way_id AS id, y.name, w.way_id%50 AS kind, list(w.node_id ORDER BY w.ord) AS nodes FROM osm_way_node w JOIN osm_way y ON y.id=w.way_id GROUP BY 1,2 HAVING count(*)>1),
 e AS (SELECT id, kind, nodes[len(nodes)] AS node, row_number() OVER (PARTITION BY kind, nodes[len(nodes)] ORDER BY id) AS turn FROM lines),
 s AS (SELECT id, kind, nodes[1] AS node, row_number() OVER (PARTITION BY kind, nodes[1] ORDER BY id) AS turn FROM lines),
 links AS (SELECT s.id AS node, e.id AS prev FROM e JOIN s ON s.kind=e.kind AND s.node=e.node AND s.turn=e.turn WHERE e.id<>s.id),
 walk AS (SELECT id AS head, id, 0 AS pos FROM lines WHERE id NOT IN (SELECT node FROM links) UNION ALL SELECT w.head, l.node, w.pos+1 FROM walk w JOIN links l ON l.prev=w.id),
 cyc AS (SELECT id AS a, id, id AS least, 0 AS n FROM lines WHERE id NOT IN (SELECT id FROM walk) UNION ALL SELECT c.a, l.node, least(c.least, l.node), c.n+1 FROM cyc c JOIN links l ON l.prev=c.id WHERE l.node<>c.a),
 again AS (SELECT a AS head, a AS id, 0 AS pos FROM (SELECT a, min(least) AS least FROM cyc GROUP BY a) q WHERE a=least UNION ALL SELECT w.head, l.node, w.pos+1 FROM again w JOIN links l ON l.prev=w.id WHERE l.node<>w.head),
 placed AS (SELECT * FROM walk UNION ALL SELECT * FROM again)
 SELECT any_value(l.kind) AS kind, string_agg(CAST(l.id AS VARCHAR), ',' ORDER BY p.pos) AS line_ids, any_value(f.nodes[1]) || ',' || string_agg(array_to_string(l.nodes[2:], ','), ',' ORDER BY p.pos) AS path,
 CASE WHEN count(l.name)=count(*) AND min(l.name)=max(l.name) THEN min(l.name) END AS name FROM placed p JOIN lines l ON l.id=p.id JOIN lines f ON f.id=p.head GROUP BY p.head"""


def _lines_by_class(t: Tables) -> DataFrame:
    lines = t.osm_way_node.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "node_id")))["node_id"].alias("node_ids"))
    return lines.join(t.osm_way, "id").where(F.size("node_ids") > 1).select("id", F.lit(1).alias("level"), F.array((F.col("id") % 50).cast("int")).alias("types"), "name", "node_ids")


@query("c24_line_chains", CHAINS)
def _(t: Tables) -> DataFrame:
    """The merged lines, their ids and paths as texts."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias
    made = geometry.merge_lines(_lines_by_class(t))
    return made.select(F.col("types")[0].cast("long").alias("kind"), text("line_ids")("line_ids"), text("node_ids")("path"), "name")


@query("c24_line_merging")
def _(t: Tables) -> DataFrame:
    return geometry.merge_lines(_lines_by_class(t))


def _roads(t: Tables) -> DataFrame:
    v = F.struct("ord", "node_id", "lat", "lon")
    pts = t.osm_way_node.join(t.osm_node.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(v)).alias("p"))
    return pts.join(t.osm_way, "id").select("id", F.col("highway").alias("class"), F.lit(None).cast("string").alias("ref"), "name", "oneway", F.col("p.node_id").alias("node_ids"), F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"))


@query("i11_road_chaining")
def _(t: Tables) -> DataFrame:
    return geometry.chain_roads(_roads(t).drop("oneway"))


TURNS = """q AS (SELECT w.way_id AS id, row_number() OVER (PARTITION BY w.way_id ORDER BY w.ord) AS k, w.node_id, n.lat, n.lon FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id), m AS (SELECT id, max(k) AS n FROM q GROUP BY id),
 ends AS (SELECT a.id, 0 AS side, a.node_id AS node, atan2(b.lat-a.lat, b.lon-a.lon) AS angle FROM m JOIN q a ON a.id=m.id AND a.k=1 JOIN q b ON b.id=m.id AND b.k=2
  UNION ALL SELECT a.id, 1, a.node_id, atan2(b.lat-a.lat, b.lon-a.lon) FROM m JOIN q a ON a.id=m.id AND a.k=m.n JOIN q b ON b.id=m.id AND b.k=m.n-1 WHERE m.n>1),
 en AS (SELECT ends.*, y.highway, y.name FROM ends JOIN osm_way y ON y.id=ends.id),
 met AS (SELECT a.id AS a, a.side AS sa, b.id AS b, b.side AS sb, a.angle-b.angle+pi() AS d FROM en a JOIN en b ON b.node=a.node AND b.highway=a.highway AND b.name=a.name AND b.id<>a.id),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, sa ORDER BY turn, b, sb) AS n FROM (SELECT *, abs(degrees(pi()-abs((d-floor(d/(2*pi()))*2*pi())-pi()))) AS turn FROM met) x) y WHERE n=1 AND turn<90),
 lk AS (SELECT x.a, x.b FROM best x JOIN best y ON y.a=x.b AND y.sa=x.sb AND y.b=x.a AND y.sb=x.sa),
 reach AS (SELECT id AS a, id AS b FROM m UNION SELECT r.a, l.b FROM reach r JOIN lk l ON l.a=r.b)"""


@query("i11_chain_members", f"WITH RECURSIVE {TURNS} SELECT a AS road_id, min(b) AS chain, count(*) AS n FROM reach GROUP BY a")
def _(t: Tables) -> DataFrame:
    """The chain of every road, and how many roads it has."""
    made = geometry.chain_roads(_roads(t).drop("oneway"))
    return made.select(F.explode("road_ids").alias("road_id"), "chain", F.size("road_ids").cast("long").alias("n"))


@query("i11_merged_roads")
def _(t: Tables) -> DataFrame:
    """The chains as roads: one path, common types, and the tiles of zoom 15 that they touch."""
    types = F.array_compact(F.array(F.when(F.col("oneway") == "yes", 1), F.when(F.col("id") % 3 > 0, 2), F.when(F.col("id") % 5 > 0, 3)))
    roads_ = _roads(t).withColumn("add_types", types).drop("oneway")
    return roads.merged_roads(roads_, geometry.chain_roads(roads_.drop("add_types")))


@query("i13_coastline_polygons")
def _(t: Tables) -> DataFrame:
    """A square island in every boundary box, and a coast across it."""
    c = [F.col(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat")]
    tile = F.col("id").cast("string").alias("tile")
    d = 0.01
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    island = F.array(point(c[0] + d, c[1] + d), point(c[0] + 2 * d, c[1] + d), point(c[0] + 2 * d, c[1] + 2 * d), point(c[0] + d, c[1] + 2 * d), point(c[0] + d, c[1] + d))
    coast = F.array(point(c[0] - d, c[1] + 3 * d), point(c[2] + d, c[1] + 3 * d))
    lines = t.boundary.select(tile, F.lit(0).alias("line_id"), F.posexplode(island).alias("ord", "p"))
    lines = lines.unionByName(t.boundary.where("id % 2 = 0").select(tile, F.lit(1).alias("line_id"), F.posexplode(coast).alias("ord", "p")))
    boxes = t.boundary.select(tile, *(v.alias(n) for v, n in zip(c, ("min_x", "min_y", "max_x", "max_y"), strict=True)))
    return geometry.polygonize_coast(lines.select("tile", "line_id", "ord", "p.x", "p.y"), boxes)


@query(
    "i15_ring_order",
    f"""WITH {CLOSED}, t AS (SELECT way_id, sum(x*y2-x2*y) AS turn FROM e GROUP BY way_id), o AS (SELECT c.way_id, CASE WHEN t.turn<0 THEN c.ord ELSE -c.ord END AS place, c.x, c.y FROM c JOIN t ON t.way_id=c.way_id)
 SELECT way_id AS rec_no, string_agg(concat(x, ' ', y), ',' ORDER BY place) AS points FROM o GROUP BY way_id HAVING count(*)>2""",
)
def _(t: Tables) -> DataFrame:
    """The one ring of every shape, clockwise."""
    made = geometry.rewind(_shapes(t).select("rec_no", "parts", "x", "y"))
    point = F.zip_with("x", "y", lambda a, b: F.concat_ws(" ", a.cast("long").cast("string"), b.cast("long").cast("string")))
    return made.select("rec_no", F.array_join(point, ",").alias("points"))


@query("i15_ring_winding")
def _(t: Tables) -> DataFrame:
    return geometry.rewind(_shapes(t).select("rec_no", "parts", "x", "y"))


@query(
    "i17_anchor_places",
    f"""WITH {CLOSED}, s AS (SELECT way_id, ord, x, y, x2, y2, sqrt(pow(x2-x,2)+pow(y2-y,2)) AS len FROM e), f AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY way_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM s WHERE x2 IS NOT NULL),
 m AS (SELECT f.*, unnest(range(CAST(ceil(far/250e0) AS BIGINT), CAST(ceil((far+len)/250e0) AS BIGINT))) AS i FROM f)
 SELECT way_id AS id, CAST(i-1 AS INTEGER) AS n, round(x+(i*250e0-far)/len*(x2-x), 6) AS x, round(y+(i*250e0-far)/len*(y2-y), 6) AS y, round(atan2(y2-y, x2-x), 6) AS angle,
 [0.5e0,8e0,4e0,8e0,2e0,8e0,4e0,8e0][1+(i-1)%8] AS min_scale FROM m WHERE i>0 AND len>0""",
)
def _(t: Tables) -> DataFrame:
    lines = _lines(t).select("id", F.col("pts.x").cast("array<double>").alias("xs"), F.col("pts.y").cast("array<double>").alias("ys"))
    return geometry.line_anchors(lines, 250.0).select("id", "n", *(F.round(c, 6).alias(c) for c in ("x", "y", "angle")), "min_scale")


@query("i17_line_anchors")
def _(t: Tables) -> DataFrame:
    return geometry.line_anchors(_lines(t).select("id", F.col("pts.x").cast("array<double>").alias("xs"), F.col("pts.y").cast("array<double>").alias("ys")), 250.0)


@query("i18_label_placement")
def _(t: Tables) -> DataFrame:
    labels = t.osm_node.select((F.col("id") % 40).cast("string").alias("tile"), "id", (F.col("id") % 7).alias("prio"), ((F.col("lat") - 40) * 5000).alias("x"), ((F.col("lon") + 5) * 5000).alias("y"), F.lit(60.0).alias("w"), F.lit(12.0).alias("h"))
    return geometry.place_labels(labels)


@query("i18_map_labels")
def _(t: Tables) -> DataFrame:
    """Labels of all named nodes, clear of each other across tiles."""
    named = t.osm_node.select("id", (F.col("id") % 7).alias("prio"), ((F.col("lon") + 5) * 20000).alias("x"), ((F.col("lat") - 40) * 20000).alias("y"), F.lit(60.0).alias("w"), F.lit(12.0).alias("h"))
    return labels.place_map_labels(named, 256.0)


@query("k8_coast_and_background")
def _(t: Tables) -> DataFrame:
    """The ground of every tile of zoom 15 that has a point of interest: the places' outlines are islands."""
    p = F.array_sort(F.collect_list(F.struct("k", geo.x31(F.col("lon")).alias("x"), geo.y31(F.col("lat")).alias("y"))))
    rings = t.outline.where("role = 'outer'").groupBy(F.col("place_id").alias("id")).agg(p.alias("p"))
    rings = rings.select("id", F.concat("p", F.slice("p", 1, 1)).alias("p")).select("id", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("pts"))
    tile = lambda v: F.shiftright(v, 16)
    covered = F.sequence(tile(F.array_min("pts.x")), tile(F.array_max("pts.x"))), F.sequence(tile(F.array_min("pts.y")), tile(F.array_max("pts.y")))
    spread = rings.withColumn("tx", F.explode(covered[0])).withColumn("ty", F.explode(covered[1]))
    spread = spread.select(F.concat_ws("/", "tx", "ty").alias("tile"), "id", F.array(F.struct(F.lit("natural").alias("tag"), F.lit("coastline").alias("value"))).alias("types"), "pts")
    tiles = t.poi.select(tile(geo.x31(F.col("lon"))).alias("tx"), tile(geo.y31(F.col("lat"))).alias("ty")).distinct()
    boxes = tiles.select(F.concat_ws("/", "tx", "ty").alias("tile"), *geo.tile_box31(F.col("tx"), F.col("ty"), 15))
    made = coast.coast_areas(spread.join(boxes.select("tile"), "tile", "left_semi"), boxes)
    return made.select("tile", F.col("types")[0]["value"].alias("kind"), "area", F.size("pts").alias("n_points"))


# ---- style

STYLE = """<style>
<constant name="wide" value="18"/>
<order>
 <filter tag="highway" value="motorway" objectType="2" order="60"/>
 <group objectType="2"><filter tag="highway" value="primary" order="50"/><filter tag="highway" order="40"/></group>
 <filter tag="amenity" minzoom="15" objectType="1" order="90"/>
</order>
<line>
 <filter tag="highway" value="motorway" minzoom="11" color="#ff0000"><case minzoom="15" strokeWidth="$wide"/><case maxzoom="14" strokeWidth="8"/><apply additional="oneway=yes" pathEffect="arrow"/></filter>
 <filter tag="highway" strokeWidth="2" color="#80ffffff"/>
 <filter strokeWidth="1"/>
</line>
<text><filter tag="highway" minzoom="14" textSize="12" textColor="#102030"/></text>
<point><filter tag="amenity" value="cafe" icon="cup"/></point>
</style>"""


def _style_inputs(t: Tables) -> DataFrame:
    return t.osm_way.select("id", "name", F.lit("highway").alias("tag"), F.col("highway").alias("value"), F.when(F.col("oneway").isNotNull(), F.array(F.lit("oneway=yes"))).otherwise(F.array().cast("array<string>")).alias("additional"))


@query(
    "k4_style_evaluation",
    "SELECT id, CASE WHEN highway='motorway' THEN '18' ELSE '2' END AS width, CASE WHEN highway='motorway' THEN '#ff0000' ELSE '#80ffffff' END AS color, CASE WHEN highway='motorway' AND oneway IS NOT NULL THEN 'arrow' END AS effect FROM osm_way",
)
def _(t: Tables) -> DataFrame:
    inputs = {"tag": F.col("tag"), "value": F.col("value"), "zoom": F.lit(16), "additional": F.col("additional")}
    made = style.evaluate(style.read_style(STYLE)["line"], inputs, ["strokeWidth", "color", "pathEffect"])
    return _style_inputs(t).select("id", made["strokeWidth"].alias("width"), made["color"].alias("color"), made["pathEffect"].alias("effect"))


@query("c23_style_fallback", "SELECT id, CASE WHEN highway='motorway' AND id%2=0 THEN '8' WHEN id%2=0 THEN '2' ELSE '1' END AS width FROM osm_way")
def _(t: Tables) -> DataFrame:
    tag = F.when(F.col("id") % 2 == 0, "highway").otherwise("railway")
    inputs = {"tag": tag, "value": F.col("value"), "zoom": F.lit(12), "additional": F.col("additional")}
    return _style_inputs(t).select("id", style.evaluate(style.read_style(STYLE)["line"], inputs, ["strokeWidth"])["strokeWidth"].alias("width"))


def _render_objects(t: Tables) -> DataFrame:
    typed = F.array(F.struct(F.lit("highway").alias("tag"), F.col("highway").alias("value")))
    names = F.create_map(F.lit("name"), F.col("name"))
    base = t.osm_way.select("id", (F.col("id") % 4).cast("int").alias("level"), typed.alias("types"), F.array().cast("array<string>").alias("additional"), names.alias("names"), F.lit(False).alias("area"))
    lines = _lines(t).withColumns({"minx": F.array_min("pts.x"), "maxx": F.array_max("pts.x"), "miny": F.array_min("pts.y"), "maxy": F.array_max("pts.y")})
    return base.join(lines, "id")


@query("k5_primitives", "SELECT y.id, 2 AS kind, CASE highway WHEN 'motorway' THEN 60 WHEN 'primary' THEN 50 ELSE 40 END AS z FROM osm_way y WHERE EXISTS (SELECT 1 FROM osm_way_node w WHERE w.way_id=y.id)")
def _(t: Tables) -> DataFrame:
    objects = _render_objects(t).withColumn("area_px", F.lit(0.0))
    return style.primitives(objects, style.read_style(STYLE), 15).select("id", "kind", F.col("z").cast("int").alias("z"))


@query("k6_text_labels", "SELECT y.id, y.name AS text, 12 AS size, 4279246896 AS color FROM osm_way y WHERE EXISTS (SELECT 1 FROM osm_way_node w WHERE w.way_id=y.id)")
def _(t: Tables) -> DataFrame:
    return style.text_labels(_render_objects(t), style.read_style(STYLE), 15).select("id", "text", F.col("size").cast("int").alias("size"), "color")


@query("k7_icons", "SELECT id, 'cup' AS icon, 100100 AS order_no FROM osm_node WHERE amenity='cafe'")
def _(t: Tables) -> DataFrame:
    prims = t.osm_node.where("amenity IS NOT NULL").select("id", F.lit("amenity").alias("tag"), F.col("amenity").alias("value"), F.lit(1).alias("kind"))
    return style.icon_symbols(prims, style.read_style(STYLE), 15).select("id", "icon", F.col("order").alias("order_no"))


ICONS = """<style><point><filter tag="amenity" value="cafe" icon="cup"/><filter tag="amenity" value="bank" minzoom="16" icon="coins"/><filter tag="amenity" value="pharmacy" icon="cross" iconOrder="7"/>
<filter tag="amenity" icon="dot" iconOrder="200"/></point></style>"""


@query(
    "k7_icons_by_type",
    """SELECT id, zoom, CASE amenity WHEN 'cafe' THEN 'cup' WHEN 'pharmacy' THEN 'cross' WHEN 'bank' THEN CASE WHEN zoom>=16 THEN 'coins' ELSE 'dot' END ELSE 'dot' END AS icon,
 100000 + CASE amenity WHEN 'cafe' THEN 100 WHEN 'pharmacy' THEN 7 WHEN 'bank' THEN CASE WHEN zoom>=16 THEN 100 ELSE 200 END ELSE 200 END AS order_no FROM osm_node, (SELECT CAST(range AS INTEGER) AS zoom FROM range(15,17)) z WHERE amenity IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    """Icons of all amenities at two zooms: by value, by zoom, and the fallback."""
    prims = t.osm_node.where("amenity IS NOT NULL").select("id", F.lit("amenity").alias("tag"), F.col("amenity").alias("value"), F.lit(1).alias("kind"))
    found = [style.icon_symbols(prims, style.read_style(ICONS), z).withColumn("zoom", F.lit(z)) for z in (15, 16)]
    return found[0].unionByName(found[1]).select("id", "zoom", "icon", F.col("order").alias("order_no"))


@query("k8_render_set")
def _(t: Tables) -> DataFrame:
    made = style.render_set(_render_objects(t), _levels(t), style.read_style(STYLE), (100, 100, 600, 500), 15)
    return made["primitives"]


@query("b26_layer_gate", "SELECT id%22 AS zoom, category AS source_layer, count(*) AS n FROM poi WHERE category='click' AND id%22>=5 AND id%22<14 GROUP BY 1,2")
def _(t: Tables) -> DataFrame:
    layers = t.spark.createDataFrame([("roads", "click", 5, 14)], "layer string, source_layer string, min_zoom int, max_zoom int")
    tiles = t.poi.select((F.col("id") % 22).alias("zoom"), F.col("category").alias("source_layer"))
    return style.layer_gate(tiles, layers).groupBy("zoom", "source_layer").agg(F.count("*").alias("n"))


@query("a10_style_catalogue", "SELECT n_nationkey AS id, CASE WHEN n_nationkey%2=0 THEN 60 ELSE 50 END AS z FROM nation")
def _(t: Tables) -> DataFrame:
    rows = style.rule_table(style.read_style(STYLE))
    table = t.spark.createDataFrame(rows, "rule_id int, parent_id int, class string, branch string, seq int, inputs map<string,string>, outputs map<string,string>")
    order = table.where("class = 'order'").select(F.col("inputs")["value"].alias("value"), F.col("outputs")["order"].cast("int").alias("z")).where("value IS NOT NULL")
    wanted = F.when(F.col("n_nationkey") % 2 == 0, "motorway").otherwise("primary")
    return t.nation.select(F.col("n_nationkey").alias("id"), wanted.alias("value")).join(F.broadcast(order), "value").select("id", "z")


# ---- shapes


def _shapes(t: Tables) -> DataFrame:
    """Every way of three vertices or more as a shape."""
    lines = _lines(t).where(F.size("pts") > 2)
    out = lines.select(F.col("id").alias("rec_no"), F.array(F.lit(0)).alias("parts"), F.col("pts.x").cast("array<double>").alias("x"), F.col("pts.y").cast("array<double>").alias("y"))
    return shapes.with_bounds(out)


SHAPES = f"{VERTICES}, sh AS (SELECT way_id AS rec_no, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, count(*) + CASE WHEN way_id%10=0 THEN 1 ELSE 0 END AS n FROM v GROUP BY way_id HAVING count(*) + CASE WHEN way_id%10=0 THEN 1 ELSE 0 END > 2)"
SBOX = (200.0, 100.0, 700.0, 500.0)


@query("b17_attribute_select", "SELECT id, true AS kept FROM osm_way WHERE id%7 IN (1,3) UNION ALL SELECT id, false FROM osm_way WHERE id%7 NOT IN (1,3)")
def _(t: Tables) -> DataFrame:
    coded = t.osm_way.select("id", (F.col("id") % 7).alias("code"))
    one = shapes.select_records(coded, "code", [1, 3]).select("id", F.lit(True).alias("kept"))
    return one.unionByName(shapes.select_records(coded, "code", [1, 3], keep=False).select("id", F.lit(False).alias("kept")))


@query("b18_clip_inside", f"WITH {SHAPES} SELECT rec_no FROM sh WHERE minx>=200 AND maxx<=700 AND miny>=100 AND maxy<=500")
def _(t: Tables) -> DataFrame:
    return shapes.clip(_shapes(t), SBOX, "inside").select("rec_no")


@query(
    "b18_clip_cut",
    f"""WITH {VERTICES}, c AS (SELECT way_id, x, y FROM v UNION ALL SELECT way_id, arg_min(x,ord), arg_min(y,ord) FROM v WHERE way_id%10=0 GROUP BY way_id) SELECT way_id AS rec_no, CAST(sum(CASE WHEN x BETWEEN 200 AND 700 AND y BETWEEN 100 AND 500 THEN 1 ELSE 0 END) AS INT) AS n
 FROM c GROUP BY way_id HAVING count(*)>2 AND sum(CASE WHEN x BETWEEN 200 AND 700 AND y BETWEEN 100 AND 500 THEN 1 ELSE 0 END)>=2""",
)
def _(t: Tables) -> DataFrame:
    return shapes.clip(_shapes(t), SBOX, "cut").select("rec_no", F.size("x").alias("n"))


TOUCHED = "minx<=700 AND maxx>=200 AND miny<=500 AND maxy>=100 AND ((minx>=200 AND maxx<=700 AND miny>=100 AND maxy<=500) OR (minx<=200 AND maxx>=700) OR (miny<=100 AND maxy>=500) OR rec_no IN (SELECT way_id FROM v WHERE x BETWEEN 200 AND 700 OR y BETWEEN 100 AND 500))"


@query("b18_clip_touch", f"WITH {SHAPES} SELECT rec_no FROM sh WHERE {TOUCHED}")
def _(t: Tables) -> DataFrame:
    return shapes.clip(_shapes(t), SBOX, "touch").select("rec_no")


@query("b18_erase_touch", f"WITH {SHAPES} SELECT rec_no FROM sh WHERE NOT ({TOUCHED})")
def _(t: Tables) -> DataFrame:
    return shapes.clip(_shapes(t), SBOX, "touch", erase=True).select("rec_no")


@query("b18_erase_inside", f"WITH {SHAPES} SELECT rec_no FROM sh WHERE NOT (minx>=200 AND maxx<=700 AND miny>=100 AND maxy<=500)")
def _(t: Tables) -> DataFrame:
    return shapes.clip(_shapes(t), SBOX, "inside", erase=True).select("rec_no")


@query(
    "b18_erase_cut",
    f"""WITH {VERTICES}, c AS (SELECT way_id, x, y FROM v UNION ALL SELECT way_id, arg_min(x,ord), arg_min(y,ord) FROM v WHERE way_id%10=0 GROUP BY way_id) SELECT way_id AS rec_no, CAST(sum(CASE WHEN x BETWEEN 200 AND 700 AND y BETWEEN 100 AND 500 THEN 0 ELSE 1 END) AS INT) AS n
 FROM c GROUP BY way_id HAVING count(*)>2 AND sum(CASE WHEN x BETWEEN 200 AND 700 AND y BETWEEN 100 AND 500 THEN 0 ELSE 1 END)>=2""",
)
def _(t: Tables) -> DataFrame:
    return shapes.clip(_shapes(t), SBOX, "cut", erase=True).select("rec_no", F.size("x").alias("n"))


@query("d2_extent_zm", "SELECT way_id AS rec_no, CAST(min(node_id%1000) AS DOUBLE) AS minx, CAST(max(node_id%1000) AS DOUBLE) AS maxx, CAST(min(node_id%700) AS DOUBLE) AS miny, CAST(max(node_id%700) AS DOUBLE) AS maxy, CAST(min(node_id%1000-node_id%700) AS DOUBLE) AS minz, CAST(max(node_id%1000-node_id%700) AS DOUBLE) AS maxz, CAST(min(node_id%1000+node_id%700) AS DOUBLE) AS minm, CAST(max(node_id%1000+node_id%700) AS DOUBLE) AS maxm FROM osm_way_node WHERE way_id IN (SELECT way_id FROM osm_way_node GROUP BY way_id HAVING count(*) + CASE WHEN way_id%10=0 THEN 1 ELSE 0 END > 2) GROUP BY way_id")
def _(t: Tables) -> DataFrame:
    """Shapes with a z and an m for every vertex."""
    deep = _shapes(t).withColumn("z", F.zip_with("x", "y", lambda a, b: a - b)).withColumn("m", F.zip_with("x", "y", lambda a, b: a + b))
    return shapes.with_bounds(deep).select("rec_no", *(f"{n}{c}" for c in "xyzm" for n in ("min", "max")))


@query("b19_box_predicates", f"WITH {SHAPES} SELECT rec_no, minx<=700 AND maxx>=200 AND miny<=500 AND maxy>=100 AS hit, minx>=200 AND maxx<=700 AND miny>=100 AND maxy<=500 AS held FROM sh")
def _(t: Tables) -> DataFrame:
    return _shapes(t).select("rec_no", shapes.overlaps(SBOX).alias("hit"), shapes.contained(SBOX).alias("held"))


@query("c27_shapes_with_attributes", f"WITH {SHAPES} SELECT sh.rec_no, y.highway, sh.n FROM sh JOIN osm_way y ON y.id=sh.rec_no")
def _(t: Tables) -> DataFrame:
    out = shapes.with_attributes(_shapes(t), t.osm_way.select(F.col("id").alias("rec_no"), "highway"))
    return out.select("rec_no", "highway", F.size("x").cast("long").alias("n"))


@query(
    "d17_attribute_profile",
    """SELECT 'id' AS field, CAST(min(id) AS VARCHAR) AS low, CAST(max(id) AS VARCHAR) AS high, round(avg(id),6) AS mean, count(id) AS n FROM poi UNION ALL SELECT 'category', min(lower(category)), max(lower(category)), NULL, count(category) FROM poi
 UNION ALL SELECT 'subtype', min(lower(subtype)), max(lower(subtype)), NULL, count(subtype) FROM poi""",
)
def _(t: Tables) -> DataFrame:
    out = shapes.profile(t.poi.select("id", "category", "subtype"))
    return out.withColumn("mean", F.round("mean", 6))


@query("g4_append_by_name", "SELECT id, category AS kind FROM poi WHERE category='click' UNION ALL SELECT id, NULL FROM poi WHERE category<>'click'")
def _(t: Tables) -> DataFrame:
    target = t.poi.where("category = 'click'").select("id", F.col("category").alias("kind"))
    more = t.poi.where("category <> 'click'").select(F.col("id").alias("ID"), F.length("category").alias("kind"), F.col("subtype").alias("extra"))
    return shapes.append_by_name(target, more)


#: streets of one name linked through spots within 900 m (a cell of the grid is wider than that), then the smallest label spread to the fixed point
MERGED = """WITH RECURSIVE v AS (SELECT DISTINCT w.way_id AS s, lower(y.name) AS name, n.lat, n.lon FROM osm_way_node w JOIN osm_node n ON n.id=w.node_id JOIN osm_way y ON y.id=w.way_id),
 spots AS (SELECT name, lat, lon, floor(lat/0.0082) AS cy, floor(lon/0.0108) AS cx, min(s) AS rep FROM v WHERE name IS NOT NULL GROUP BY name, lat, lon),
 beside AS (SELECT o.*, cy+dy.range-1 AS ny, cx+dx.range-1 AS nx FROM spots o, range(3) dy, range(3) dx),
 near AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM beside a JOIN spots b ON b.name=a.name AND b.cy=a.ny AND b.cx=a.nx
  WHERE a.rep<>b.rep AND 2*6372800*asin(sqrt(power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lon-a.lon)/2),2)))<=900),
 links AS (SELECT a, b FROM near UNION SELECT v.s, o.rep FROM v JOIN spots o ON o.name=v.name AND o.lat=v.lat AND o.lon=v.lon UNION SELECT o.rep, v.s FROM v JOIN spots o ON o.name=v.name AND o.lat=v.lat AND o.lon=v.lon),
 lab(node, root) USING KEY (node) AS (SELECT DISTINCT s, s FROM v UNION SELECT l.b, min(r.root) FROM lab r JOIN links l ON l.a=r.node JOIN recurring.lab c ON c.node=l.b WHERE r.root<c.root GROUP BY l.b)"""


@query("i12_street_merge", f"{MERGED} SELECT node AS street_id, root AS merged_id FROM lab")
def _(t: Tables) -> DataFrame:
    from geoloom.operators import address

    v = t.osm_way_node.join(t.osm_node.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").join(t.osm_way.select(F.col("id").alias("way_id"), "name"), "way_id")
    return address.merge_streets(v.select(F.lit(1).alias("city_id"), F.col("way_id").alias("street_id"), "name", "lat", "lon"))


@query("u1_element_callback", "SELECT id, id*2 AS twice FROM osm_way")
def _(t: Tables) -> DataFrame:
    from geoloom.operators import assembly

    def twice(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield b.assign(twice=b["id"] * 2)

    return assembly.for_each_element(t.osm_way.select("id"), twice, "id long, twice long")


@query("u2_indexers", "SELECT 'named' AS indexer, count(*) AS n FROM osm_way WHERE name IS NOT NULL UNION ALL SELECT 'oneway', count(*) FROM osm_way WHERE oneway IS NOT NULL")
def _(t: Tables) -> DataFrame:
    from geoloom.operators import assembly

    indexers = assembly.Indexers()
    indexers.register("named", lambda df: df.where("name IS NOT NULL"))
    indexers.register("oneway", lambda df: df.where("oneway IS NOT NULL"))
    done = [df.agg(F.lit(n).alias("indexer"), F.count("*").alias("n")) for n, df in indexers.run(t.osm_way).items()]
    return done[0].unionByName(done[1])


@query(
    "u2_routed_indexers",
    """SELECT 'streets' AS indexer, count(*) AS n, sum(id) AS ids FROM osm_way WHERE highway<>'footway' UNION ALL SELECT 'names', count(*), sum(length(name)) FROM osm_way WHERE name IS NOT NULL
 UNION ALL SELECT 'oneways', count(*), sum(id) FROM osm_way WHERE oneway='yes' UNION ALL SELECT 'borders', count(*), sum(id) FROM osm_way WHERE is_boundary UNION ALL SELECT 'all', count(*), sum(id) FROM osm_way""",
)
def _(t: Tables) -> DataFrame:
    """Five indexers fed by one scan and written by one job."""
    from geoloom.operators import assembly

    indexers = assembly.Indexers()
    indexers.route("streets", F.col("highway") != "footway", F.col("id"), F.col("highway"))
    indexers.route("names", F.col("name").isNotNull(), F.length("name").alias("id"), F.col("name"))
    indexers.route("oneways", F.col("oneway") == "yes", F.col("id"))
    indexers.route("borders", F.col("is_boundary"), F.col("id"), F.col("is_boundary"))
    indexers.route("all", F.lit(True), F.col("id"))
    done = indexers.write(t.osm_way, f"{shared_folder(t.spark)}/geoloom-{uuid.uuid4().hex}")
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("indexer"), F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids")) for n, df in done.items()])


@query(
    "i12_merged_buildings",
    f"""{MERGED}, b AS (SELECT coalesce(root, w.way_id) AS street_id, w.node_id AS building_id, CAST(w.ord AS VARCHAR) AS housenumber, w.way_id FROM osm_way_node w LEFT JOIN lab ON lab.node=w.way_id)
 SELECT street_id, building_id, housenumber FROM b QUALIFY row_number() OVER (PARTITION BY street_id, building_id ORDER BY way_id, housenumber)=1""",
)
def _(t: Tables) -> DataFrame:
    """Buildings of the ways they lie at, under the streets that these ways were merged into."""
    v = t.osm_way_node.join(t.osm_node.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").join(t.osm_way.select(F.col("id").alias("way_id"), "name"), "way_id")
    from geoloom.operators import address

    merged = address.merge_streets(v.select(F.lit(1).alias("city_id"), F.col("way_id").alias("street_id"), "name", "lat", "lon"))
    buildings = t.osm_way_node.select(F.col("way_id").alias("street_id"), F.col("node_id").alias("building_id"), F.col("ord").cast("string").alias("housenumber"))
    return address.rewrite_buildings(buildings, merged)


@query("c3_member_kinds", "SELECT CAST(member_id%3 AS INT) AS member_type, count(*) AS n FROM osm_relation_member GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return mixed_members(t).groupBy("member_type").agg(F.count("*").alias("n"))


# ---- sinks: written to the shared folder and read back


def _written(t: Tables, write) -> DataFrame:  # noqa: ANN001
    """What `write(path)` has written, read back."""
    path = f"{shared_folder(t.spark)}/geoloom-{uuid.uuid4().hex}"
    write(path)
    return t.spark.read.parquet(path)


@query("a14_map_sink", f"WITH {OBJECTS} SELECT id, level FROM ob WHERE {HIT} AND level=2")
def _(t: Tables) -> DataFrame:
    back = _written(t, lambda path: mapobj.write_map(_objects(t), path))
    return mapobj.map_query(back, _levels(t), BOX, 12).select("id", F.col("level").cast("long").alias("level"))


@query("a15_road_sink", "SELECT id, highway FROM osm_way WHERE highway IN ('motorway','primary','secondary')")
def _(t: Tables) -> DataFrame:
    base = F.col("highway").isin("motorway", "primary", "secondary")
    roads_ = t.osm_way.withColumn("base", base)
    back = _written(t, lambda path: roads.write_roads(roads_, path, F.col("id") % 64))
    return back.where(F.col("base").cast("boolean")).select("id", "highway")


def _tables_written(t: Tables, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(tbl, k) of every row of the tables, each given twice, written and read back; k: its key."""
    path = f"{shared_folder(t.spark)}/geoloom-{uuid.uuid4().hex}"
    mapobj.write_tables({name: (df.unionByName(df), key) for name, (df, key) in tables.items()}, path)
    key = lambda columns: F.concat_ws("/", *(F.col(c).cast("string") for c in columns))
    back = [t.spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("tbl"), key(columns).alias("k")) for name, (_, columns) in tables.items()]
    return reduce(DataFrame.unionByName, back)


@query(
    "a7_staging_sink",
    """SELECT 'node' AS tbl, CAST(id AS VARCHAR) AS k FROM osm_node UNION ALL SELECT 'way_node', concat_ws('/', way_id, ord) FROM osm_way_node
 UNION ALL SELECT 'relation_member', concat_ws('/', rel_id, ord) FROM osm_relation_member""",
)
def _(t: Tables) -> DataFrame:
    tables = {"node": (t.osm_node, ["id"]), "way_node": (t.osm_way_node, ["way_id", "ord"]), "relation_member": (t.osm_relation_member, ["rel_id", "ord"])}
    return _tables_written(t, tables)


@query(
    "a8_result_sink",
    """WITH st AS (SELECT DISTINCT id%20 AS city_id, street FROM address)
 SELECT 'map' AS tbl, CAST(id AS VARCHAR) AS k FROM osm_way UNION ALL SELECT 'low_level_map', CAST(id AS VARCHAR) FROM osm_way WHERE highway IN ('motorway','primary')
 UNION ALL SELECT 'road', CAST(id AS VARCHAR) FROM osm_way WHERE highway<>'footway' UNION ALL SELECT 'base_road', CAST(id AS VARCHAR) FROM osm_way WHERE highway IN ('motorway','primary','secondary')
 UNION ALL SELECT 'street', concat_ws('/', city_id, street) FROM st UNION ALL SELECT 'building', CAST(id AS VARCHAR) FROM address
 UNION ALL SELECT 'street_node', concat_ws('/', name, node_id) FROM (SELECT DISTINCT y.name, w.node_id FROM osm_way y JOIN osm_way_node w ON w.way_id=y.id) q
 UNION ALL SELECT 'city', CAST(id AS VARCHAR) FROM place UNION ALL SELECT 'poi', concat_ws('/', id, category, subtype) FROM poi""",
)
def _(t: Tables) -> DataFrame:
    ways, kind = t.osm_way, F.col("highway")
    vertices = t.osm_way.select(F.col("id").alias("way_id"), "name").join(t.osm_way_node, "way_id").select("name", "node_id")
    return _tables_written(t, {
        "map": (ways, ["id"]), "low_level_map": (ways.where(kind.isin("motorway", "primary")), ["id"]),
        "road": (ways.where(kind != "footway"), ["id"]), "base_road": (ways.where(kind.isin("motorway", "primary", "secondary")), ["id"]),
        "street": (t.address.select((F.col("id") % 20).alias("city_id"), "street"), ["city_id", "street"]), "building": (t.address, ["id"]),
        "street_node": (vertices, ["name", "node_id"]), "city": (t.place, ["id"]), "poi": (t.poi, ["id", "category", "subtype"]),
    })


@query("f6_type_order", "SELECT id, concat(least(id%5,id%7), ',', greatest(id%5,id%7)) AS types FROM osm_way")
def _(t: Tables) -> DataFrame:
    types = F.array_sort(F.array(F.col("id") % 7, F.col("id") % 5))
    return t.osm_way.select("id", F.array_join(types.cast("array<string>"), ",").alias("types"))


@query("i7_point_in_ring", "SELECT p.id, p.lat >= 40.05e0 AND p.lat < 40.15e0 AND p.lon >= -4.95e0 AND p.lon < -4.85e0 AS inside FROM poi p")
def _(t: Tables) -> DataFrame:
    from geoloom.operators.places import box_ring, in_ring

    ring = box_ring(*map(F.lit, (40.05, -4.95, 40.15, -4.85)))
    return t.poi.select("id", in_ring(ring, F.col("lat"), F.col("lon")).alias("inside"))


@query("i20_nearest_tile", "SELECT id, id AS x, id AS y FROM boundary")
def _(t: Tables) -> DataFrame:
    i = F.col("id").cast("double")
    first = mapobj.viewport_tiles(i, i, i + 1.2, i + 1.2)[0]
    return t.boundary.select("id", first["x"].alias("x"), first["y"].alias("y"))
