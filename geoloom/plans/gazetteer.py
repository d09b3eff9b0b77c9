"""Queries: places, boundaries, addresses, points of interest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import distance_m, rounded
from geoloom.operators import address, containment, phases, places, poi

from .registry import Tables, query
from .staging import HAVERSINE

PLACES = """pl AS (SELECT id, name, lat, lon, CASE WHEN capital THEN 'CITY' ELSE upper(place) END AS kind, CASE WHEN capital OR place IN ('city','town') THEN 'city' ELSE 'town' END AS grid FROM place WHERE place<>'locality')"""
TILE = "CAST(floor((({lon})+180)/360*{n}e0) AS BIGINT) AS tx, CAST(floor((1-ln(tan(radians({lat}))+1/cos(radians({lat})))/pi())/2*{n}e0) AS BIGINT) AS ty"
DIST = HAVERSINE.format(a="a.lat", b="b.lat", c="a.lon", d="b.lon")


@query("b4_place_extraction", f"WITH {PLACES} SELECT * FROM pl")
def _(t: Tables) -> DataFrame:
    return places.extract_places(t.place)


@query("b10_poi_search", "SELECT id, category, subtype FROM poi WHERE lat BETWEEN 40.05e0 AND 40.15e0 AND lon BETWEEN -4.95e0 AND -4.85e0 AND (category='click' OR (category='view' AND subtype='view_3'))")
def _(t: Tables) -> DataFrame:
    return poi.search(t.poi, (40.05, -4.95, 40.15, -4.85), [("click", None), ("view", "view_3")]).select("id", "category", "subtype")


@query(
    "b10_poi_search_one_per_tile",
    f"WITH s AS (SELECT id, {TILE.format(lon='lon', lat='lat', n=16384)} FROM poi WHERE category='click') SELECT tx, ty, min(id) AS id FROM s GROUP BY tx, ty",
)
def _(t: Tables) -> DataFrame:
    found = poi.search(t.poi, (39.0, -6.0, 41.0, -4.0), [("click", None)], one_per_tile_zoom=14)
    return found.select(F.col("tx"), F.col("ty"), "id") if "tx" in found.columns else poi.with_tile(found, 14).select("tx", "ty", "id")


@query(
    "b7_private_leisure",
    "WITH p AS (SELECT *, id%4000 AS obj, count(*) OVER (PARTITION BY id%4000) AS n FROM poi) SELECT id, category FROM p WHERE NOT (category='click' AND (user_private OR n>3)) AND id%50<>0".replace(
        "user_private", "id%3=0"
    ),
)
def _(t: Tables) -> DataFrame:
    p = t.poi.withColumn("obj", F.col("id") % 4000).withColumn("access", F.when(F.col("id") % 3 == 0, "private"))
    p = p.withColumn("category", F.when(F.col("category") == "click", "leisure").otherwise(F.col("category")))
    p = p.withColumn("lat", F.when(F.col("id") % 50 != 0, F.col("lat")))
    kept = poi.drop_private_leisure(p)
    return kept.select("id", F.when(F.col("category") == "leisure", "click").otherwise(F.col("category")).alias("category"))


@query(
    "d5_tile_pyramid",
    f"""WITH s AS (SELECT {TILE.format(lon='lon', lat='lat', n=65536)}, concat(category,'/',subtype) AS k FROM poi), z AS (SELECT CAST(range AS INT) AS zoom FROM range(6,17))
 SELECT zoom, tx>>(16-zoom) AS tx, ty>>(16-zoom) AS ty, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds FROM s, z GROUP BY 1,2,3""",
)
def _(t: Tables) -> DataFrame:
    return poi.tile_pyramid(t.poi).withColumn("kinds", F.array_join("kinds", ","))


@query(
    "d6_pyramid_root",
    f"""WITH s AS (SELECT {TILE.format(lon='lon', lat='lat', n=65536)} FROM poi), z AS (SELECT CAST(range AS INT) AS zoom FROM range(6,17)),
 c AS (SELECT zoom, count(DISTINCT ((tx>>(16-zoom))*65536 + (ty>>(16-zoom)))) AS tiles FROM s, z GROUP BY zoom) SELECT coalesce(max(zoom),6) AS zoom FROM c WHERE tiles<=8""",
)
def _(t: Tables) -> DataFrame:
    return poi.pyramid_root(poi.tile_pyramid(t.poi))


@query(
    "d7_category_dictionary",
    """WITH k AS (SELECT DISTINCT category, subtype FROM poi), n AS (SELECT category, subtype, CAST(dense_rank() OVER (ORDER BY category)-1 AS INT) AS category_id, CAST(row_number() OVER (PARTITION BY category ORDER BY subtype)-1 AS INT) AS subtype_id FROM k)
 SELECT *, CAST(subtype_id*128+category_id AS INT) AS packed FROM n""",
)
def _(t: Tables) -> DataFrame:
    return poi.category_dictionary(t.poi)


@query(
    "d8_attribute_dictionary",
    """WITH r AS (SELECT DISTINCT category AS tag, subtype AS value, CASE WHEN category='click' THEN 'text' ELSE 'additional' END AS kind FROM poi), r2 AS (SELECT DISTINCT tag, CASE WHEN kind='text' THEN '' ELSE value END AS value, kind FROM r),
 n AS (SELECT tag, kind, value, CAST(dense_rank() OVER (ORDER BY tag, kind)-1 AS INT) AS c, CASE WHEN kind='text' THEN 0 ELSE CAST(row_number() OVER (PARTITION BY tag, kind ORDER BY value)-1 AS INT) END AS v FROM r2)
 SELECT tag, kind, value, c, v, CASE WHEN c>31 THEN v*65536+c*2+1 ELSE v*64+c*2 END AS packed FROM n""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("category") == "click", "text").otherwise("additional")
    rules = t.poi.select(F.col("category").alias("tag"), F.when(kind == "text", "").otherwise(F.col("subtype")).alias("value"), kind.alias("kind")).distinct()
    return poi.attribute_dictionary(rules)


@query(
    "a17_tile_offsets",
    """WITH s AS (SELECT id, CAST(floor((lon+180)/360*2147483648e0) AS BIGINT) AS x, CAST(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*2147483648e0) AS BIGINT) AS y FROM poi)
 SELECT id, x>>15 AS tx, y>>15 AS ty, (x>>7)-((x>>15)<<8) AS dx, (y>>7)-((y>>15)<<8) AS dy FROM s""",
)
def _(t: Tables) -> DataFrame:
    return poi.tile_offsets(t.poi, 16)


@query(
    "k1_poi_name_index",
    f"""WITH s AS (SELECT name, {TILE.format(lon='lon', lat='lat', n=65536)} FROM osm_node WHERE name IS NOT NULL) SELECT DISTINCT substr(w,1,4) AS prefix, CAST(tx*65536+ty AS BIGINT) AS tile FROM (SELECT unnest(string_split_regex(lower(name), '[^a-z0-9'']+')) AS w, tx, ty FROM s) q WHERE w<>''""",
)
def _(t: Tables) -> DataFrame:
    return poi.name_index(t.osm_node)


IN_BOX = "p.lat BETWEEN b.min_lat AND b.max_lat AND p.lon BETWEEN b.min_lon AND b.max_lon"


@query("c8_point_in_polygon", f"SELECT p.id, b.id AS b_id FROM place p JOIN boundary b ON p.lat >= b.min_lat AND p.lat < b.max_lat AND p.lon >= b.min_lon AND p.lon < b.max_lon WHERE NOT (p.lat >= b.min_lat+0.01e0 AND p.lat < b.max_lat-0.01e0 AND p.lon >= b.min_lon+0.01e0 AND p.lon < b.max_lon-0.01e0)")
def _(t: Tables) -> DataFrame:
    """Boundaries with a hole: the same box shrunk by 0.01 degrees. Lower edges are inside."""
    b, d = t.boundary, 0.01
    c = [F.col(n) for n in ("min_lat", "min_lon", "max_lat", "max_lon")]
    rings = b.withColumn("outer", F.array(places.box_ring(*c))).withColumn("inner", F.array(places.box_ring(c[0] + d, c[1] + d, c[2] - d, c[3] - d)))
    return places.points_in_polygons(t.place.select("id", "lat", "lon"), rings).select("id", "b_id")


def outline_rings(t: Tables) -> DataFrame:
    """The outlines of all places as relations: rings cut into four ways, every second one backwards."""
    k, base = F.col("k"), F.col("place_id") * 100 + F.when(F.col("role") == "inner", 50).otherwise(0)
    nodes = t.outline.select((base + k).alias("id"), "lat", "lon")
    part = t.outline.where("k % 6 = 0").withColumn("ids", F.transform(F.sequence(k, k + 6), lambda v: base + v % 24))
    ways = part.select(
        F.col("place_id").alias("rel_id"), "role", F.pmod(k * 7, F.lit(4)).cast("int").alias("ord"),
        F.when(k % 12 == 6, F.reverse("ids")).otherwise(F.col("ids")).alias("node_ids"),
    )
    return containment.boundary_rings(ways, nodes)


OUTLINE_EDGES = """e AS (SELECT place_id, role, lat AS ay, lon AS ax, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS bty, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS bx FROM outline WINDOW w AS (PARTITION BY place_id, role ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
IN_OUTLINE = """SELECT p.id, e.place_id, e.role FROM {points} p JOIN e ON (e.ay > p.lat) <> (e.bty > p.lat) AND p.lon < e.ax + (p.lat - e.ay) * (e.bx - e.ax) / (e.bty - e.ay) GROUP BY p.id, e.place_id, e.role HAVING count(*) % 2 = 1"""


@query(
    "c8_points_in_rings",
    f"WITH {OUTLINE_EDGES}, i AS ({IN_OUTLINE.format(points='poi')}) SELECT id, place_id AS b_id FROM i WHERE role = 'outer' AND (id, place_id) NOT IN (SELECT (id, place_id) FROM i WHERE role = 'inner')",
)
def _(t: Tables) -> DataFrame:
    """All points against outlines of several ways with holes, from I5's rings."""
    return containment.points_in_rings(t.poi, outline_rings(t), placed=False)


@query("c8_points_per_boundary", f"SELECT b.id AS b_id, COUNT(*) AS n FROM boundary b JOIN poi p ON {IN_BOX} GROUP BY b.id")
def _(t: Tables) -> DataFrame:
    return places.points_in_boxes(t.poi.select("id", "lat", "lon"), t.boundary).groupBy("b_id").agg(F.count("*").alias("n"))


def _cities(t: Tables) -> DataFrame:
    return places.extract_places(t.place)


def _inside(t: Tables) -> DataFrame:
    return places.points_in_boxes(_cities(t), t.boundary).select("b_id", F.col("id").alias("city_id"), F.col("name").alias("city_name"), "kind", F.col("b_name"), F.col("b_admin_level").alias("level"))


@query(
    "c9_boundary_city_match",
    f"""WITH {PLACES}, i AS (SELECT b.id AS b_id, p.id AS city_id, CASE WHEN b.id%2=0 THEN 'x '||p.name ELSE 'none' END AS bn, p.name FROM boundary b JOIN pl p ON {IN_BOX}),
 c AS (SELECT b_id, city_id, 3 AS rank FROM i WHERE contains(lower(bn), lower(name)) UNION ALL SELECT id, id, 1 FROM boundary WHERE id%5=0)
 SELECT b_id, city_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY rank, city_id) AS n FROM c) q WHERE n=1""",
)
def _(t: Tables) -> DataFrame:
    inside = _inside(t)
    # every second boundary is named after one of the places inside it
    first = inside.where("b_id % 2 = 0").groupBy("b_id").agg(F.min("city_id").alias("k"))
    named = t.boundary.select("id").join(first, F.col("id") == F.col("b_id"), "left").join(t.place.select(F.col("id").alias("k"), "name"), "k", "left")
    boundaries = named.select("id", F.coalesce(F.concat(F.lit("x "), "name"), F.lit("none")).alias("name"))
    centres = t.boundary.where("id % 5 = 0").select(F.col("id").alias("b_id"), F.col("id").alias("city_id"))
    return places.match_boundaries(boundaries, inside.select("b_id", "city_id", "city_name"), centres)


@query(
    "c9_missing_cities",
    "SELECT -id-1 AS id, name, upper(CASE id%4 WHEN 0 THEN 'town' WHEN 1 THEN 'city' WHEN 2 THEN 'suburb' ELSE 'village' END) AS kind, id AS boundary_id FROM boundary WHERE id%4<>1 AND id%5<>0",
)
def _(t: Tables) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("town", "city", "suburb", "village"))), (F.col("id") % 4).cast("int"))
    matches = t.boundary.where("id % 5 = 0").select(F.col("id").alias("b_id"))
    return places.missing_cities(t.boundary.withColumn("place", kind), matches)


@query(
    "c10_free_cities",
    f"""WITH {PLACES}, i AS (SELECT p.id AS city_id, b.id AS b_id, b.admin_level AS level FROM boundary b JOIN pl p ON {IN_BOX} WHERE p.kind IN ('CITY','TOWN') AND p.id%3<>0 AND b.admin_level>=7)
 SELECT city_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY level DESC, b_id) AS n FROM i) q WHERE n=1""",
)
def _(t: Tables) -> DataFrame:
    cities = _cities(t)
    taken = cities.where("id % 3 = 0").select(F.col("id").alias("city_id"))
    return places.free_city_boundaries(cities, taken, _inside(t).select("city_id", "b_id", "level"))


NEAR = f"""{PLACES}, o AS (SELECT id, lat, lon, kind, {TILE.format(lon='lon', lat='lat', n=8192)} FROM pl), p AS (SELECT id, lat, lon, {TILE.format(lon='lon', lat='lat', n=8192)} FROM address),
 x AS (SELECT p.id AS p_id, o.id AS o_id, p.lat, p.lon, o.lat AS o_lat, o.lon AS o_lon, o.kind, greatest(abs(p.tx-o.tx), abs(p.ty-o.ty)) AS apart FROM p CROSS JOIN o),
 g AS (SELECT p_id, CAST(3*pow(2, greatest(0, ceil(log2(greatest(min(apart), 1)/3e0)))) AS BIGINT) AS ring FROM x GROUP BY p_id), c AS (SELECT x.*, g.ring FROM x JOIN g USING (p_id) WHERE apart<=ring)"""
CAND_DIST = HAVERSINE.format(a="lat", b="o_lat", c="lon", d="o_lon")


def _candidates(t: Tables) -> DataFrame:
    return places.closest_candidates(t.address, _cities(t), places.TOWN_ZOOM, of_objects=("kind",), nested=True)


@query("c11_nearest_candidates", f"WITH {NEAR} SELECT p_id, o_id, CAST(ring AS INT) AS ring FROM c")
def _(t: Tables) -> DataFrame:
    return places.candidate_pairs(_candidates(t))


@query("c11_nearest_city", f"WITH {NEAR}, d AS (SELECT p_id, o_id, {CAND_DIST} AS m FROM c) SELECT p_id, arg_min(o_id, m) AS o_id, round(min(m), 3) AS m FROM d GROUP BY p_id")
def _(t: Tables) -> DataFrame:
    return places.nearest_object(t.address, _cities(t)).select("p_id", "o_id", F.round("m", 3).alias("m"))


RADIUS = "CASE kind WHEN 'CITY' THEN 10000e0 WHEN 'TOWN' THEN 5000e0 WHEN 'VILLAGE' THEN 1300e0 WHEN 'HAMLET' THEN 1000e0 ELSE 400e0 END"


@query("f3_relative_distance", f"WITH {NEAR}, d AS (SELECT p_id, o_id, {CAND_DIST}/{RADIUS} AS rel FROM c) SELECT p_id, o_id, round(rel, 6) AS rel, row_number() OVER (PARTITION BY p_id ORDER BY rel, o_id) AS rank FROM d")
def _(t: Tables) -> DataFrame:
    return places.relative_order(_candidates(t)).select("p_id", "o_id", rounded("rel", 6).alias("rel"), "rank")


@query(
    "c12_street_to_cities",
    f"""WITH {NEAR}, d AS (SELECT p_id, o_id, {CAND_DIST}/{RADIUS} AS rel, (p_id+o_id)%9=0 AS contains, o_id%2=0 AS has_boundary, (p_id+o_id)%11=0 AS named FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY rel, o_id) AS rank, max(CASE WHEN contains OR named THEN 1 ELSE 0 END) OVER (PARTITION BY p_id)=1 AS some_taken FROM d),
 k AS (SELECT *, contains OR named OR (rel<=0.2e0 AND (NOT has_boundary OR NOT some_taken)) AS taken FROM r), a AS (SELECT *, max(CASE WHEN taken THEN 1 ELSE 0 END) OVER (PARTITION BY p_id)=1 AS any_taken FROM k)
 SELECT p_id, o_id FROM a WHERE taken OR (NOT any_taken AND rank=1)""",
)
def _(t: Tables) -> DataFrame:
    def flags(objects: pa.StructArray) -> Callable[[pa.StructArray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """contains where the ids' sum can be divided by 9, named where by 11."""
        o = objects.field("o_id").to_numpy(zero_copy_only=False)
        rest, even = {n: np.mod(-o, n).astype("int8") for n in (9, 11)}, o % 2 == 0

        def of(points: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p = points.field("p_id").to_numpy(zero_copy_only=False)
            return *(np.mod(p, n).astype("int8")[:, None] == rest[n] for n in (9, 11)), even

        return of

    return places.streets_to_cities(_candidates(t), flags=flags)


@query(
    "c13_city_part",
    f"""WITH {PLACES}, a AS (SELECT id AS p_id, id%25 AS b_id, lat, lon FROM address), s AS (SELECT p_id, max_by(concat('Sub ',p_id%3), p_id) AS sub FROM a WHERE p_id%4=0 GROUP BY p_id),
 n AS (SELECT a.p_id, p.name AS place, {HAVERSINE.format(a="a.lat", b="p.lat", c="a.lon", d="p.lon")} AS m, {RADIUS} AS r FROM a JOIN pl p ON p.id%25=a.b_id), b AS (SELECT p_id, arg_min(place, m) AS place FROM n WHERE m<=1.5e0*r GROUP BY p_id)
 SELECT a.p_id, coalesce(s.sub, b.place, y.name) AS part FROM a LEFT JOIN s USING (p_id) LEFT JOIN b USING (p_id) LEFT JOIN boundary y ON y.id=a.b_id""",
)
def _(t: Tables) -> DataFrame:
    points = t.address.select(F.col("id").alias("p_id"), (F.col("id") % 25).alias("b_id"), "lat", "lon")
    sub = points.where("p_id % 4 = 0").select("p_id", F.concat(F.lit("Sub "), (F.col("p_id") % 3).cast("string")).alias("name"), F.lit(9).alias("level"))
    own = _cities(t).select((F.col("id") % 25).alias("b_id"), "name", "kind", "lat", "lon")
    return places.city_parts(points, sub, own, t.boundary.select(F.col("id").alias("b_id"), F.col("name").alias("b_name")))


@query("c14_suburb_in_city", f"WITH {PLACES}, s AS (SELECT id, lower(concat('x, ', c_name)) AS is_in FROM (SELECT a.id, p.name AS c_name FROM address a JOIN place p ON p.id=a.id%(SELECT count(*) FROM place)) q) SELECT DISTINCT s.id AS suburb_id, p.id AS city_id FROM s JOIN pl p ON contains(s.is_in, lower(p.name))")
def _(t: Tables) -> DataFrame:
    named = t.address.join(t.place.select(F.col("id").alias("k"), F.col("name").alias("c_name")), F.col("k") == F.col("id") % t.place.count())
    return places.suburbs_of_cities(named.select("id", F.concat(F.lit("X, "), "c_name").alias("is_in")), _cities(t))


@query(
    "c17_unvisited_boundary_ways",
    """SELECT y.id FROM osm_way y WHERE y.is_boundary AND y.id NOT IN (SELECT m.member_id FROM osm_relation_member m JOIN osm_relation r ON r.id=m.rel_id AND r.rel_type='boundary' JOIN osm_way w ON w.id=m.member_id WHERE m.role='outer' AND (w.id%2=0 OR w.name=r.name))""",
)
def _(t: Tables) -> DataFrame:
    ways = t.osm_way.where("is_boundary").select("id", F.when(F.col("id") % 2 != 0, F.col("name")).alias("name"))
    return places.visited_boundary_ways(ways, t.osm_relation_member, t.osm_relation).select("id")


SCORE_RANK = "CASE level WHEN 8 THEN 1 WHEN 7 THEN 2 WHEN 6 THEN 3 WHEN 9 THEN 4 WHEN 10 THEN 5 ELSE 6 END"


@query(
    "e1_best_boundary",
    f"""WITH {PLACES}, i AS (SELECT p.id AS city_id, b.id AS b_id, b.admin_level AS level, b.name AS b_name, (p.id+b.id)%3=0 AS ne, b.id%2=0 AS hp, b.id%5<3 AS hc FROM boundary b JOIN pl p ON {IN_BOX}),
 s AS (SELECT *, CASE WHEN ne AND hp THEN 0 WHEN ne AND hc THEN {SCORE_RANK} WHEN ne THEN 10+{SCORE_RANK} WHEN hc THEN 20+{SCORE_RANK} ELSE 30+{SCORE_RANK} END AS score FROM i)
 SELECT city_id, CAST(b_id AS VARCHAR) AS boundary_ids, score FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY score, b_id) AS n FROM s) q WHERE n=1""",
)
def _(t: Tables) -> DataFrame:
    i, b = F.col("city_id"), F.col("b_id")
    pairs = _inside(t).withColumns({"name_equal": (i + b) % 3 == 0, "has_place": b % 2 == 0, "has_centre": b % 5 < 3})
    return places.best_boundaries(pairs).select("city_id", F.array_join(F.col("boundary_ids").cast("array<string>"), ",").alias("boundary_ids"), "score")


@query("b21_valid_boundary", "SELECT id FROM boundary WHERE admin_level>4 AND id%3<>0")
def _(t: Tables) -> DataFrame:
    centre = F.when(F.col("id") % 3 != 0, F.col("id"))
    return t.boundary.where(places.valid_boundary(F.col("admin_level"), centre, F.col("name"))).select("id")


@query("b25_boundary_relations", "SELECT id FROM osm_relation WHERE rel_type='boundary' OR id%7=0")
def _(t: Tables) -> DataFrame:
    tagged = t.osm_relation.withColumn("tags", F.when(F.col("rel_type") == "boundary", F.create_map(F.lit("boundary"), F.lit("administrative"))).when(F.col("id") % 7 == 0, F.create_map(F.lit("place"), F.lit("town"))).otherwise(F.create_map(F.lit("type"), "rel_type")))
    return places.boundary_relations(tagged).select("id")


@query("b24_multipolygon_relations", "SELECT id FROM osm_relation WHERE rel_type='multipolygon' AND id%3<>0")
def _(t: Tables) -> DataFrame:
    relations = t.osm_relation.withColumn("admin_level", F.when(F.col("id") % 3 == 0, "8")).withColumn("types", F.array(F.lit(1)))
    return places.multipolygon_relations(relations).select("id")


# ---- addresses

STREETS = """st AS (SELECT city_id, part, name, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM (SELECT id%20 AS city_id, CASE WHEN id%3=0 THEN concat('Part ',id%2) ELSE '' END AS part, street AS name, lat, lon, id FROM address) q GROUP BY city_id, part, name)"""


def _found(t: Tables) -> DataFrame:
    part = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Part "), (F.col("id") % 2).cast("string")))
    return t.address.select((F.col("id") % 20).alias("city_id"), part.alias("part"), F.col("street").alias("name"), "lat", "lon", F.col("id").alias("ord"), "id", "housenumber", "postcode")


@query("c19_street_get_or_create", f"WITH {STREETS} SELECT * FROM st")
def _(t: Tables) -> DataFrame:
    return address.get_or_create_streets(_found(t)).drop("street_id")


def _buildings(t: Tables) -> DataFrame:
    found = _found(t).withColumn("part", F.coalesce("part", F.lit("")))
    return found.select(F.xxhash64("city_id", "part", "name").alias("street_id"), F.col("id").alias("building_id"), "housenumber")


@query(
    "c5_gazetteer",
    f"""WITH {STREETS}, b AS (SELECT id, id%20 AS city_id, CASE WHEN id%3=0 THEN concat('Part ',id%2) ELSE '' END AS part, street AS name, housenumber FROM address WHERE id%7<>0)
 SELECT st.city_id, st.name AS street, st.part='Part 1' AS main, b.id AS building_id, b.housenumber FROM st LEFT JOIN b ON b.city_id=st.city_id AND b.part=st.part AND b.name=st.name WHERE st.city_id IN (SELECT id FROM place)""",
)
def _(t: Tables) -> DataFrame:
    cities = t.place.select("id", F.lit("Part 1").alias("name")).where("id < 20")
    return address.gazetteer(address.get_or_create_streets(_found(t)), _buildings(t).where("building_id % 7 <> 0"), cities).drop("street_id")


@query("c6_street_vertices", "SELECT DISTINCT y.name AS street_id, w.node_id FROM osm_way y JOIN osm_way_node w ON w.way_id=y.id")
def _(t: Tables) -> DataFrame:
    return address.street_vertices(t.osm_way.select(F.col("name").alias("street_id"), F.col("id").alias("way_id")), t.osm_way_node)


@query("c18_new_buildings", "SELECT id, id%3=0 AS stored FROM address")
def _(t: Tables) -> DataFrame:
    stored = t.address.where("id % 3 = 0")
    new = address.new_only(t.address, stored, "id").select("id", F.lit(False).alias("stored"))
    return new.unionByName(address.already_stored(t.address, stored, "id").select("id", F.lit(True).alias("stored")))


@query(
    "c21_street_intersections",
    """WITH v AS (SELECT DISTINCT y.id%3 AS city_id, y.name AS street_id, w.node_id FROM osm_way y JOIN osm_way_node w ON w.way_id=y.id)
 SELECT a.street_id, b.street_id AS other_id, min(a.node_id) AS node_id FROM v a JOIN v b ON a.city_id=b.city_id AND a.node_id=b.node_id AND a.street_id<>b.street_id GROUP BY 1,2""",
)
def _(t: Tables) -> DataFrame:
    v = t.osm_way.select((F.col("id") % 3).alias("city_id"), F.col("name").alias("street_id"), F.col("id").alias("way_id")).join(t.osm_way_node, "way_id")
    return address.intersections(v.select("city_id", "street_id", "node_id"))


@query(
    "e6_interpolation_pairs",
    """WITH v AS (SELECT w.way_id, w.ord, w.node_id AS id FROM osm_way_node w WHERE w.way_id%4=0 AND w.node_id%3<>0), l AS (SELECT *, lag(id) OVER (PARTITION BY way_id ORDER BY ord) AS from_id FROM v)
 SELECT way_id, from_id, id AS to_id, 'even' AS interpolation FROM l WHERE from_id IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    v = t.osm_way_node.select("way_id", "ord", F.col("node_id").alias("id"), F.when(F.col("node_id") % 3 != 0, "1").alias("housenumber"), F.lit("s").alias("street"), F.when(F.col("way_id") % 4 == 0, "even").alias("interpolation"))
    return address.interpolation_pairs(v)


@query(
    "c26_associated_streets",
    """WITH m AS (SELECT rel_id, ord, member_id, CASE role WHEN 'from' THEN 'street' WHEN 'to' THEN 'address' ELSE 'house' END AS role FROM osm_relation_member),
 n AS (SELECT m.rel_id, arg_min(y.name, m.ord) AS street FROM m JOIN osm_way y ON y.id=m.member_id WHERE role='street' AND y.id%2=0 GROUP BY m.rel_id)
 SELECT r.id AS rel_id, coalesce(n.street, r.name) AS street, m.member_id AS building_id, CASE WHEN m.member_id%5=0 THEN 'Hall' ELSE CAST(m.member_id%90 AS VARCHAR) END AS number
 FROM osm_relation r JOIN m ON m.rel_id=r.id AND m.role IN ('house','address') LEFT JOIN n ON n.rel_id=r.id WHERE r.rel_type='associatedStreet' AND m.member_id%10<>1""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("member_id")
    role = F.when(F.col("role") == "from", "street").when(F.col("role") == "to", "address").otherwise("house")
    members = t.osm_relation_member.select("rel_id", "ord", "member_id", role.alias("role"), F.when(k % 5 == 0, "Hall").alias("housename"), (k % 90).cast("string").alias("housenumber"))
    ways = t.osm_way.select("id", F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"))
    known = t.osm_way.where("id % 10 = 1").select(F.col("id").alias("building_id"))
    return address.associated_streets(members, t.osm_relation, ways, known)


@query("d10_postcode_rollup", "SELECT upper(postcode) AS postcode, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon, string_agg(DISTINCT street, ',' ORDER BY street) AS streets, count(*) AS n_buildings FROM address GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return address.postcode_rollup(t.address).withColumn("streets", F.array_join("streets", ","))


@query("d11_city_groups", f"WITH {PLACES} SELECT CASE WHEN kind IN ('CITY','TOWN') THEN 'city' WHEN kind='SUBURB' AND id%2=0 THEN 'suburb' ELSE 'other' END AS block, count(*) AS n FROM pl GROUP BY 1")
def _(t: Tables) -> DataFrame:
    cities = _cities(t).withColumn("is_in", F.when(F.col("id") % 2 == 0, "somewhere"))
    return address.city_groups(cities).groupBy("block").agg(F.count("*").alias("n"))


@query("d12_distinct_buildings", "SELECT DISTINCT street AS street_id, id%100 AS building_id FROM address")
def _(t: Tables) -> DataFrame:
    return address.distinct_buildings(t.address.select(F.col("street").alias("street_id"), (F.col("id") % 100).alias("building_id")))


@query("f5_gazetteer_order", "SELECT city_id, street, id, row_number() OVER (PARTITION BY city_id ORDER BY street, id) AS n FROM (SELECT id%20 AS city_id, street, id FROM address) q")
def _(t: Tables) -> DataFrame:
    a = t.address.select((F.col("id") % 20).alias("city_id"), "street", "id")
    return a.withColumn("n", F.row_number().over(Window.partitionBy("city_id").orderBy("street", "id")))


@query("g2_candidate_union", f"WITH {PLACES} SELECT id, grid FROM pl WHERE grid='city' UNION ALL SELECT id, grid FROM pl WHERE grid='town'")
def _(t: Tables) -> DataFrame:
    c = _cities(t).select("id", "grid")
    return places.candidate_union(c.where("grid = 'city'"), c.where("grid = 'town'"))


@query("g3_corner_difference", "SELECT id, CASE WHEN id%2=0 THEN '3,4' ELSE '4' END AS streets FROM address")
def _(t: Tables) -> DataFrame:
    first = F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3)))
    return t.address.select("id", F.array_join(address.corner_streets(first, F.array(F.lit(3), F.lit(4), F.lit(2))).cast("array<string>"), ",").alias("streets"))


PREFIXES = "unnest(string_split_regex(lower(name), '[^a-z0-9'']+'))"
INDEX = f"""{PLACES}, n AS (SELECT CASE WHEN kind IN ('CITY','TOWN') THEN 1 ELSE 3 END AS kind, CAST(id AS VARCHAR) AS obj_id, name FROM pl UNION ALL SELECT DISTINCT 2, upper(postcode), upper(postcode) FROM address UNION ALL SELECT DISTINCT 4, street, street FROM address),
 w AS (SELECT kind, obj_id, name, {PREFIXES} AS w FROM n), x AS (SELECT DISTINCT substr(w,1,4) AS prefix, kind, obj_id, name FROM w WHERE w<>'')"""


def _index(t: Tables) -> DataFrame:
    streets = t.address.select(F.col("street").alias("street_id"), F.lit(None).cast("bigint").alias("city_id"), F.col("street").alias("name")).distinct()
    return address.address_index(_cities(t), streets, address.postcode_rollup(t.address))


@query("k2_address_index", f"WITH {INDEX} SELECT prefix, kind, obj_id FROM x")
def _(t: Tables) -> DataFrame:
    return _index(t).select("prefix", "kind", "obj_id")


@query("k3_name_search", f"WITH {INDEX} SELECT kind, obj_id FROM x WHERE prefix='stre' AND contains(' '||lower(name), ' street') AND kind=4")
def _(t: Tables) -> DataFrame:
    return address.name_search(_index(t), "Street").select("kind", "obj_id")


@query(
    "a16_gazetteer_blocks",
    f"""WITH {STREETS} SELECT p.id AS city_id, count(DISTINCT st.part || '/' || st.name) AS n_streets FROM place p LEFT JOIN st ON st.city_id=p.id GROUP BY p.id""",
)
def _(t: Tables) -> DataFrame:
    blocks = address.write_gazetteer(address.get_or_create_streets(_found(t)), _buildings(t), t.place)
    return blocks.select("city_id", F.coalesce(F.size("streets"), F.lit(0)).cast("long").alias("n_streets")).withColumn("n_streets", F.greatest("n_streets", F.lit(0)))


@query("f8_nearest_single", f"WITH {PLACES} SELECT a.id AS p_id, round(min({DIST}), 4) AS m FROM address a CROSS JOIN pl b GROUP BY a.id")
def _(t: Tables) -> DataFrame:
    """The nearest of the places that are cities or towns in the wider sense."""
    return places.nearest_object(t.address, _cities(t)).select("p_id", F.round("m", 4).alias("m"))


@query("f8_nearest_place", f"SELECT a.id AS p_id, round(min({DIST}), 4) AS m FROM address a CROSS JOIN place b GROUP BY a.id")
def _(t: Tables) -> DataFrame:
    return places.nearest_object(t.address, t.place).select("p_id", F.round("m", 4).alias("m"))


# ---- all phases in a row

#: boundaries are the outlines of places, some with holes, under the place's name, a longer one, or another with a short one
RUN_BOUNDARIES = """SELECT id, CASE id%3 WHEN 0 THEN concat('x ', name) WHEN 1 THEN name ELSE concat('other ', CAST(id AS VARCHAR(10))) END AS name, CASE WHEN id%3=2 THEN name END AS short_name, 5+id%6 AS level, CASE WHEN id%4=0 THEN 'town' END AS place, CASE WHEN id%5=0 THEN id END AS centre FROM {place}"""
RUN_ADDRESSES = """SELECT a.id, a.street, a.housenumber, CASE WHEN a.id%11=0 THEN concat('near ', p.name) END AS is_in, a.lat, a.lon FROM {address} a LEFT JOIN {place} p ON p.id = CAST(FLOOR(a.id/15) AS BIGINT) + 1"""
RUN_CITIES = f"""{OUTLINE_EDGES}, bd AS ({RUN_BOUNDARIES.format(place='place')}), ad AS ({RUN_ADDRESSES.format(address='address', place='place')}),
 ip AS ({IN_OUTLINE.format(points='pl')}), ia AS ({IN_OUTLINE.format(points='ad')}),
 inside AS (SELECT id AS city_id, place_id AS b_id FROM ip WHERE role='outer' AND (id, place_id) NOT IN (SELECT (id, place_id) FROM ip WHERE role='inner' AND place_id%4=3)),
 m AS (SELECT b.id AS b_id, p.id AS city_id, CASE WHEN lower(p.name)=lower(b.name) OR lower(p.name)=lower(coalesce(b.short_name,'')) THEN 2 WHEN contains(lower(b.name), lower(p.name)) OR contains(lower(p.name), lower(b.name)) THEN 3 END AS rank FROM inside i JOIN bd b ON b.id=i.b_id JOIN pl p ON p.id=i.city_id
  UNION ALL SELECT b.id, p.id, 1 FROM bd b JOIN pl p ON p.id=b.centre),
 mt AS (SELECT b_id, city_id FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY rank, city_id) AS n FROM m WHERE rank IS NOT NULL) q WHERE n=1),
 sc AS (SELECT mt.city_id, b.id AS b_id, b.level, b.name, lower(p.name)=lower(b.name) OR lower(p.name)=lower(coalesce(b.short_name,'')) AS ne, b.place IS NOT NULL AS hp, b.centre IS NOT NULL AS hc FROM mt JOIN bd b ON b.id=mt.b_id JOIN pl p ON p.id=mt.city_id),
 so AS (SELECT *, CASE WHEN ne AND hp THEN 0 WHEN ne AND hc THEN {SCORE_RANK} WHEN ne THEN 10+{SCORE_RANK} WHEN hc THEN 20+{SCORE_RANK} ELSE 30+{SCORE_RANK} END AS score FROM sc),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY score, b_id) AS n FROM so) q WHERE n=1),
 cb AS (SELECT so.city_id, so.b_id FROM so JOIN top ON top.city_id=so.city_id AND top.score=so.score AND top.level=so.level AND top.name=so.name
  UNION ALL SELECT city_id, b_id FROM (SELECT i.city_id, i.b_id, row_number() OVER (PARTITION BY i.city_id ORDER BY b.level DESC, i.b_id) AS n FROM inside i JOIN bd b ON b.id=i.b_id JOIN pl p ON p.id=i.city_id WHERE b.level>=7 AND p.kind IN ('CITY','TOWN') AND i.city_id NOT IN (SELECT city_id FROM top)) q WHERE n=1)"""


def _run_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundaries, their rings and the addresses of the run."""
    rings = outline_rings(t).where((F.col("role") == "outer") | (F.col("b_id") % 4 == 3))
    return t.spark.sql(RUN_BOUNDARIES, place=t.place), rings, t.spark.sql(RUN_ADDRESSES, address=t.address, place=t.place)


@query("e1_city_boundaries", f"WITH {PLACES}, {RUN_CITIES} SELECT city_id, string_agg(CAST(b_id AS VARCHAR), ',' ORDER BY b_id) AS boundary_ids FROM cb GROUP BY city_id")
def _(t: Tables) -> DataFrame:
    """Cities and their boundaries from geometry and names: I5, C8, C9, E1 and C10 in a row."""
    boundaries, rings, _ = _run_tables(t)
    taken, _ = phases.city_boundaries(_cities(t), boundaries, rings)
    return taken.select("city_id", F.array_join(F.array_sort("boundary_ids").cast("array<string>"), ",").alias("boundary_ids"))


@query(
    "a16_gazetteer_run",
    f"""WITH {NEAR}, {RUN_CITIES},
 inc AS (SELECT DISTINCT ia.id AS p_id, cb.city_id AS o_id FROM ia JOIN cb ON cb.b_id=ia.place_id WHERE role='outer' AND (ia.id, ia.place_id) NOT IN (SELECT (id, place_id) FROM ia WHERE role='inner' AND place_id%4=3)),
 d AS (SELECT c.p_id, c.o_id, {CAND_DIST}/{RADIUS} AS rel, (c.p_id, c.o_id) IN (SELECT (p_id, o_id) FROM inc) AS contains, c.o_id IN (SELECT city_id FROM cb) AS has_boundary, coalesce(contains(lower(ad.is_in), lower(pl.name)), false) AS named FROM (SELECT p_id, o_id, lat, lon, o_lat, o_lon, kind FROM c) c JOIN (SELECT id AS a_id, is_in FROM ad) ad ON ad.a_id=c.p_id JOIN (SELECT id AS c_id, name FROM pl) pl ON pl.c_id=c.o_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY rel, o_id) AS rank, max(CASE WHEN contains OR named THEN 1 ELSE 0 END) OVER (PARTITION BY p_id)=1 AS some_taken FROM d),
 k AS (SELECT *, contains OR named OR (rel<=0.2e0 AND (NOT has_boundary OR NOT some_taken)) AS taken FROM r), a AS (SELECT *, max(CASE WHEN taken THEN 1 ELSE 0 END) OVER (PARTITION BY p_id)=1 AS any_taken FROM k),
 f AS (SELECT p_id, o_id FROM a WHERE taken OR (NOT any_taken AND rank=1)),
 s AS (SELECT f.o_id AS city_id, ad.street, string_agg(concat(ad.id, '=', ad.housenumber), ',' ORDER BY ad.id) AS houses FROM f JOIN ad ON ad.id=f.p_id GROUP BY 1,2),
 gz AS (SELECT city_id, string_agg(concat(street, ':', houses), ';' ORDER BY street) AS streets FROM s GROUP BY city_id)
 SELECT pl.id AS city_id, pl.name AS city, gz.streets FROM pl LEFT JOIN gz ON gz.city_id=pl.id""",
)
def _(t: Tables) -> DataFrame:
    """Cities, boundaries, streets and buildings to the saved blocks, from places, ways and addresses alone."""
    boundaries, rings, addresses = _run_tables(t)
    blocks = phases.gazetteer_run(t.place, boundaries, rings, addresses)
    house = lambda b: F.concat(b["building_id"].cast("string"), F.lit("="), b["housenumber"])
    street = lambda s: F.concat(s["name"], F.lit(":"), F.array_join(F.transform(s["buildings"], house), ","))
    return blocks.select("city_id", "city", F.array_join(F.transform("streets", street), ";").alias("streets"))
