"""Queries: geo, tag, name and number functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import filters, geo, numparse, tags

from .registry import Tables, query

MERC = "(1-ln(tan(radians({lat}))+1/cos(radians({lat})))/pi())/2"
R = "2*{r}*1000*{f}"


def _r(c, n: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, n)


def _latlon():  # noqa: ANN202
    return F.col("lat"), F.col("lon")


HAV = "POWER(SIN(RADIANS(40.1e0-lat)/2),2)+COS(RADIANS(lat))*COS(RADIANS(40.1e0))*POWER(SIN(RADIANS(-4.9e0-lon)/2),2)"


@query(
    "h24_distances",
    f"SELECT id, round(2*6372.8e0*1000*asin(sqrt({HAV})),4) AS m1, round(2*6371e0*1000*atan2(sqrt({HAV}), sqrt(1-({HAV}))),4) AS m2 FROM poi",
)
def _(t: Tables) -> DataFrame:
    to = (F.lit(40.1), F.lit(-4.9))
    return t.poi.select("id", _r(geo.distance_m(*_latlon(), *to), 4).alias("m1"), _r(geo.distance_atan2_m(*_latlon(), *to), 4).alias("m2"))


@query(
    "h25_wrap_and_clamp",
    """SELECT id, round(CASE WHEN a BETWEEN -180 AND 180 THEN a ELSE a - 360*floor((a+180)/360) END, 6) AS lon, round(greatest(-85.0511e0, least(85.0511e0, CASE WHEN b BETWEEN -90 AND 90 THEN b ELSE b - 180*floor((b+90)/180) END)), 6) AS lat
 FROM (SELECT id, lon*117.7e0 AS a, (lat-40)*1931.3e0-190 AS b FROM poi) s""",
)
def _(t: Tables) -> DataFrame:
    return t.poi.select("id", _r(geo.wrap_longitude(F.col("lon") * 117.7)).alias("lon"), _r(geo.clamp_latitude((F.col("lat") - 40) * 1931.3 - 190)).alias("lat"))


@query(
    "h26_x31_y31",
    f"SELECT id, CAST(floor((lon+180)/360*2147483648e0) AS BIGINT) AS x, CAST(floor({MERC.format(lat='lat')}*2147483648e0) AS BIGINT) AS y FROM poi",
)
def _(t: Tables) -> DataFrame:
    return t.poi.select("id", geo.x31(F.col("lon")).alias("x"), geo.y31(F.col("lat")).alias("y"))


@query(
    "h27_from_x31_y31",
    "SELECT o_orderkey AS id, round(((o_orderkey*7919)//1024)/2097152e0*360-180, 6) AS lon, round(degrees(atan((exp(a)-exp(-a))/2)), 6) AS lat FROM (SELECT *, pi()*(1-2*((o_orderkey*7919)//1024)/2097152e0) AS a FROM orders) s",
)
def _(t: Tables) -> DataFrame:
    v = F.col("o_orderkey") * 7919
    return t.orders.select(F.col("o_orderkey").alias("id"), _r(geo.longitude31(v)).alias("lon"), _r(geo.latitude31(v)).alias("lat"))


@query(
    "h28_tile_numbers",
    f"SELECT id, round((lon+180)/360*32768e0, 5) AS x, round({MERC.format(lat='lat')}*32768e0, 5) AS y, round(lon, 5) AS back_lon, round(lat, 5) AS back_lat FROM poi",
)
def _(t: Tables) -> DataFrame:
    x, y = geo.tile_x(F.col("lon"), 15), geo.tile_y(F.col("lat"), 15)
    return t.poi.select("id", _r(x, 5).alias("x"), _r(y, 5).alias("y"), _r(geo.tile_longitude(x, 15), 5).alias("back_lon"), _r(geo.tile_latitude(y, 15), 5).alias("back_lat"))


@query(
    "h29_ellipsoid_tiles",
    """SELECT id, round(8192e0*(0.5-((ln((1+s)/(1-s))/2 - j*ln((1+j*s)/(1-j*s))/2)/(2*pi()))), 5) AS y, round(lat, 5) AS back
 FROM (SELECT id, lat, sin(radians(lat)) AS s, sqrt(6378137e0*6378137e0-6356752e0*6356752e0)/6378137e0 AS j FROM poi) q""",
)
def _(t: Tables) -> DataFrame:
    y = geo.ellipsoid_tile_y(F.col("lat"), 13)
    return t.poi.select("id", _r(y, 5).alias("y"), _r(geo.ellipsoid_latitude(y, 13), 5).alias("back"))


@query(
    "h30_tile_of_point",
    "SELECT id, x>>16 AS tx, y>>16 AS ty, (x>>16)<<16 AS min_x, (y>>16)<<16 AS min_y, (((x>>16)+1)<<16)-1 AS max_x, (((y>>16)+1)<<16)-1 AS max_y FROM (SELECT o_orderkey AS id, o_orderkey*7919 AS x, o_orderkey*104729 AS y FROM orders) s",
)
def _(t: Tables) -> DataFrame:
    p = t.orders.select(F.col("o_orderkey").alias("id"), geo.tile_of_x31(F.col("o_orderkey") * 7919, 15).alias("tx"), geo.tile_of_x31(F.col("o_orderkey") * 104729, 15).alias("ty"))
    return p.select("id", "tx", "ty", *geo.tile_box31(F.col("tx"), F.col("ty"), 15))


@query(
    "h31_morton",
    "SELECT id, CAST(list_sum(list_transform(range(0,31), lambda b: (((x>>b)&1)<<(2*b+1)) + ((y>>b)&1)*(1<<(2*b)))) AS BIGINT) AS code FROM (SELECT o_orderkey AS id, (o_orderkey*7919)%2147483648 AS x, (o_orderkey*7919+12345)%2147483648 AS y FROM orders) s",
)
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("long") * 7919
    return t.orders.select(F.col("o_orderkey").alias("id"), geo.morton(F.pmod(k, F.lit(2**31)), F.pmod(k + 12345, F.lit(2**31))).alias("code"))


@query(
    "h31_morton_all",
    "SELECT id, CAST(list_sum(list_transform(range(0,31), lambda b: (((x>>b)&1)<<(2*b+1)) + ((y>>b)&1)*(1<<(2*b)))) AS BIGINT) AS code FROM (SELECT o_orderkey AS id, (o_orderkey*7919)%2147483648 AS x, (o_orderkey*104729)%2147483648 AS y FROM orders) s",
)
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return t.orders.select(F.col("o_orderkey").alias("id"), geo.morton(F.pmod(k * 7919, F.lit(2**31)), F.pmod(k * 104729, F.lit(2**31))).alias("code"))


@query(
    "h31_short_code",
    """WITH c AS (SELECT id, CAST(trunc((lon+180)/360*4294967296e0) AS BIGINT) AS x, CAST(trunc((lat+90)/180*4294967296e0) AS BIGINT) AS y FROM osm_node),
 s AS (SELECT id, i, ((x>>(31-3*i))&1)*32+((y>>(31-3*i))&1)*16+((x>>(30-3*i))&1)*8+((y>>(30-3*i))&1)*4+((x>>(29-3*i))&1)*2+((y>>(29-3*i))&1) AS v FROM c, (SELECT range AS i FROM range(0,8)) g)
 SELECT id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_@', CAST(v+1 AS INT), 1), '' ORDER BY i) AS code FROM s GROUP BY id""",
)
def _(t: Tables) -> DataFrame:
    return t.osm_node.select("id", geo.short_code(F.col("lat"), F.col("lon"), 16).alias("code"))


@query("h31_short_code_decode", "SELECT id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM osm_node")
def _(t: Tables) -> DataFrame:
    p = t.osm_node.select("id", geo.short_code_position(geo.short_code(F.col("lat"), F.col("lon"), 22)).alias("p"))
    return p.select("id", _r(F.col("p.lat"), 5).alias("lat"), _r(F.col("p.lon"), 5).alias("lon"))


SEG31 = "SELECT o_orderkey AS id, o_orderkey%1000 AS px, o_orderkey%777 AS py, o_custkey%500 AS ax, o_custkey%300 AS ay, 500+o_custkey%400 AS bx, 400+o_custkey%350 AS b_y FROM orders"


def _seg31(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS id", "o_orderkey%1000 AS px", "o_orderkey%777 AS py", "o_custkey%500 AS ax", "o_custkey%300 AS ay", "500+o_custkey%400 AS bx", "400+o_custkey%350 AS b_y"
    )


@query(
    "h32_projection31",
    f"""WITH s AS ({SEG31}), d AS (SELECT *, ((bx-ax)*0.011e0)*((px-ax)*0.011e0)+((b_y-ay)*0.01863e0)*((py-ay)*0.01863e0) AS along, power((bx-ax)*0.011e0,2)+power((b_y-ay)*0.01863e0,2) AS whole FROM s)
 SELECT id, round(sqrt(power((px-ax)*0.011e0,2)+power((py-ay)*0.01863e0,2)),6) AS m, CASE WHEN along<0 THEN ax WHEN along>=whole THEN bx ELSE CAST(trunc(ax+(bx-ax)*(along/whole)) AS BIGINT) END AS x,
 CASE WHEN along<0 THEN ay WHEN along>=whole THEN b_y ELSE CAST(trunc(ay+(b_y-ay)*(along/whole)) AS BIGINT) END AS y FROM d""",
)
def _(t: Tables) -> DataFrame:
    c = [F.col(n) for n in ("px", "py", "ax", "ay", "bx", "b_y")]
    s = _seg31(t).withColumn("p", geo.projection31(*c))
    return s.select("id", _r(geo.distance31_m(*c[:4])).alias("m"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(
    "h33_projection",
    f"""WITH s AS (SELECT id, lat, lon, 40.0e0 AS a1, -5.0e0 AS o1, 40.15e0 AS a2, -4.85e0 AS o2 FROM poi), d AS (SELECT *, least(1e0, greatest(0e0, ((a2-a1)*(lat-a1)+(o2-o1)*(lon-o1))/(power(a2-a1,2)+power(o2-o1,2)))) AS k FROM s),
 q AS (SELECT id, lat, lon, a1+(a2-a1)*k AS pa, o1+(o2-o1)*k AS po FROM d)
 SELECT id, round(pa,7) AS lat, round(po,7) AS lon, round(2*6372.8e0*1000*asin(sqrt(power(sin(radians(lat-pa)/2),2)+cos(radians(pa))*cos(radians(lat))*power(sin(radians(lon-po)/2),2))),3) AS m FROM q""",
)
def _(t: Tables) -> DataFrame:
    ends = [F.lit(v) for v in (40.0, -5.0, 40.15, -4.85)]
    p = geo.projection(*_latlon(), *ends)
    return t.poi.select("id", _r(p["lat"], 7).alias("lat"), _r(p["lon"], 7).alias("lon"), _r(geo.orthogonal_distance_m(*_latlon(), *ends), 3).alias("m"))


@query(
    "h34_angles",
    """SELECT id, round(180 - ((180-d) - 360*floor((180-d)/360)), 6) AS diff, round(pi() - ((pi()-d) - 2*pi()*floor((pi()-d)/(2*pi()))), 6) AS aligned, round((d+180) - 360*floor((d+180)/360) - 180, 6) AS turn
 FROM (SELECT id, (lat-40)*9001.3e0-700 AS d FROM poi) s""",
)
def _(t: Tables) -> DataFrame:
    d = (F.col("lat") - 40) * 9001.3 - 700
    return t.poi.select("id", _r(geo.degrees_diff(d, F.lit(0.0))).alias("diff"), _r(geo.align_angle(d)).alias("aligned"), _r(geo.rotation_diff(F.lit(0.0), d)).alias("turn"))


@query("h35_meters_per_tile_unit", "SELECT id, round(40075017e0/(32768e0*256*sqrt(power((exp(a)-exp(-a))/2,2)+1)), 8) AS m FROM (SELECT id, 2*pi()*(id%32768)/32768e0-pi() AS a FROM poi) s")
def _(t: Tables) -> DataFrame:
    return t.poi.select("id", _r(geo.meters_per_tile_unit(F.col("id") % 32768, 15, 256.0), 8).alias("m"))


@query("h36_normalize_tile", "SELECT id, CAST(v - 32768*floor(v/32768e0) AS BIGINT) AS v FROM (SELECT id, id*37-200000 AS v FROM poi) s")
def _(t: Tables) -> DataFrame:
    return t.poi.select("id", geo.normalize_tile(F.col("id") * 37 - 200000, 15).alias("v"))


@query("h37_pixel_shift", "SELECT id, CAST(trunc(((lon+180)/360*32768e0-(-4.9e0+180)/360*32768e0)*256) AS INT) AS px, round((cos(radians(30e0))*(lat-40)-sin(radians(30e0))*(lon+5))*256, 6) AS rx, round((sin(radians(30e0))*(lat-40)+cos(radians(30e0))*(lon+5))*256, 6) AS ry FROM poi")
def _(t: Tables) -> DataFrame:
    turned = geo.rotated_pixels(F.col("lat") - 40, F.col("lon") + 5, F.lit(30.0), 256)
    return t.poi.select("id", geo.pixel_shift_x(F.col("lon"), F.lit(-4.9), 15, 256).alias("px"), _r(turned["x"]).alias("rx"), _r(turned["y"]).alias("ry"))


@query("h38_out_code", "SELECT id, CASE WHEN lon < -4.95e0 THEN 1 WHEN lon > -4.85e0 THEN 2 ELSE 0 END + CASE WHEN lat < 40.05e0 THEN 4 WHEN lat > 40.15e0 THEN 8 ELSE 0 END AS code FROM poi")
def _(t: Tables) -> DataFrame:
    return t.poi.select("id", geo.out_code(F.col("lon"), F.col("lat"), -4.95, 40.05, -4.85, 40.15).alias("code"))


@query("h39_generated_id", "SELECT id, ((id*8+id%4)*2)+id%2 AS made, id*2+id%2 AS back FROM poi")
def _(t: Tables) -> DataFrame:
    made = geo.generated_id(F.col("id"), F.col("id") % 4, F.col("id") % 2)
    return t.poi.select("id", made.alias("made"), geo.base_id(made).alias("back"))


@query("h40_zoom_levels", "SELECT n.n_nationkey AS id, z.* FROM nation n, (VALUES (0,15,22),(1,13,14),(2,12,12),(3,11,11)) z(level,minzoom,maxzoom) WHERE 10+n.n_nationkey%14 BETWEEN z.minzoom AND z.maxzoom")
def _(t: Tables) -> DataFrame:
    levels = t.spark.createDataFrame(geo.parse_zooms("11;12;13-14;15-"), "level int, minzoom int, maxzoom int")
    zoom = 10 + F.col("n_nationkey") % 14
    return t.nation.join(F.broadcast(levels), zoom.between(F.col("minzoom"), F.col("maxzoom"))).select(F.col("n_nationkey").alias("id"), "level", "minzoom", "maxzoom")


@query(
    "h41_tile_algebra",
    """WITH b AS (SELECT id, CAST(floor((min_lon+180)/360*8192e0) AS BIGINT) AS x0, CAST(floor((max_lon+180)/360*8192e0) AS BIGINT) AS x1, id*3 AS y0, id*3+2 AS y1 FROM boundary)
 SELECT id, x.v AS tx, y.v AS ty, x.v>>1 AS px, y.v>>1 AS py FROM b, LATERAL (SELECT unnest(range(x0, x1+1)) AS v) x, LATERAL (SELECT unnest(range(y0, y1+1)) AS v) y""",
)
def _(t: Tables) -> DataFrame:
    x0, x1 = geo.tile_x(F.col("min_lon"), 13), geo.tile_x(F.col("max_lon"), 13)
    tiles = t.boundary.select("id", F.explode(geo.covering_tiles(x0, F.col("id") * 3.0, x1, F.col("id") * 3.0 + 2)).alias("tile"))
    x, y = F.col("tile.x"), F.col("tile.y")
    return tiles.select("id", x.alias("tx"), y.alias("ty"), geo.tile_parent(x).alias("px"), geo.tile_parent(y).alias("py"))


@query(
    "h42_zoom_function",
    """SELECT id, round(CASE WHEN z<=6 THEN 1 WHEN z<10 THEN 1+(z-6)/4*2 WHEN z<16 THEN 3+(z-10)/6*9 ELSE 12 END, 6) AS linear, round(CASE WHEN z<=6 THEN 1 WHEN z<16 THEN 1+(power(1.5e0,z-6)-1)/(power(1.5e0,10)-1)*11 ELSE 12 END, 6) AS curved FROM (SELECT id, (lat-40)*100 AS z FROM poi) s""",
)
def _(t: Tables) -> DataFrame:
    z = (F.col("lat") - 40) * 100
    return t.poi.select("id", _r(geo.stops_value(z, [(6, 1), (10, 3), (16, 12)])).alias("linear"), _r(geo.stops_value(z, [(6, 1), (16, 12)], 1.5)).alias("curved"))


@query(
    "i9_segment_cross",
    """WITH s AS (SELECT o_orderkey AS id, o_orderkey%101 AS ax, o_orderkey%103 AS ay, o_orderkey%107 AS bx, o_orderkey%109 AS b_y, o_custkey%97 AS cx, o_custkey%89 AS cy, o_custkey%83 AS dx, o_custkey%79 AS dy FROM orders)
 SELECT id, ((dy-ay)*(cx-ax) > (cy-ay)*(dx-ax)) <> ((dy-b_y)*(cx-bx) > (cy-b_y)*(dx-bx)) AND ((cy-ay)*(bx-ax) > (b_y-ay)*(cx-ax)) <> ((dy-ay)*(bx-ax) > (b_y-ay)*(dx-ax)) AS crosses FROM s""",
)
def _(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(k.alias("id"), geo.segments_cross((k % 101, k % 103), (k % 107, k % 109), (c % 97, c % 89), (c % 83, c % 79)).alias("crosses"))


# ---- numbers in texts

SQL_TEXTS = """CASE id%11 WHEN 0 THEN 'none' WHEN 1 THEN concat(CAST(id%130 AS VARCHAR(10)),' mph') WHEN 2 THEN concat(CAST(id%200 AS VARCHAR(10)),'.5') WHEN 3 THEN concat(CAST(id%20 AS VARCHAR(10)),chr(39),'6"')
 WHEN 4 THEN concat(CAST(id%50 AS VARCHAR(10)),' ft') WHEN 5 THEN concat(CAST(id%9000 AS VARCHAR(10)),' lbs') WHEN 6 THEN concat('-',CAST(id%10 AS VARCHAR(10))) WHEN 7 THEN 'abc' WHEN 8 THEN '' WHEN 9 THEN 'yes' ELSE CAST(id%300 AS VARCHAR(10)) END"""
NUM = "TRY_CAST(nullif(regexp_extract(s,'[0-9][0-9.]*'),'') AS DOUBLE)"


def _texts(t: Tables) -> DataFrame:
    return t.poi.select("id", F.expr(SQL_TEXTS).alias("s"))


@query("h18_first_number", f"SELECT id, nullif(regexp_extract(s,'-?[0-9][0-9.]*'),'') AS n FROM (SELECT id, {SQL_TEXTS} AS s FROM poi) q")
def _(t: Tables) -> DataFrame:
    return _texts(t).select("id", numparse.first_number(F.col("s"), signed=True).alias("n"))


@query(
    "h19_speed",
    f"SELECT id, round(CASE WHEN s='none' THEN 40 ELSE coalesce({NUM}/3.6e0*CASE WHEN contains(s,'mph') THEN 1.6e0 ELSE 1e0 END, -1) END, 6) AS v FROM (SELECT id, {SQL_TEXTS} AS s FROM poi) q",
)
def _(t: Tables) -> DataFrame:
    return _texts(t).select("id", _r(numparse.speed_mps(F.col("s"), -1.0)).alias("v"))


@query(
    "h20_length",
    f"""SELECT id, round(coalesce({NUM}*CASE WHEN contains(s,'ft') OR contains(s,'"') OR contains(s,'''') THEN 0.3048e0 ELSE 1e0 END + CASE WHEN contains(s,'''') THEN 6*0.0254e0 ELSE 0e0 END, -1), 6) AS v FROM (SELECT id, {SQL_TEXTS} AS s FROM poi) q""",
)
def _(t: Tables) -> DataFrame:
    return _texts(t).select("id", _r(numparse.length_m(F.col("s"), -1.0)).alias("v"))


@query("h21_weight", f"SELECT id, round(coalesce({NUM}*CASE WHEN contains(s,'lbs') THEN 0.4535e0/1000 ELSE 1e0 END, -1), 8) AS v FROM (SELECT id, {SQL_TEXTS} AS s FROM poi) q")
def _(t: Tables) -> DataFrame:
    return _texts(t).select("id", _r(numparse.weight_t(F.col("s"), -1.0), 8).alias("v"))


@query(
    "h22_typed_values",
    f"SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(s,'-?[0-9]+'),'') AS INT), 7) AS i, coalesce(TRY_CAST(nullif(regexp_extract(s,'-?[0-9][0-9.]*'),'') AS DOUBLE), 0.5e0) AS d, s IN ('yes','true','1') AS b FROM (SELECT id, {SQL_TEXTS} AS s FROM poi) q",
)
def _(t: Tables) -> DataFrame:
    s = F.col("s")
    return _texts(t).select("id", numparse.as_int(s, 7).alias("i"), numparse.as_double(s, 0.5).alias("d"), numparse.as_bool(s, False).alias("b"))


@query("h23_scale_and_shift", "SELECT id, round(lat*(3937e0/1200)+10, 6) AS x, round(lon*(3937e0/1200)+10, 6) AS y FROM osm_node")
def _(t: Tables) -> DataFrame:
    moved = numparse.scale_and_shift(F.array("lat", "lon"), numparse.unit_factor("METERS", "FEET"), 10.0)
    return t.osm_node.select("id", _r(moved[0]).alias("x"), _r(moved[1]).alias("y"))


# ---- tags and names


@query("h3_boolean_values", "SELECT id, CASE id%4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' ELSE 'other' END AS v FROM poi")
def _(t: Tables) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ("true", "False", "yes", "other"))), (F.col("id") % 4).cast("int"))
    return t.poi.select("id", tags.yes_no(raw).alias("v"))


@query("h4_rule_keys", "SELECT id, CASE WHEN oneway IS NULL THEN 'oneway' ELSE 'oneway/yes' END AS k, 'oneway' AS tag, oneway AS value FROM osm_way")
def _(t: Tables) -> DataFrame:
    k = tags.rule_key(F.lit("oneway"), F.col("oneway"))
    return t.osm_way.select("id", k.alias("k"), tags.rule_tag(k).alias("tag"), tags.rule_value(k).alias("value"))


@query("h7_website", "SELECT id, CASE id%4 WHEN 0 THEN concat('http://w', id) WHEN 1 THEN concat('http://s', id) WHEN 2 THEN concat('https://u', id) END AS url FROM poi")
def _(t: Tables) -> DataFrame:
    k, i = F.col("id") % 4, F.col("id").cast("string")
    m = F.map_from_arrays(
        F.array(F.lit("wikipedia"), F.lit("website"), F.lit("url")),
        F.array(F.when(k == 0, F.concat(F.lit("w"), i)), F.when(k <= 1, F.concat(F.lit("http://s"), i)), F.when(k <= 2, F.concat(F.lit("https://u"), i))),
    )
    return t.poi.select("id", tags.website(m).alias("url"))


@query(
    "h8_object_name",
    "SELECT id, CASE id%5 WHEN 0 THEN concat('n',id) WHEN 1 THEN concat('e',id) WHEN 2 THEN concat('o',id,' [r',id,']') WHEN 3 THEN concat('o',id) ELSE concat('r',id) END AS name, id*2+1 AS poi_id FROM poi",
)
def _(t: Tables) -> DataFrame:
    k, i = F.col("id") % 5, F.col("id").cast("string")
    of = lambda c, letter: F.when(c, F.concat(F.lit(letter), i))
    m = F.map_from_arrays(F.array(*map(F.lit, ("name", "name:en", "operator", "ref"))), F.array(of(k == 0, "n"), of(k <= 1, "e"), of((k == 2) | (k == 3), "o"), of((k == 2) | (k == 4), "r")))
    return t.poi.select("id", tags.object_name(m).alias("name"), tags.poi_id(F.col("id"), F.lit(False)).alias("poi_id"))


@query(
    "h9_symbols_and_colours",
    "SELECT id, CASE id%3 WHEN 0 THEN 'osmc_symbol_red;osmc_text=T' WHEN 1 THEN 'osmc_symbol_blue' ELSE '' END AS symbols, CASE id%2 WHEN 0 THEN 'color_red' ELSE 'color_green' END AS colour FROM poi",
)
def _(t: Tables) -> DataFrame:
    k = F.col("id") % 3
    made = tags.hiking_symbol_tags(F.when(k == 0, "red:white:bar:T:black").when(k == 1, "blue:white"))
    text = F.array_join(F.transform(made, lambda e: F.when(e["v"] == "", e["k"]).otherwise(F.concat_ws("=", e["k"], e["v"]))), ";")
    colour = F.when(F.col("id") % 2 == 0, "#FF0000").otherwise("Green")
    return t.poi.select("id", F.coalesce(text, F.lit("")).alias("symbols"), tags.colour_tag(colour).alias("colour"))


@query(
    "h10_name_prefixes",
    "SELECT id, prefix FROM (SELECT DISTINCT id, substr(w,1,4) AS prefix FROM (SELECT id, unnest(string_split_regex(lower(name), '[^a-z0-9'']+')) AS w FROM osm_node WHERE name IS NOT NULL) q WHERE w<>'') r",
)
def _(t: Tables) -> DataFrame:
    return t.osm_node.where("name IS NOT NULL").select("id", F.explode(tags.name_prefixes(F.col("name"))).alias("prefix"))


@query(
    "h11_house_number",
    """SELECT id, CASE WHEN contains(housenumber,'/') THEN split_part(housenumber,'/',1) WHEN contains(housenumber,'-') THEN split_part(housenumber,'-',1) ELSE housenumber END AS first,
 CASE WHEN contains(housenumber,'-') THEN split_part(housenumber,'-',2) END AS last, CASE WHEN contains(housenumber,'/') THEN split_part(housenumber,'/',2) END AS corner,
 CASE id%6 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN -3 WHEN 3 THEN -4 WHEN 4 THEN 4 ELSE 0 END AS kind, upper(postcode) AS postcode FROM address""",
)
def _(t: Tables) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("all", "Even", "odd", "alphabetic", "4", "none"))), (F.col("id") % 6).cast("int"))
    h = tags.house_number(F.col("housenumber"), kind)
    m = F.create_map(F.lit("postal_code"), F.col("postcode"))
    return t.address.select("id", *(h[c].alias(c) for c in ("first", "last", "corner", "kind")), tags.postcode(m).alias("postcode"))


@query("h12_is_in_names", "SELECT id, concat(lower(name), '|spain') AS names FROM place")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lower("name"), F.lit("; spain ;;"), F.lower("name"))
    return t.place.select("id", F.array_join(tags.is_in_names(text), "|").alias("names"))


@query("h14_display_name", "SELECT id, CASE WHEN id%3=0 THEN concat(street,' (',postcode,')') ELSE street END AS display, street AS plain FROM address")
def _(t: Tables) -> DataFrame:
    district = F.when(F.col("id") % 3 == 0, F.col("postcode")).when(F.col("id") % 3 == 1, F.lit("city"))
    d = tags.display_name(F.col("street"), district, F.lit("city"))
    return t.address.select("id", d.alias("display"), tags.plain_name(d).alias("plain"))


@query("h15_english_name", "SELECT id, CASE WHEN id%2=0 THEN concat(name,' en') END AS english FROM osm_way")
def _(t: Tables) -> DataFrame:
    english = F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" en"))).otherwise(F.col("name"))
    return t.osm_way.select("id", tags.english_to_write(F.col("name"), english).alias("english"))


@query("h16_token_template", "SELECT id, upper(concat('<', category, '/', subtype, '> ')) AS label FROM poi")
def _(t: Tables) -> DataFrame:
    return t.poi.select("id", tags.replace_tokens("<{category}/{subtype}> {missing}", {"category": F.col("category"), "subtype": F.col("subtype")}, "uppercase").alias("label"))


@query(
    "h17_road_rules",
    "SELECT id, CASE id%5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 5 ELSE 3 END AS kind, round(CASE id%5 WHEN 0 THEN -1 WHEN 1 THEN (id%120)/3.6e0*1.6e0 WHEN 2 THEN id%6 END, 6) AS number FROM osm_way",
)
def _(t: Tables) -> DataFrame:
    k, i = F.col("id") % 5, F.col("id")
    tag = F.get(F.array(*map(F.lit, ("oneway", "maxspeed", "lanes", "junction", "highway"))), k.cast("int"))
    value = F.when(k == 0, "reverse").when(k == 1, F.concat((i % 120).cast("string"), F.lit(" mph"))).when(k == 2, (i % 6).cast("string")).when(k == 3, "roundabout").otherwise("primary")
    rule = tags.road_rule(tag, value)
    return t.osm_way.select("id", rule["kind"].alias("kind"), _r(rule["number"]).alias("number"))


@query("b16_pattern_applies", "SELECT id, oneway IS NOT NULL AS one, highway='primary' AS two FROM osm_way")
def _(t: Tables) -> DataFrame:
    m = F.map_filter(F.create_map(F.lit("highway"), "highway", F.lit("oneway"), "oneway"), lambda k, v: v.isNotNull())
    pattern = F.array(F.struct(F.lit("highway").alias("tag"), F.lit("primary").alias("value")), F.struct(F.lit("none").alias("tag"), F.lit(None).cast("string").alias("value")))
    return t.osm_way.select("id", tags.applies(m, F.lit("oneway"), F.lit("")).alias("one"), tags.applies_any(m, pattern).alias("two"))


@query(
    "b20_filter_expressions",
    """SELECT id, category='click' AS f1, category<>'click' AS f2, category IN ('click','view') AS f3, category NOT IN ('click','view') AS f4, category='click' AND value>50 AS f5, category='click' OR value<=10 AS f6,
 NOT (category='click' OR value<10) AS f7, true AS f8, false AS f9, id%3=1 AS f10 FROM poi""",
)
def _(t: Tables) -> DataFrame:
    properties = {c: F.col(c) for c in ("category", "subtype", "value")}
    tests = (
        ["==", "category", "click"], ["!=", "category", "click"], ["in", "category", "click", "view"], ["!in", "category", "click", "view"],
        ["all", ["==", "category", "click"], [">", "value", 50]], ["any", ["==", "category", "click"], ["<=", "value", 10]],
        ["none", ["==", "category", "click"], ["<", "value", 10]], ["!=", "missing", 1], ["==", "missing", 1], ["==", "$type", "LineString"],
    )
    kind = 1 + (F.col("id") % 3)
    return t.poi.select("id", *(filters.compile_filter(f, properties, kind).alias(f"f{i + 1}") for i, f in enumerate(tests)))


@query("k9_layer_features", "SELECT id, category FROM poi WHERE category IN ('click','purchase') AND value>=20 AND id%3=0")
def _(t: Tables) -> DataFrame:
    rule = ["all", ["in", "category", "click", "purchase"], [">=", "value", 20], ["==", "$type", "Point"]]
    return t.poi.where(filters.compile_filter(rule, {"category": F.col("category"), "value": F.col("value")}, 1 + F.col("id") % 3)).select("id", "category")
