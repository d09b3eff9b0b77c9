"""Map-shaped views over general tables: the inputs of the registered queries.

Each view is one SQL text that Spark and DuckDB read alike. Coordinates are multiples of 1e-5
degrees between 40.0 and 40.2 north, 5.0 and 4.8 west.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "osm_node": """SELECT p_partkey AS id, 4e1 + CAST((p_partkey*7919)%20000 AS DOUBLE)/1e5 AS lat, -5e0 + CAST((p_partkey*104729)%20000 AS DOUBLE)/1e5 AS lon,
 CASE p_type WHEN 'ECONOMY' THEN 'restaurant' WHEN 'SMALL' THEN 'cafe' WHEN 'MEDIUM' THEN 'bank' WHEN 'PROMO' THEN 'pharmacy' END AS amenity,
 CASE WHEN p_size%5=0 THEN p_name END AS name FROM part WHERE p_partkey%97<>13""",
    "osm_way": """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'secondary' WHEN '4-NOT SPECIFIED' THEN 'residential' ELSE 'footway' END AS highway,
 concat('Street ', CAST(o_custkey%50 AS VARCHAR(10))) AS name, CASE WHEN o_orderstatus='P' THEN 'yes' END AS oneway, o_orderkey%11=0 AS is_boundary FROM orders""",
    "osm_way_node": """SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 AS INT) AS ord, l_partkey AS node_id FROM lineitem""",
    "osm_relation": """SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'multipolygon' WHEN 'AUTOMOBILE' THEN 'restriction' WHEN 'MACHINERY' THEN 'associatedStreet' WHEN 'FURNITURE' THEN 'route' ELSE 'boundary' END AS rel_type, c_name AS name FROM customer""",
    "osm_relation_member": """SELECT o_custkey AS rel_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS INT) AS ord, o_orderkey AS member_id, 1 AS member_type,
 CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)=1 THEN 'from' WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)=2 THEN 'to' WHEN o_orderstatus='F' THEN 'inner' ELSE 'outer' END AS role FROM orders""",
    "place": """SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey%7 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'hamlet' WHEN 4 THEN 'suburb' WHEN 5 THEN 'district' ELSE 'locality' END AS place,
 4e1 + CAST((s_suppkey*6007)%20000 AS DOUBLE)/1e5 AS lat, -5e0 + CAST((s_suppkey*9001)%20000 AS DOUBLE)/1e5 AS lon, s_nationkey%4=0 AS capital FROM supplier""",
    "boundary": """SELECT n_nationkey AS id, n_name AS name, 5+n_nationkey%6 AS admin_level, 4e1+CAST((n_nationkey%5)*4000 AS DOUBLE)/1e5 AS min_lat, -5e0+CAST(FLOOR(n_nationkey/5)*4000 AS DOUBLE)/1e5 AS min_lon,
 4e1+CAST((n_nationkey%5)*4000+5000 AS DOUBLE)/1e5 AS max_lat, -5e0+CAST(FLOOR(n_nationkey/5)*4000+5000 AS DOUBLE)/1e5 AS max_lon FROM nation""",
    "address": """SELECT c_custkey AS id, CASE WHEN c_custkey%17=0 THEN concat(CAST(c_custkey%200+1 AS VARCHAR(10)),'/',CAST(c_custkey%30+1 AS VARCHAR(10))) WHEN c_custkey%13=0 THEN concat(CAST(c_custkey%200+1 AS VARCHAR(10)),'-',CAST(c_custkey%200+9 AS VARCHAR(10))) ELSE CAST(c_custkey%200+1 AS VARCHAR(10)) END AS housenumber,
 concat('Street ', CAST(c_custkey%50 AS VARCHAR(10))) AS street, concat('p', CAST(10000+c_nationkey AS VARCHAR(10))) AS postcode, 4e1+CAST((c_custkey*7919)%20000 AS DOUBLE)/1e5 AS lat, -5e0+CAST((c_custkey*104729)%20000 AS DOUBLE)/1e5 AS lon FROM customer""",
    "poi": """SELECT event_id AS id, event_type AS category, concat(event_type,'_',CAST(user_id%7 AS VARCHAR(10))) AS subtype, 4e1+CAST((event_id*7919)%20000 AS DOUBLE)/1e5 AS lat, -5e0+CAST((event_id*104729)%20000 AS DOUBLE)/1e5 AS lon, value FROM events""",
    # a dented square around every place, and a hole in it; 24 points each
    "outline": """SELECT s_suppkey AS place_id, role, k, 4e1 + CAST((s_suppkey*6007)%20000 + CASE CAST(FLOOR(k/6) AS BIGINT) WHEN 0 THEN -r + (s_suppkey*31+k*17)%j WHEN 1 THEN -r + (k%6)*s WHEN 2 THEN r - (s_suppkey*31+k*17)%j ELSE r - (k%6)*s END AS DOUBLE)/1e5 AS lat,
 -5e0 + CAST((s_suppkey*9001)%20000 + CASE CAST(FLOOR(k/6) AS BIGINT) WHEN 0 THEN -r + (k%6)*s WHEN 1 THEN r - (s_suppkey*31+k*17)%j WHEN 2 THEN r - (k%6)*s ELSE -r + (s_suppkey*31+k*17)%j END AS DOUBLE)/1e5 AS lon
 FROM supplier, (SELECT n_nationkey AS k FROM nation WHERE n_nationkey<24) ks, (SELECT 'outer' AS role, 1500 AS r, 500 AS s, 300 AS j UNION ALL SELECT 'inner' AS role, 600 AS r, 200 AS s, 120 AS j) rs""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or one of the views."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(
        r"\bFROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in BASE else m[0], VIEWS[name].replace("{", "{{").replace("}", "}}")
    )
    base = re.findall(r"FROM \{(\w+)\}", text)
    return spark.sql(text, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in base})


def with_views(sql: str) -> str:
    """`sql` with the views that it names in front, for an engine that has the base tables only."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not used:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[15:]}"
    return f"WITH {head}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {head} {sql}"
