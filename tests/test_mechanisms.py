"""Plans and scans: bucketed staging, one scan for all indexers, pruned box queries, pushed filters."""

import random

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from geoloom.operators import address, assembly, mapobj
from geoloom.sources import pbf


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_tables_join_without_a_shuffle(spark, tmp_path):
    nodes = spark.range(500).select("id", (F.col("id") / 10).alias("lat"), (F.col("id") / 7).alias("lon"))
    way_nodes = spark.range(2000).select((F.col("id") % 90).alias("way_id"), (F.col("id") / 90).cast("int").alias("ord"), (F.col("id") * 7 % 520).alias("node_id"))
    tables = {"node": (nodes, ["id"], "id"), "way_node": (way_nodes.unionByName(way_nodes), ["way_id", "ord"], "node_id")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staged = mapobj.write_staging(tables, str(tmp_path), 8, "test_staged")
        made, plain = assembly.assemble_ways(staged["way_node"], staged["node"]), assembly.assemble_ways(way_nodes, nodes)
        assert _plan(plain).count("Exchange hashpartitioning") == 3
        assert _plan(made).count("Exchange hashpartitioning") == 1 and "hashpartitioning(way_id" in _plan(made)
        assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS test_staged_{name}")


def test_five_indexers_share_one_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("name")).write.parquet(f"{tmp_path}/in")
    elements = spark.read.parquet(f"{tmp_path}/in")
    indexers = assembly.Indexers()
    for k in range(4):
        indexers.route(f"k{k}", F.col("id") % 4 == k, F.col("id"), F.lit(k).alias(f"c{k}"))
    indexers.route("none", F.lit(None).cast("boolean"), F.col("name"))
    assert _plan(indexers.routed(elements)).count("FileScan") == 1
    done = indexers.write(elements, f"{tmp_path}/out")
    assert {n: sorted(r[0] for r in df.collect()) for n, df in done.items()} == {**{f"k{k}": list(range(k, 100, 4)) for k in range(4)}, "none": []}
    assert done["k3"].columns == ["id", "c3"]


def test_callbacks_by_kind(spark):
    rows = [("node", 1, 1.5, None), ("way", 2, None, [1, 3]), ("way", 3, None, []), ("relation", 4, None, None)]
    elements = spark.createDataFrame(rows, "kind string, id long, lat double, refs array<long>")

    def lats(batches):
        for b in batches:
            assert list(b.columns) == ["id", "lat"]
            yield b

    def sizes(batches):
        for b in batches:
            yield b.assign(n=b["refs"].map(len))[["id", "n"]]

    made = assembly.for_each_kind(elements, {"node": (["id", "lat"], lats, "id long, lat double"), "way": (["id", "refs"], sizes, "id long, n long")})
    assert [tuple(r) for r in made["node"].collect()] == [(1, 1.5)]
    assert sorted(tuple(r) for r in made["way"].collect()) == [(2, 2), (3, 0)]


def test_box_query_prunes_row_groups(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(20_000):
        x, y, w, h = rnd.randrange(2**31 - 2**20), rnd.randrange(2**31 - 2**20), rnd.choice([0, 100, 2**20]), rnd.choice([0, 50, 2**19])
        rows.append((i, x, y, x + w, y + h))
    rows += [(20_000, 0, 0, 2**31 - 1, 2**31 - 1), (20_001, 2**30 - 5, 5, 2**30 + 5, 9)]
    objects = spark.createDataFrame(rows, "id long, minx long, miny long, maxx long, maxy long").repartition(1)
    mapobj.write_quad_map(objects, f"{tmp_path}/map", **{"parquet.block.size": 1 << 14, "parquet.block.row.check.min": 100, "parquet.page.row.count.limit": 200})
    stored = spark.read.parquet(f"{tmp_path}/map")
    for box in ((2**29, 2**28, 2**29 + 2**26, 2**28 + 2**26), (0, 0, 10, 10), (2**30 - 100, 0, 2**30 + 100, 2**30), (0, 0, 2**31 - 1, 2**31 - 1)):
        want = {r[0] for r in rows if r[1] <= box[2] and r[3] >= box[0] and r[2] <= box[3] and r[4] >= box[1]}
        found = mapobj.quad_query(stored, box)
        assert {r["id"] for r in found.collect()} == want
        above, intervals = mapobj.quad_intervals(box)
        assert len(intervals) <= 40 and len(above) <= 200
    narrow = mapobj.quad_query(stored, (2**29, 2**28, 2**29 + 2**26, 2**28 + 2**26))
    rows_read = _scanned(narrow)
    assert 0 < rows_read < len(rows) / 4


def _scanned(df):
    """Rows that the scan has given, after the row groups that it left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        at = todo.pop()
        if at.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            at = at.executedPlan()
        if at.getClass().getSimpleName() == "FileSourceScanExec":
            return at.metrics().apply("numOutputRows").value()
        children = at.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_extract_source_decodes_the_wanted_kinds_only(spark, tmp_path, monkeypatch):
    schema = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, members array<struct<id:long,type:int,role:string>>"
    rows = [("node", i, 1.0, 2.0, {}, None, None) for i in range(50)] + [("way", 100 + i, None, None, {"a": "b"}, [1, 2], None) for i in range(20)] + [("relation", 200, None, None, {}, None, [(1, 0, "x")])]
    pbf.write_extract(spark.createDataFrame(rows, schema).repartition(2), str(tmp_path / "x"), per_block=10)
    reader = pbf.PushingReader({"path": str(tmp_path / "x")})
    left = list(reader.pushFilters([EqualTo(("kind",), "way"), GreaterThan(("id",), 105)]))
    assert left == [GreaterThan(("id",), 105)]
    dense = []
    whole = pbf._gathered
    monkeypatch.setattr(pbf, "_gathered", lambda message: dense.append(1) or whole(message))
    got = [r[1] for part in reader.partitions() for r in reader.read(part)]
    assert sorted(got) == list(range(100, 120)) and len(dense) == 20  # ways alone, one group message each
    both = pbf.PushingReader({"path": str(tmp_path / "x")})
    assert list(both.pushFilters([In(("kind",), ("way", "relation")), EqualTo(("kind",), "relation")])) == []
    assert [r[1] for part in both.partitions() for r in both.read(part)] == [200]
    spark.dataSource.register(pbf.PbfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        ways = spark.read.format("osmpbf").option("pushFilters", True).load(str(tmp_path / "x")).where("kind = 'way' AND id > 105")
        assert sorted(r["id"] for r in ways.select("id").collect()) == list(range(106, 120))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    some = spark.read.format("osmpbf").option("kinds", "way, relation").load(str(tmp_path / "x"))
    assert some.where("kind = 'node'").count() == 0 and some.count() == 21


def test_buildings_follow_merged_streets(spark):
    rnd = random.Random(8)
    streets = {i: rnd.choice([i, i - i % 5]) for i in range(40)}
    rows = [(rnd.randrange(45), rnd.randrange(30), f"h{k}") for k in range(300)]
    want = {}
    for s, b, h in sorted(rows):
        want.setdefault((streets.get(s, s), b), h)
    buildings = spark.createDataFrame(rows, "street_id long, building_id long, housenumber string")
    merged = spark.createDataFrame(list(streets.items()), "street_id long, merged_id long")
    out = address.rewrite_buildings(buildings, merged)
    assert out.columns == buildings.columns
    got = out.collect()
    assert len(got) == len(want)
    assert {(r["street_id"], r["building_id"]): r["housenumber"] for r in got} == want
