"""Sources on files that the tests write."""

import struct
import zlib

import pytest

from geoloom.operators import rules
from geoloom.sources import pbf, shapefile, stores


def varint(v):
    out = b""
    while True:
        out += bytes([v & 0x7F | (0x80 if v > 0x7F else 0)])
        v >>= 7
        if not v:
            return out


def zig(v):
    return (v << 1) ^ (v >> 63)


def num(field, v):
    return varint(field << 3) + varint(v)


def msg(field, b):
    return varint(field << 3 | 2) + varint(len(b)) + b


def packed(values, z=False):
    return b"".join(varint(zig(v) & (2**64 - 1) if z else v) for v in values)


def deltas(values):
    return [b - a for a, b in zip([0, *values], values)]


def blob(kind, data, compress):
    body = num(2, len(data)) + msg(3, zlib.compress(data)) if compress else msg(1, data)
    head = msg(1, kind) + num(3, len(body))
    return struct.pack(">I", len(head)) + head + body


@pytest.fixture
def extract(tmp_path):
    strings = [b"", b"place", b"town", b"highway", b"primary", b"boundary", b"administrative", b"outer", b"inner"]
    table = msg(1, b"".join(msg(1, s) for s in strings))
    lats, lons, ids = [400000000, 400000010, 400000020], [-50000000, -49999990, -49999980], [10, 11, 13]
    dense = msg(1, packed(deltas(ids), True)) + msg(8, packed(deltas(lats), True)) + msg(9, packed(deltas(lons), True)) + msg(10, packed([1, 2, 0, 0, 0]))
    nodes = table + msg(2, msg(2, dense))
    way = lambda i, k, v, refs: msg(3, num(1, i) + msg(2, packed(k)) + msg(3, packed(v)) + msg(8, packed(deltas(refs), True)))
    ways = table + msg(2, way(5, [3], [4], [10, 11, 13]) + way(6, [5], [6], [13, 10]))
    relation = num(1, 7) + msg(2, packed([5])) + msg(3, packed([6])) + msg(8, packed([7, 8, 7])) + msg(9, packed(deltas([5, 6, 5]), True)) + msg(10, packed([1, 1, 1]))
    path = tmp_path / "tiny.osm.pbf"
    path.write_bytes(
        blob(b"OSMHeader", b"", False) + blob(b"OSMData", nodes, False) + blob(b"OSMData", ways, True) + blob(b"OSMData", table + msg(2, msg(4, relation)), True)
    )
    return path


def test_extract_scan(spark, extract):
    spark.dataSource.register(pbf.PbfSource)
    rows = spark.read.format("osmpbf").load(str(extract)).collect()
    nodes = {r["id"]: r for r in rows if r["kind"] == "node"}
    assert set(nodes) == {10, 11, 13} and nodes[10]["tags"] == {"place": "town"} and nodes[11]["tags"] == {}
    assert nodes[13]["lat"] == pytest.approx(40.000002) and nodes[13]["lon"] == pytest.approx(-4.999998)
    ways = {r["id"]: r for r in rows if r["kind"] == "way"}
    assert ways[5]["refs"] == [10, 11, 13] and ways[6]["tags"] == {"boundary": "administrative"}
    relation = next(r for r in rows if r["kind"] == "relation")
    assert [tuple(m) for m in relation["members"]] == [(5, 1, "outer"), (6, 1, "inner"), (5, 1, "outer")]


def test_long_header_is_refused(tmp_path):
    path = tmp_path / "bad.pbf"
    path.write_bytes(struct.pack(">I", 70_000) + b"x" * 10)
    store, inside = stores.store_of(f"file:{path}")
    with store.open_input_file(inside) as f, pytest.raises(ValueError, match="header"):
        list(pbf.blob_ranges(f, 0, 100))


def test_ranges_cover_each_blob_once(spark, extract):
    """Whatever the ranges, also where a header's mark stands inside a blob."""
    spark.dataSource.register(pbf.PbfSource)
    trap = extract.parent / "trap.osm.pbf"
    trap.write_bytes(extract.read_bytes() + blob(b"OSMData", msg(1, msg(1, b"x\0\0\0\x0b" + pbf.MARK + b"\x18\x05" * 40)), False))
    for step in (7, 64, 100, 1000):
        rows = spark.read.format("osmpbf").option("rangeBytes", step).load(str(trap)).collect()
        assert sorted((r["kind"], r["id"]) for r in rows) == [("node", 10), ("node", 11), ("node", 13), ("relation", 7), ("way", 5), ("way", 6)]
    both = spark.read.format("osmpbf").option("pathGlobFilter", "T*.PBF").load(f"file:{extract.parent}")
    assert both.count() == 12


def test_written_extract_reads_back(spark, extract, tmp_path):
    spark.dataSource.register(pbf.PbfSource)
    rows = spark.read.format("osmpbf").load(str(extract))
    pbf.write_extract(rows, str(tmp_path / "out"), per_block=2)
    back = spark.read.format("osmpbf").load(str(tmp_path / "out"))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(back) == plain(rows)


def record(number, body):
    return struct.pack(">ii", number, len(body) // 2) + body


def test_shapes_and_attributes(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    polygon = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in square)
    pointz = struct.pack("<i4d", 11, 10.0, 20.0, 30.0, 40.0)
    multi = struct.pack("<i4di", 8, 0, 0, 1, 1, 2) + struct.pack("<4d", 1.15, 2.25, 3.15, 2.25)
    body = record(1, polygon) + record(2, pointz) + record(3, struct.pack("<i", 0)) + record(4, multi)
    (tmp_path / "A.SHP").write_bytes(b"\0" * 100 + body)
    got = {r["rec_no"]: r for r in shapefile.read_shapes(spark, str(tmp_path)).collect()}
    assert got[0]["type"] == 5 and got[0]["parts"] == [0] and got[0]["maxx"] == 1.0 and len(got[0]["x"]) == 5
    assert got[1]["z"] == [30.0] and got[1]["m"] == [40.0] and got[2]["x"] == [] and got[2]["minx"] is None
    assert got[3]["x"] == [1.15, 3.15]

    fields = [(b"ID", b"N", 6, 0), (b"NAME", b"C", 8, 0), (b"AMOUNT", b"N", 8, 2), (b"FLAG", b"L", 1, 0)]
    heads = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields)
    size = 32 + len(heads) + 1
    width = 1 + sum(f[2] for f in fields)
    data = b"\x03\0\0\0" + struct.pack("<IHH", 3, size, width) + b"\0" * 20 + heads + b"\r"
    data += b" " + b"     7" + b"seven   " + b"    1.50" + b"T"
    data += b"*" + b"      " + b"        " + b"********" + b"?"
    data += b" " + b"    12" + b"x       " + b"   -2.00" + b"F"
    (tmp_path / "a.dbf").write_bytes(data)
    attr = {r["rec_no"]: r for r in shapefile.read_attributes(spark, str(tmp_path)).collect()}
    assert (attr[0]["ID"], attr[0]["NAME"], attr[0]["AMOUNT"], attr[0]["FLAG"]) == (7, "seven", 1.5, True)
    assert (attr[1]["ID"], attr[1]["NAME"], attr[1]["AMOUNT"], attr[1]["FLAG"], attr[1]["deleted"]) == (None, None, None, None, True)
    assert attr[2]["AMOUNT"] == -2.0 and attr[2]["FLAG"] is False
    few = shapefile.read_attributes(spark, str(tmp_path), records_per_task=1)
    assert sorted(map(str, few.collect())) == sorted(map(str, attr.values()))
    at, index = 50, b""
    for length in (len(polygon), len(pointz), 4, len(multi)):
        index += struct.pack(">ii", at, length // 2)
        at += 4 + length // 2
    (tmp_path / "a.shx").write_bytes(b"\0" * 100 + index)
    for step in (1, 3, 100):
        ranged = shapefile.read_shapes(spark, str(tmp_path), records_per_task=step).collect()
        assert sorted(map(str, ranged)) == sorted(map(str, got.values()))
    assert shapefile.files(spark, str(tmp_path), "a.s?p").count() == 1


def test_small_ranges_share_tasks(spark, tmp_path):
    """Each range of an extract or a layer isn't a task where ranges are small and many; all are read."""
    spark.dataSource.register(pbf.PbfSource)
    elements = spark.range(3000).selectExpr("'way' AS kind", "id", "CAST(NULL AS DOUBLE) AS lat", "CAST(NULL AS DOUBLE) AS lon", "map('name', concat('w', id)) AS tags", "array(id, -id, id * 1000000007) AS refs")
    elements = elements.selectExpr("*", "CAST(NULL AS array<struct<id:bigint,type:int,role:string>>) AS members")
    pbf.write_extract(elements, str(tmp_path / "ways"), per_block=10)
    back = spark.read.format("osmpbf").option("rangeBytes", 200).load(str(tmp_path / "ways"))
    assert back.rdd.getNumPartitions() <= 2 * pbf.PARTITIONS
    assert sorted(map(str, back.collect())) == sorted(map(str, elements.collect()))

    x, y = "array(0D, 0D, 1D, 0D) AS x", "array(0D, 1D, 1D, 0D) AS y"
    rings = spark.range(2000).selectExpr("'a' AS layer", "id AS order", "false AS deleted", x, y, "id AS ID")
    shapefile.write_layers(rings, str(tmp_path / "layers"), "layer", [("ID", "N", 9, 0)]).collect()
    shapes = shapefile.read_shapes(spark, str(tmp_path / "layers"), records_per_task=1)
    attributes = shapefile.read_attributes(spark, str(tmp_path / "layers"), records_per_task=1)
    assert max(shapes.rdd.getNumPartitions(), attributes.rdd.getNumPartitions()) <= 2 * shapefile.TASKS
    assert sorted(r["rec_no"] for r in shapes.collect()) == list(range(2000))
    assert sorted((r["rec_no"], r["ID"]) for r in attributes.collect()) == [(k, k) for k in range(2000)]


def test_repeated_keys_and_numbers_of_all_sizes(spark, tmp_path):
    """Of a key that an element has twice the first value counts; packed numbers have up to ten bytes."""
    strings = msg(1, b"".join(msg(1, s) for s in (b"", b"a", b"x", b"y", b"a")))
    refs = [0, 2**61, -(2**61), 1, -1, 127, 128, -(2**40)]
    way = lambda i, r: msg(3, num(1, i) + msg(2, packed([1, 4])) + msg(3, packed([2, 3])) + msg(8, packed(deltas(r), True)))
    (tmp_path / "w.osm.pbf").write_bytes(blob(b"OSMData", strings + msg(2, way(1, refs) + way(2, []) + way(3, refs[::-1])), True))
    spark.dataSource.register(pbf.PbfSource)
    rows = {r["id"]: r for r in spark.read.format("osmpbf").load(str(tmp_path)).collect()}
    assert [rows[k]["refs"] for k in (1, 2, 3)] == [refs, [], refs[::-1]] and all(r["tags"] == {"a": "x"} for r in rows.values())


def test_rule_catalogue(spark, tmp_path):
    (tmp_path / "rules.xml").write_text(
        """<rules><category minzoom="12"><type tag="highway" value="primary"/><type tag="oneway" value="yes" kind="additional" apply_to="highway"/></category>
        <category><type tag="amenity" minzoom="14" point="true" poi_category="food"/><type tag="oneway" value="yes" kind="additional"/></category></rules>"""
    )
    got = {(r["tag"], r["value"]): r for r in rules.read_rules(spark, str(tmp_path / "rules.xml")).collect()}
    assert len(got) == 3
    assert got["highway", "primary"]["minzoom"] == 12 and got["highway", "primary"]["maxzoom"] == 31
    assert got["amenity", None]["only_point"] and got["amenity", None]["minzoom"] == 14
    assert got["oneway", "yes"]["kind"] == "additional" and got["oneway", "yes"]["minzoom"] == 12
