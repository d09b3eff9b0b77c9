"""Multipolygons as geometry, at all levels."""

import math

import numpy as np
import pytest

from geoloom.operators import generalise, geometry, multipolygon, rules
from geoloom.operators.geometry import inside_ring


def circle(lat, lon, radius, n, wave=0.0, turns=9):
    t = [2 * math.pi * k / n for k in range(n)]
    far = [radius * (1 + wave * math.sin(turns * a)) for a in t]
    return [lat + r * math.sin(a) for r, a in zip(far, t, strict=True)], [lon + r * math.cos(a) for r, a in zip(far, t, strict=True)]


def cut(rel, role, first_id, n, pieces, order):
    """A ring of nodes first_id ... cut into ways; every second one backwards."""
    stops = [n * i // pieces for i in range(pieces + 1)]
    for k, (a, b) in enumerate(zip(stops[:-1], stops[1:], strict=True)):
        ids = [first_id + i % n for i in range(a, b + 1)]
        yield rel, role, order + (k * 3) % pieces, ids[::-1] if k % 2 else ids


@pytest.fixture(scope="module")
def made(spark):
    """Relation 1: two outers with two and one holes; relation 2: a hole outside, and an open ring."""
    rings = [
        (1, "outer", circle(48.0, 11.0, 0.5, 60, 0.1)), (1, "outer", circle(50.0, 11.0, 0.5, 60, 0.1)), (1, "inner", circle(48.2, 11.0, 0.12, 24)),
        (1, "inner", circle(47.8, 11.0, 0.12, 24)), (1, "inner", circle(50.0, 11.0, 0.3, 24)), (2, "outer", circle(10.0, 10.0, 0.2, 16)), (2, "inner", circle(20.0, 10.0, 0.1, 16)),
    ]
    nodes, ways = [], []
    for r, (rel, role, (lats, lons)) in enumerate(rings):
        nodes += [(1000 * r + k, a, o) for k, (a, o) in enumerate(zip(lats, lons, strict=True))]
        ways += cut(rel, role, 1000 * r, len(lats), 4, 10 * r)
    ways.append((2, "outer", 99, [0, 1, 2]))
    frames = spark.createDataFrame(ways, "rel_id long, role string, ord int, node_ids array<long>"), spark.createDataFrame(nodes, "id long, lat double, lon double")
    polygons, rejects = multipolygon.polygons_of_ways(*frames)
    return rings, polygons.collect(), rejects.collect(), frames


def area(lats, lons):
    x, y = np.asarray(lons), np.asarray(lats)
    return abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def test_polygons_of_ways(made):
    rings, polygons, rejects, _ = made
    want = {(1, 0): (60, [24, 24]), (1, 1): (60, [24]), (2, 0): (16, [])}
    assert {(p["rel_id"], p["polygon"]): (len(p["lats"]) - 1, [len(h["lats"]) - 1 for h in p["holes"]]) for p in polygons} == want
    assert len({p["id"] for p in polygons}) == 3
    assert sorted((r["rel_id"], r["reason"]) for r in rejects) == [(2, "inner without outer"), (2, "open ring")]
    closed = lambda ring: ([*ring[0], ring[0][0]], [*ring[1], ring[1][0]])
    assert sum(area(p["lats"], p["lons"]) for p in polygons) == pytest.approx(sum(area(*closed(r)) for _, role, r in rings if role == "outer"))


def test_levels_of_polygons(spark, made):
    _, polygons, _, frames = made
    entities = spark.createDataFrame([(1, {"natural": "water", "name": "W"}, False), (2, {"other": "x"}, False)], "id long, tags map<string,string>, is_node boolean")
    shapes = spark.createDataFrame([], "id long, node_ids array<long>, lats array<double>, lons array<double>")
    table = rules.rule_table(spark, [{"tag": "natural", "value": "water", "minzoom": 11, "maxzoom": 31}])
    polys, _ = multipolygon.polygons_of_ways(*frames)
    rows = generalise.generalise(entities, shapes, frames[1], table, zooms="4-5;6;8;13-", polygons=polys).collect()
    assert {r["form"] for r in rows} <= {"polygon"} and {r["level"] for r in rows} >= {0}
    own = {p["id"]: p for p in polygons if p["rel_id"] == 1}
    assert {r["id"] for r in rows if r["level"] == 0} == set(own)
    for r in rows:
        full = own[r["id"]]
        assert r["name"] == "W" and r["lats"][0] == r["lats"][-1]
        if r["level"] == 0:
            assert (r["lats"], len(r["holes"])) == (full["lats"], len(full["holes"]))


@pytest.mark.parametrize("zoom", [2, 4, 6, 9, 13])
def test_holes_stay_inside(zoom):
    closed = lambda ring: (np.array([*ring[0], ring[0][0]]), np.array([*ring[1], ring[1][0]]))
    outer = closed(circle(48.0, 11.0, 1.0, 400, 0.2, 23))
    holes = [closed(circle(48.0 + a, 11.0 + o, 0.19, 90, 0.1, 7)) for a, o in ((0.5, 0.0), (-0.5, 0.0), (0.0, 0.5), (0.0, 0.05))]
    made = multipolygon.simplified_polygon(outer, holes, zoom)
    assert made is not None
    shell, rest = made
    assert all(inside_ring(h[1], h[0], shell[1], shell[0]).all() for h in rest)
    assert not any(multipolygon._meet(a, b) for i, a in enumerate(rest) for b in [shell, *rest[:i]])
    assert len(shell[0]) <= len(outer[0]) and (len(shell[0]) < 200 or zoom > 4)
    assert len(rest) == 4 or zoom < 6
    assert multipolygon.simplified_polygon(closed(circle(0.0, 0.0, 1e-6, 8)), [], 5) is None


def test_odd_polygons(spark):
    schema = "id long, lats array<double>, lons array<double>, holes array<struct<lats:array<double>,lons:array<double>>>, note string"
    square = [0.0, 0.0, 1.0, 1.0, 0.0], [0.0, 1.0, 1.0, 0.0, 0.0]
    rows = [(1, *square, None, "a"), (2, None, None, [], "b"), (3, [0.0], [0.0], [], "c"), (4, *square, [], "d"), (4, *square, [], "d")]
    out = multipolygon.simplify_polygons(spark.createDataFrame(rows, schema), 8)
    assert sorted((r["id"], len(r["lats"]), r["note"]) for r in out.collect()) == [(1, 5, "a"), (4, 5, "d"), (4, 5, "d")]
    assert multipolygon.simplify_polygons(spark.createDataFrame([], schema), 8).count() == 0


def test_rings_and_polygons_are_made_in_parts(spark):
    """However few bytes the member ways have: they are joined, and holes find their homes, on all cores."""
    ways, nodes = [], []
    for rel in range(40):
        for r, (role, radius) in enumerate((("outer", 0.2), ("inner", 0.1))):
            lats, lons = circle(10.0 + rel, 20.0, radius, 16)
            first = 1000 * rel + 100 * r
            nodes += [(first + k, a, o) for k, (a, o) in enumerate(zip(lats, lons, strict=True))]
            ways += cut(rel, role, first, 16, 4, 0)
    member_ways = spark.createDataFrame(ways, "rel_id long, role string, ord int, node_ids array<long>")
    rings = geometry.assemble_rings(member_ways)
    assert rings.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rings.where("closed").count() == 80
    polygons, rejects = multipolygon.polygons_of_ways(member_ways, spark.createDataFrame(nodes, "id long, lat double, lon double"))
    assert polygons.where("size(holes) = 1 AND size(lats) = 17").count() == 40 and rejects.count() == 0
    assert multipolygon.simplify_polygons(polygons, 12).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
