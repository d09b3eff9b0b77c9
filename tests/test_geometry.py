"""Invariants of the geometry operators."""

import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.operators import geometry as g

points = st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 1000)), min_size=2, max_size=40)


@given(points, st.floats(0.5, 50), st.booleans())
@settings(deadline=None, max_examples=60)
def test_simplify_keeps_ends_and_error_bound(pts, epsilon, guard):
    x, y = np.array([p[0] for p in pts], float), np.array([p[1] for p in pts], float)
    kept = g.simplify(x, y, epsilon, guard)
    if not kept.any():
        return
    at = np.flatnonzero(kept)
    assert at[0] == 0
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            assert g._off_line(x, y, a, b).max() < epsilon


@given(st.integers(3, 12), st.randoms())
@settings(deadline=None, max_examples=60)
def test_rings_use_every_edge_once(n, rnd):
    ring = list(range(n)) + [0]
    cuts = sorted(rnd.sample(range(1, n), rnd.randint(1, n - 1)))
    ways = [ring[a : b + 1] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    ways = [w[::-1] if rnd.random() < 0.5 else w for w in ways]
    rnd.shuffle(ways)
    out = g.join_ways(ways)
    assert len(out) == 1 and out[0][0] == out[0][-1]
    edges = lambda w: [frozenset(e) for e in zip(w[:-1], w[1:], strict=True)]
    assert sorted(map(sorted, edges(out[0]))) == sorted(map(sorted, edges(ring)))


def test_short_ways_are_left_out():
    assert g.join_ways([[1], [], [1, 2], [3, 2]]) == [[1, 2, 3]]


def test_coast_rings_are_closed_and_inside():
    box = (0.0, 0.0, 10.0, 10.0)
    across = np.array([(-1.0, 4.0), (11.0, 4.0)])
    island = np.array([(2.0, 6.0), (3.0, 6.0), (3.0, 7.0), (2.0, 7.0), (2.0, 6.0)])
    broken = np.array([(5.0, 5.0), (6.0, 6.0)])
    rings, bad = g.coast_polygons([across, island, broken], box)
    assert bad == 1 and len(rings) == 2
    for r in rings:
        assert (r[0] == r[-1]).all() and r.min() >= 0 and r.max() <= 10
    area = max(abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2) for r in rings)
    assert area == pytest.approx(60.0)  # land is on the left of the line, above it


def test_coast_with_many_crossings():
    """Bays next to each other along a side: the next entry is found by halving, not among all."""
    n = 8000
    bays = [np.array([(i + 0.75, -1.0), (i + 0.75, 1.0), (i + 0.25, 1.0), (i + 0.25, -1.0)]) for i in range(n)]
    begun = time.perf_counter()
    rings, broken = g.coast_polygons(bays, (0.0, 0.0, float(n), 10.0))
    assert time.perf_counter() - begun < 20
    area = sum(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 for r in rings)
    assert broken == 0 and abs(area) == pytest.approx(n * 0.5)
    assert len(rings) == n


def test_winding_is_repaired():
    outer = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]  # counter-clockwise: to be turned
    inner = [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]  # clockwise: to be turned
    xs, ys = [p[0] for p in outer + inner], [p[1] for p in outer + inner]
    x, y = g.rewind_rings([0, 5], xs, ys)
    assert g.is_clockwise(np.array(x[:5]), np.array(y[:5]))
    assert not g.is_clockwise(np.array(x[5:]), np.array(y[5:]))
    assert g.rewind_rings([0, 5], x, y) == (x, y)


def test_labels_do_not_overlap(spark):
    rnd = random.Random(3)
    rows = [("t", i, i % 3, rnd.uniform(0, 200), rnd.uniform(0, 200), 30.0, 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "tile string, id long, prio int, x double, y double, w double, h double")
    kept = {r["id"]: r["scale"] for r in g.place_labels(df, 2.0).collect()}
    by = {r[1]: r for r in rows}
    assert 0 < len(kept) < 60
    for a in kept:
        for b in kept:
            if a < b:
                s = max(kept[a], kept[b])
                dx, dy = abs(by[a][3] - by[b][3]) * s, abs(by[a][4] - by[b][4]) * s
                assert dx >= 30 - 1e-6 or dy >= 10 - 1e-6


def test_merged_lines_use_each_line_once(spark):
    rows = [(1, 1, [1], "a", [1, 2]), (2, 1, [1], "a", [2, 3]), (3, 1, [1], "b", [0, 1]), (4, 1, [2], "a", [3, 4]), (5, 1, [1], "a", [9, 8])]
    df = spark.createDataFrame(rows, "id long, level int, types array<int>, name string, node_ids array<long>")
    out = g.merge_lines(df).collect()
    assert sorted(i for r in out for i in r["line_ids"]) == [1, 2, 3, 4, 5]
    chain = next(r for r in out if 1 in r["line_ids"])
    assert list(chain["node_ids"]) == [0, 1, 2, 3] and chain["name"] is None


def test_merged_lines_have_no_limit(spark):
    rows = [(i, 1, [1], "a", [i, i + 1]) for i in range(1, 1501)]
    df = spark.createDataFrame(rows, "id long, level int, types array<int>, name string, node_ids array<long>")
    (r,) = g.merge_lines(df).collect()
    assert list(r["line_ids"]) == list(range(1, 1501)) and list(r["node_ids"]) == list(range(1, 1502)) and r["name"] == "a"


def test_anchor_spacing(spark):
    df = spark.createDataFrame([(1, [0.0, 100.0], [0.0, 0.0])], "id long, xs array<double>, ys array<double>")
    out = g.line_anchors(df, 30.0).orderBy("n").collect()
    assert [r["x"] for r in out] == [30.0, 60.0, 90.0]
    assert [r["min_scale"] for r in out] == [0.5, 8.0, 4.0]


def test_chained_roads(spark):
    rows = [(1, "p", None, "x", [1, 2], [0.0, 0.0], [0.0, 1.0]), (2, "p", None, "x", [2, 3], [0.0, 0.0], [1.0, 2.0]), (3, "p", None, "x", [2, 4], [0.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, class string, ref string, name string, node_ids array<long>, lats array<double>, lons array<double>")
    assert sorted(sorted(r["road_ids"]) for r in g.chain_roads(df).collect()) == [[1, 2], [3]]


def test_end_without_direction_hinders_no_other(spark):
    rows = [(1, "p", None, "x", [1, 2], [0.0, 0.0], [0.0, 1.0]), (2, "p", None, "x", [2, 3], [0.0, 0.0], [1.0, 2.0]), (3, "p", None, "x", [2, 4], [0.0, None], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, class string, ref string, name string, node_ids array<long>, lats array<double>, lons array<double>")
    assert sorted(sorted(r["road_ids"]) for r in g.chain_roads(df).collect()) == [[1, 2], [3]]


def _reduced(points, epsilon, fixed=()):
    """Indexes that Douglas-Peucker keeps, by recursion; `fixed` ones stay."""

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        whole = dx * dx + dy * dy
        k = min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / whole, 0), 1) if whole else 0
        return math.hypot(p[0] - a[0] - k * dx, p[1] - a[1] - k * dy)

    def between(a, b):
        if b - a < 2:
            return []
        far, i = max((off(points[i], points[a], points[b]), -i) for i in range(a + 1, b))
        return [*between(a, -i), -i, *between(-i, b)] if far >= epsilon else []

    stops = sorted({0, len(points) - 1, *fixed})
    return sorted({*stops, *(i for a, b in zip(stops[:-1], stops[1:], strict=True) for i in between(a, b))})


def test_roads_keep_what_is_off_by_metres(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(30):
        lats, lons = [48.0], [11.0]
        for _ in range(rnd.randint(1, 40)):
            lats.append(lats[-1] + rnd.uniform(-2e-4, 3e-4))
            lons.append(lons[-1] + rnd.uniform(-2e-4, 4e-4))
        rows.append((i, lats, lons, [rnd.random() < 0.1 for _ in lats]))
    df = spark.createDataFrame(rows, "id long, lats array<double>, lons array<double>, fixed array<boolean>")
    got = {r["id"]: r["kept"] for r in g.simplify_roads(df, 15.0).collect()}
    metres = math.radians(1) * 6372800
    for i, lats, lons, fixed in rows:
        narrow = math.cos(math.radians(sum(lats) / len(lats)))
        points = [(o * metres * narrow, a * metres) for a, o in zip(lats, lons, strict=True)]
        assert got[i] == _reduced(points, 15.0, [k for k, f in enumerate(fixed) if f])
    assert any(len(got[i]) < len(lats) for i, lats, _, _ in rows)


def test_cycles_go_or_are_simplified(spark):
    def ring(size):  # a circle of so many degrees across, closed
        at = [2 * math.pi * k / 48 for k in range(48)]
        lats, lons = [48 + size / 2 * math.sin(t) for t in at], [11 + size / 2 * math.cos(t) for t in at]
        return lats + lats[:1], lons + lons[:1]

    zoom, smoothness = 10, 2
    sizes = [1e-5, 1e-4, 1e-3, 5e-3, 2e-2, 0.2, 3.0]
    df = spark.createDataFrame([(i, *ring(s)) for i, s in enumerate(sizes)] + [(99, [48.0], [11.0])], "id long, lats array<double>, lons array<double>")
    got = {r["id"]: r["kept"] for r in g.simplify_cycles(df, zoom, smoothness).collect()}
    y_of = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2
    want = {}
    for i, s in enumerate(sizes):
        points = [((o + 180) / 360, y_of(a)) for a, o in zip(*ring(s), strict=True)]
        spans = [[math.floor(p[k] * 2 ** (zoom + 1) * 256) for p in points] for k in (0, 1)]
        w, h = (max(v) - min(v) for v in spans)
        n = 2 ** (zoom + 8 + smoothness)
        scaled = [(x * n, y * n) for x, y in points]
        last = max((k for k, p in enumerate(scaled) if abs(p[0] - scaled[0][0]) + abs(p[1] - scaled[0][1]) >= 1e-3), default=0)
        if last and not ((w <= 2 and h <= 4) or (w <= 4 and h <= 2)):
            want[i] = [*_reduced(scaled[: last + 1], 3.0), 0]
    assert got == want and 0 < len(want) < len(sizes)


def test_close_points_go():
    assert g.skip_close_points(np.array([0.0, 50, 100]), np.array([0.0, 5, 0])) == [0, 2]
    assert g.skip_close_points(np.array([0.0, 50, 100]), np.array([0.0, 500, 0])) == [0, 1, 2]


def test_clip_segment():
    assert g.clip_segment(-5, 5, 15, 5, (0, 0, 10, 10)) == (0, 5, 10, 5)
    assert g.clip_segment(-5, -5, -1, -1, (0, 0, 10, 10)) is None
    assert math.isclose(g.clip_segment(5, 5, 20, 5, (0, 0, 10, 10))[2], 10)


def test_equal_distances_split_as_sql_has_it(spark):
    """Points as far from a segment as each other, where the last bit of the distance decides."""
    import duckdb

    from geoloom.plans.mapping import AS_TILES, _split_sql

    lines = [
        ([40.19257, 40.12021, 40.12021, 40.19257, 40.14433, 40.12021, 40.16845, 40.19257, 40.19257], [-4.91478, -4.90004, -4.94426, -4.8853, -4.8853, -4.90004, -4.8853, -4.8853, -4.92952]),
        ([40.10602, 40.10602, 40.0957, 40.0957, 40.08538, 40.10602, 40.06474, 40.07506, 40.07506, 40.0957], [-4.95291, -4.88299, -4.91795, -4.95291, -4.95291, -4.93543, -4.91795, -4.95291, -4.88299, -4.91795]),
    ]
    rows = ",".join(f"({i},{k},{a}e0,{o}e0)" for i, line in enumerate(lines) for k, (a, o) in enumerate(zip(*line, strict=True)))
    points = f"SELECT id, k, {AS_TILES.format(n=2**15)} FROM (VALUES {rows}) v(id, k, lat, lon)"
    want = sorted(duckdb.sql(f"WITH RECURSIVE {_split_sql(points, 3.0)} SELECT id, k FROM kept").fetchall())
    df = spark.createDataFrame([(i, *line) for i, line in enumerate(lines)], "id long, lats array<double>, lons array<double>")
    assert sorted((r["id"], k) for r in g.simplify_lines(df, 15).collect() for k in r["kept"]) == want


def test_lines_at_once_equal_one_by_one():
    rnd = np.random.default_rng(2)
    sizes = [0, 1, 2, 3000, 0, *rnd.integers(1, 12, 300).tolist(), 0]
    x, y, starts = rnd.random(sum(sizes)) * 50, rnd.random(sum(sizes)) * 50, np.r_[0, np.cumsum(sizes)]
    fixed = rnd.random(len(x)) < 0.2
    for i in range(5, 300, 3):
        x[starts[i + 1] - 1], y[starts[i + 1] - 1] = x[starts[i]], y[starts[i]]
    for stay in (None, fixed):
        got = g.simplify_many(x, y, starts, 3.0, stay)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                assert (got[a:b] == g.simplify(x[a:b], y[a:b], 3.0, fixed=None if stay is None else stay[a:b])).all()
