"""Generalised levels, chains and labels against plain versions; the render set's values."""

import math
import random
import time

import numpy as np
import pytest

from geoloom.operators import generalise, geometry, roads, rules, style
from geoloom.plans.mapping import STYLE


def _merged(lines):
    """C24 by its rule: at each node the k-th smallest that ends goes on in the k-th that begins."""
    out, after, before = [], {}, {}
    lines = {x[0]: x for x in lines}
    places = {(x[1], tuple(x[2]), x[4][p]) for x in lines.values() for p in (0, -1)}
    for level, types, node in places:
        same = sorted(x for x in lines.values() if (x[1], tuple(x[2])) == (level, types))
        for a, b in zip([x[0] for x in same if x[4][-1] == node], [x[0] for x in same if x[4][0] == node], strict=False):
            if a != b:
                after[a], before[b] = b, a
    seen = set()
    for first in [i for i in sorted(lines) if i not in before] + sorted(lines):
        if first in seen:
            continue
        chain = [first]
        while (n := after.get(chain[-1])) is not None and n != first:
            chain.append(n)
        seen |= set(chain)
        names = {lines[i][3] for i in chain}
        nodes = lines[first][4] + [n for i in chain[1:] for n in lines[i][4][1:]]
        out.append((lines[first][1], tuple(lines[first][2]), tuple(chain), tuple(nodes), names.pop() if len(names) == 1 else None))
    return out


def _walked(lines):
    """The walk over all lines at once, from the smallest unvisited id backwards, then forwards."""
    out, seen = [], set()
    lines = sorted(lines)
    fits = lambda line, at, node: next((x for x in lines if x[0] not in seen and x[1:3] == line[1:3] and x[4][at] == node), None)
    for line in lines:
        if line[0] in seen:
            continue
        seen.add(line[0])
        chain, nodes, name = [line[0]], list(line[4]), line[3]
        for at in (-1, 0):
            while (x := fits(line, at, nodes[0] if at else nodes[-1])) is not None:
                seen.add(x[0])
                chain = [x[0], *chain] if at else [*chain, x[0]]
                nodes = [*x[4], *nodes[1:]] if at else [*nodes, *x[4][1:]]
                name = name if x[3] == name else None
        out.append((line[1], tuple(line[2]), tuple(chain), tuple(nodes), name))
    return out


LINES = "id long, level int, types array<int>, name string, node_ids array<long>"


def _chains(df):
    return sorted(((r["level"], tuple(r["types"]), tuple(r["line_ids"]), tuple(r["node_ids"]), r["name"]) for r in geometry.merge_lines(df).collect()), key=str)


@pytest.mark.parametrize("n_nodes", [12, 60])
def test_merged_lines_match_their_rule(spark, n_nodes):
    rnd = random.Random(n_nodes)
    rows = [(i, rnd.randint(0, 1), [rnd.randint(1, 2)], rnd.choice("ab"), [rnd.randint(1, n_nodes) for _ in range(rnd.randint(1, 3))]) for i in range(150)]
    df = spark.createDataFrame(rows, LINES)
    got = _chains(df)
    assert got == sorted(_merged(rows), key=str)
    assert max(len(r[2]) for r in got) > 3
    assert geometry.merge_lines(df.limit(0)).count() == 0


def test_merged_lines_match_a_walk_where_that_is_unique(spark):
    """Every node has one line that ends and one that begins, so the lines make chains."""
    rnd = random.Random(6)
    rows, ids = [], iter(rnd.sample(range(1000), 400))
    for chain in range(25):
        nodes = list(range(100 * chain, 100 * chain + 20))
        while len(nodes) > 1:
            n = min(len(nodes) - 1, rnd.randint(1, 4))
            rows.append((next(ids), chain % 2, [7], rnd.choice(["a", "a", "b"]) if chain % 3 else "a", nodes[: n + 1]))
            nodes = nodes[n:]
    rows += [(2000, 0, [7], None, [5000, 5001]), (2001, 0, [7], None, [5001, 5002]), (2002, 0, [8], "x", [6000])]
    assert _chains(spark.createDataFrame(rows, LINES)) == sorted(_walked(rows), key=str) == sorted(_merged(rows), key=str)


def test_long_chains_and_circles(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(10**6), 1500 + 64 + 7)
    rows = [(i, 1, [7], "n", [k, k + 1]) for k, i in enumerate(ids[:1500])]
    for circle, base in ((ids[1500:1564], 10_000), (ids[1564:], 20_000)):
        rows += [(i, 1, [7], "n", [base + k, base + (k + 1) % len(circle)]) for k, i in enumerate(circle)]
    got = {tuple(r["line_ids"]): r["node_ids"] for r in geometry.merge_lines(spark.createDataFrame(rows, LINES)).collect()}
    turned = lambda c: tuple(c[(k := c.index(min(c))) :] + c[:k])
    assert set(got) == {tuple(ids[:1500]), turned(ids[1500:1564]), turned(ids[1564:])}
    assert got[tuple(ids[:1500])] == list(range(1501))


def test_lines_without_nodes(spark):
    rows = [(1, 0, [1], "a", None), (2, 0, [1], None, []), (3, 0, [1], "a", [5])]
    got = sorted((r["line_ids"], r["node_ids"], r["name"]) for r in geometry.merge_lines(spark.createDataFrame(rows, LINES)).collect())
    assert got == [([1], [], "a"), ([2], [], None), ([3], [5], "a")]


def test_chained_roads_match_mutual_choice(spark):
    rnd = random.Random(4)
    place = {n: (rnd.uniform(0, 1), rnd.uniform(0, 1)) for n in range(40)}
    rows = []
    for i in range(160):
        nodes = rnd.sample(range(40), rnd.choice([1, 2, 2, 3]))
        rows.append((i, rnd.choice("pq"), None, rnd.choice(["x", None]), nodes, [place[n][0] for n in nodes], [place[n][1] for n in nodes]))
    df = spark.createDataFrame(rows, "id long, class string, ref string, name string, node_ids array<long>, lats array<double>, lons array<double>")
    ends = []
    for i, cls, _, name, nodes, a, o in rows:
        if len(nodes) > 1:
            ends += [((i, s), (cls, name, nodes[p]), math.atan2(a[q] - a[p], o[q] - o[p])) for s, (p, q) in enumerate(((0, 1), (-1, -2)))]
    best = {}
    for e, key, u in ends:
        turns = [(abs(math.degrees(math.pi - abs((u - v + math.pi) % (2 * math.pi) - math.pi))), f) for f, k, v in ends if k == key and f[0] != e[0]]
        if turns and min(turns)[0] < 90:
            best[e] = min(turns)[1]
    links = {frozenset((e[0], f[0])) for e, f in best.items() if best.get(f) == e}
    got = [r["road_ids"] for r in geometry.chain_roads(df).collect()]
    assert sorted(i for c in got for i in c) == list(range(160))
    assert all(frozenset(p) in links for c in got for p in zip(c[:-1], c[1:], strict=True))
    chain_of = {i: n for n, c in enumerate(got) for i in c}
    assert all(len({chain_of[i] for i in pair}) == 1 for pair in links) and len(links) > 20
    assert geometry.chain_roads(df.limit(0)).count() == 0


def test_merged_roads_keep_paths_and_common_types(spark):
    rnd = random.Random(14)
    rows, chains = [], []
    for c in range(40):
        n, parts = rnd.randint(1, 6), []
        path = [100 * c + k for k in range(3 * n + 1)]
        for k in range(n):
            nodes = path[3 * k : 3 * k + 4]
            nodes = nodes[::-1] if rnd.random() < 0.5 else nodes
            parts.append((10 * c + k, "p", None, f"n{c}", rnd.choice([[1, 2], [2, 1, 3], [2], None]), nodes, [48 + v * 1e-3 for v in nodes], [11 - v * 1e-3 for v in nodes]))
        rows += parts
        chains.append((10 * c, [p[0] for p in parts]))
    rows.append((999, "p", None, None, [4], [], [], []))
    chains.append((999, [999]))
    schema = "id long, class string, ref string, name string, add_types array<int>, node_ids array<long>, lats array<double>, lons array<double>"
    by = {r[0]: r for r in rows}
    got = roads.merged_roads(spark.createDataFrame(rows, schema), spark.createDataFrame(chains, "chain long, road_ids array<long>")).collect()
    assert {r["chain"]: r["road_ids"] for r in got} == dict(chains)
    for r in got:
        own = [by[i] for i in r["road_ids"]]
        want = list(range(10 * r["chain"], 10 * r["chain"] + 3 * len(own) + 1)) if r["chain"] != 999 else []
        assert r["node_ids"] in (want, want[::-1])
        assert r["lats"] == [48 + v * 1e-3 for v in r["node_ids"]] and r["lons"] == [11 - v * 1e-3 for v in r["node_ids"]]
        common = set.intersection(*(set(p[4] or []) for p in own))
        assert set(r["add_types"]) == common and (r["name"], r["class"]) == (own[0][3], "p")
        tile = lambda a, o: (math.floor((o + 180) / 360 * 2**15) << 15) + math.floor((1 - math.log(math.tan(math.radians(a)) + 1 / math.cos(math.radians(a))) / math.pi) / 2 * 2**15)
        assert r["clusters"] == sorted({tile(a, o) for a, o in zip(r["lats"], r["lons"], strict=True)})


def test_labels_match_comparison_with_all(spark):
    rnd = random.Random(8)
    rows = [(str(i % 2), i, i % 5, rnd.uniform(-300, 300), rnd.uniform(-300, 300), rnd.uniform(5, 60), rnd.uniform(5, 15)) for i in range(600)]
    want = {}
    for tile in "01":
        kept = []
        for _, i, _, x, y, w, h in sorted((r for r in rows if r[0] == tile), key=lambda r: (r[2], r[1])):
            apart = lambda d, size: (size / 2 + 1) / d if d else math.inf
            scale = max([1.0, *(min(apart(abs(x - a), w + c), apart(abs(y - b), h + d)) for a, b, c, d in kept)])  # noqa: B023
            if scale <= 2:
                kept.append((x, y, w, h))
                want[i] = scale
    df = spark.createDataFrame([*rows, ("0", 999, 0, None, 1.0, 1.0, 1.0)], "tile string, id long, prio int, x double, y double, w double, h double")
    assert {r["id"]: r["scale"] for r in geometry.place_labels(df, 2.0).collect()} == want
    assert 0 < len(want) < 600


def test_levels_are_generalised(spark):
    catalogue = [
        {"tag": "highway", "value": "motorway", "minzoom": 11, "maxzoom": 31}, {"tag": "highway", "value": "path", "minzoom": 15, "maxzoom": 31},
        {"tag": "natural", "value": "coastline", "minzoom": 11, "maxzoom": 31}, {"tag": "place", "value": "town", "minzoom": 11, "maxzoom": 31},
    ]
    table = rules.rule_table(spark, catalogue)
    coast = next(r["rule_id"] for r in table.collect() if r["value"] == "coastline")
    rnd = random.Random(2)
    place = {n: (48 + n * 0.002 + rnd.uniform(0, 1e-3), 11 + n * 0.002 + rnd.uniform(0, 1e-3)) for n in range(60)}
    place |= {n: (48 + (n - 60) * 1e-6, 12.0) for n in range(60, 70)}  # too small to be seen
    place |= {70 + k: (48 + 0.05 * math.sin(k / 4 * math.pi), 12 + 0.05 * math.cos(k / 4 * math.pi)) for k in range(8)}
    ways = {
        1: ("highway", "motorway", list(range(0, 30))), 2: ("highway", "motorway", list(range(29, 60))), 3: ("highway", "path", [0, 1, 2]),
        4: ("highway", "motorway", [60, 61]), 5: ("natural", "coastline", [62, 63]), 6: ("place", "town", [5]), 7: ("highway", "motorway", [*range(70, 78), 70]),
        8: ("highway", "motorway", []),
    }
    entities = spark.createDataFrame([(i, {k: v, "name": "n"}, False) for i, (k, v, _) in ways.items()], "id long, tags map<string,string>, is_node boolean")
    at = lambda nodes, c: [place[n][c] for n in nodes]
    shapes = spark.createDataFrame([(i, n, at(n, 0), at(n, 1)) for i, (_, _, n) in ways.items()], "id long, node_ids array<long>, lats array<double>, lons array<double>")
    nodes = spark.createDataFrame([(n, *p) for n, p in place.items()], "id long, lat double, lon double")
    got = {(r["level"], r["id"]): r for r in generalise.generalise(entities, shapes, nodes, table, coastline=coast).collect()}

    want = {(0, i): ("full", at(n, 0)) for i, (_, _, n) in ways.items() if n}
    for level, high in ((1, 14), (2, 12), (3, 11)):
        want[level, 6] = ("point", at([5], 0))
        path = lambda n, zoom: at([n[k] for k in geometry.simplified_points(np.array(at(n, 0)), np.array(at(n, 1)), zoom, 3.0)], 0)
        want[level, 1] = ("line", path(list(range(60)), high + 9))
        want[level, 5] = ("line", path([62, 63], high + 9))
        want[level, 7] = ("cycle", path(ways[7][2], high + 9))
    assert {k: (r["form"], r["lats"]) for k, r in got.items()} == {k: v for k, v in want.items() if v[1]}
    assert len(got[3, 1]["lats"]) < 60 and got[3, 1]["name"] == "n" and got[3, 1]["add_types"] == []
    assert got[0, 1]["min_lat"] == min(at(ways[1][2], 0)) and got[0, 1]["max_lon"] == max(at(ways[1][2], 1))


def test_geometry_is_written_once(spark, monkeypatch):
    """A shape that is seen at all four levels is one row of what I4 writes, and a merged line has its points once."""
    kept = []
    monkeypatch.setattr(generalise, "written", lambda df, write=generalise.written: kept.append(write(df)) or kept[-1])
    table = rules.rule_table(spark, [{"tag": "highway", "value": "motorway", "minzoom": 1, "maxzoom": 31}])
    nodes = [(n, 48 + n / 500, 11 + n / 700) for n in range(40)]
    shapes = [(i, [4 * i + k for k in range(4)], [nodes[4 * i + k][1] for k in range(4)], [nodes[4 * i + k][2] for k in range(4)]) for i in range(9)]
    frames = spark.createDataFrame([(i, {"highway": "motorway"}, False) for i in range(9)], "id long, tags map<string,string>, is_node boolean")
    shapes = spark.createDataFrame(shapes, "id long, node_ids array<long>, lats array<double>, lons array<double>")
    made = generalise.generalise(frames, shapes, spark.createDataFrame(nodes, "id long, lat double, lon double"), table)
    assert {(r["level"], r["count"]) for r in made.groupBy("level").count().collect()} == {(level, 9) for level in range(4)}
    assert [df.count() for df in kept] == [9, 27] and "pts" not in kept[1].columns


def test_render_set_values(spark):
    def row(i, tag, value, level=0, x=200, n=2):
        pts = [(x + k, 200 + i) for k in range(n)]
        box = (min(p[0] for p in pts), max(p[0] for p in pts), 200 + i, 200 + i)
        return (i, level, [(tag, value)], [], {"name": f"n{i}"}, False, pts, *box)

    rows = [row(i, "highway", "residential") for i in range(1, 13)] + [
        row(20, "highway", "motorway", n=5), row(30, "highway", "motorway", x=5000), row(31, "highway", "primary", level=1), row(40, "amenity", "cafe", n=1),
    ]
    schema = (
        "id long, level int, types array<struct<tag:string,value:string>>, additional array<string>, names map<string,string>, area boolean, "
        "pts array<struct<x:long,y:long>>, minx long, maxx long, miny long, maxy long"
    )
    levels = spark.createDataFrame([(0, 15, 22), (1, 11, 14)], "level int, minzoom int, maxzoom int")
    made = style.render_set(spark.createDataFrame(rows, schema), levels, style.read_style(STYLE), (100, 100, 600, 500), 15)
    got = [(r["id"], r["kind"], r["z"], r["n_points"]) for r in made["primitives"].collect()]
    assert got == [*((i, 2, 40.0, 2) for i in range(4, 13)), (20, 2, 60.0, 5), (40, 1, 90.0, 1)]  # ten lines win the tile
    texts = {(r["id"], r["text"], r["size"], r["color"]) for r in made["texts"].collect()}
    assert texts == {(i, f"n{i}", 12.0, 0xFF102030) for i in [*range(1, 13), 20]}
    assert [(r["id"], r["icon"]) for r in made["icons"].collect()] == [(40, "cup")]


def test_long_chain_is_joined_in_one_pass():
    n = 60_000
    parts = [([k, k + 1], [0.0, 0.0], [float(k), k + 1.0]) if k % 2 else ([k + 1, k], [0.0, 0.0], [k + 1.0, float(k)]) for k in range(n)]
    begun = time.perf_counter()
    nodes, lats, lons = roads._joined_path(parts)
    assert nodes == list(range(n + 1)) and lons == [float(k) for k in range(n + 1)] and len(lats) == n + 1
    assert time.perf_counter() - begun < 4


def test_cycles_are_simplified_once(spark):
    """The filter on what is kept isn't a second call of the function."""
    rings = spark.createDataFrame([(1, [48.0, 48.1, 48.1, 48.0], [11.0, 11.0, 11.1, 11.0])], "id long, lats array<double>, lons array<double>")
    made = geometry.simplify_cycles(rings, 14)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and made.count() == 1
