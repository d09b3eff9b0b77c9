"""Labels across tiles and their turns against brute force; coast, islands and backgrounds."""

import math
import random

import numpy as np
import pytest

from geoloom.operators import coast, labels, style

SCHEMA = "id long, prio int, x double, y double, w double, h double"


def test_labels_of_neighbouring_tiles_dont_overlap(spark):
    df = spark.createDataFrame([(1, 0, 99.0, 50.0, 60.0, 10.0), (2, 0, 101.0, 50.0, 60.0, 10.0), (3, 0, 400.0, 50.0, 60.0, 10.0)], SCHEMA)
    assert sorted(r["id"] for r in labels.place_map_labels(df, 100.0).collect()) == [1, 3]


@pytest.mark.parametrize("tile", [10.0, 150.0, 5000.0])
def test_labels_against_brute_force(spark, tile):
    rnd = random.Random(int(tile))
    rows = [(i, i % 4, rnd.uniform(-700, 700), rnd.uniform(-700, 700), rnd.uniform(5, 60), rnd.uniform(5, 15)) for i in range(700)]
    odd = [(900, 0, None, 1.0, 1.0, 1.0), (901, 0, 3000.0, 3000.0, 5.0, 5.0), (902, 0, 3000.0, 3000.0, 5.0, 5.0)]
    got = {r["id"]: r for r in labels.place_map_labels(spark.createDataFrame(rows + odd, SCHEMA), tile, 2.0).collect()}
    reach = math.hypot(max(r[4] for r in rows) + 2, max(r[5] for r in rows) + 2) + 1e-9
    side = max(tile, reach)
    colour = lambda r: math.floor(r[2] / side) % 2 + 2 * (math.floor(r[3] / side) % 2)
    kept, want = [], {}
    for r in sorted(rows + odd[1:], key=lambda r: (colour(r), r[1], r[0])):
        need = [((a, b, w, h, s), min((r[4] + w) / 2 + 1, math.inf) / abs(r[2] - a) if r[2] != a else math.inf, ((r[5] + h) / 2 + 1) / abs(r[3] - b) if r[3] != b else math.inf) for a, b, w, h, s in kept]
        scale = max([1.0, *(min(u, v) for _, u, v in need)])
        if scale <= 2:
            kept.append((*r[2:], scale))
            want[r[0]] = scale
    assert {i: r["scale"] for i, r in got.items()} == pytest.approx(want)
    assert 0 < len(want) < 700 and (901 in want) != (902 in want)
    by = {r[0]: r for r in rows}
    for a in got:
        for b in got:
            if a < b and b in by:
                s = max(got[a]["scale"], got[b]["scale"])
                assert abs(by[a][2] - by[b][2]) * s >= (by[a][4] + by[b][4]) / 2 + 1 - 1e-6 or abs(by[a][3] - by[b][3]) * s >= (by[a][5] + by[b][5]) / 2 + 1 - 1e-6
    assert labels.place_map_labels(spark.createDataFrame([], SCHEMA), tile).count() == 0


def test_free_turns_against_turning():
    rnd = np.random.default_rng(2)
    dx, dy = rnd.uniform(-40, 40, (2, 200))
    w, h = rnd.uniform(5, 30, 200), rnd.uniform(2, 10, 200)
    first, last = labels.free_turn(dx, dy, w, h)
    turns = np.linspace(0, 2 * math.pi, 20_001)[:-1]
    for i in range(200):
        far, at = math.hypot(dx[i], dy[i]), math.atan2(dy[i], dx[i])
        hit = turns[(np.abs(far * np.cos(at + turns)) < w[i]) & (np.abs(far * np.sin(at + turns)) < h[i])]
        if len(hit):
            assert first[i] == pytest.approx(hit[0], abs=1e-3) and last[i] == pytest.approx(hit[-1], abs=1e-3)
        else:
            assert first[i] >= last[i] or last[i] - first[i] < 1e-3
    assert (first < 2 * math.pi).any() and (first == 2 * math.pi).any()


BOXES = "tile string, min_x long, min_y long, max_x long, max_y long"
OBJECTS = "tile string, id long, types array<struct<tag:string,value:string>>, pts array<struct<x:long,y:long>>"


def shoelace(pts):
    return abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(pts[:-1], pts[1:], strict=True))) / 2


def test_ground_of_tiles(spark):
    """Tiles of 100 x 100: a coast across, an island (land on its left, y downwards), roads only, nothing."""
    line = [("natural", "coastline")]
    boxes = spark.createDataFrame([(n, 100 * i, 0, 100 * i + 100, 100) for i, n in enumerate(("across", "island", "road", "empty"))], BOXES)
    island = [(140, 40), (140, 60), (160, 60), (160, 40), (140, 40)]
    rows = [("across", 1, line, [(-10, 30), (110, 30)]), ("island", 2, line, island), ("road", 3, [("highway", "path")], [(210, 10), (290, 90)])]
    got = {}
    for r in coast.coast_areas(spark.createDataFrame(rows, OBJECTS), boxes).collect():
        got[r["tile"], r["types"][0]["value"]] = (r["area"], shoelace(r["pts"]), r["pts"][0] == r["pts"][-1])
        assert r["id"] < 0 and r["additional"] == ["layer=lowest"]
    assert got == {
        ("across", "land"): (True, 3000.0, True), ("island", "land"): (True, 400.0, True), ("island", "coastline"): (True, 10000.0, True),
        ("road", "coastline_broken"): (False, 10000.0, True), ("empty", "coastline_broken"): (False, 10000.0, True),
    }


def test_render_set_draws_the_ground(spark):
    xml = """<style><order><filter tag="natural" value="land" objectType="3" order="2"/><filter tag="natural" value="coastline" objectType="3" order="1"/>
    <filter tag="natural" value="coastline_broken" objectType="3" order="0"/></order></style>"""
    schema = (
        "id long, level int, types array<struct<tag:string,value:string>>, additional array<string>, names map<string,string>, area boolean, "
        "pts array<struct<x:long,y:long>>, minx long, maxx long, miny long, maxy long"
    )
    levels = spark.createDataFrame([(0, 15, 22)], "level int, minzoom int, maxzoom int")
    island = [(3000, 3000), (3000, 6000), (6000, 6000), (6000, 3000), (3000, 3000)]
    row = (7, 0, [("natural", "coastline")], [], {}, False, island, 3000, 6000, 3000, 6000)
    drawn = lambda rows, box: sorted((r["value"], r["kind"], r["id"] < 0) for r in style.render_set(spark.createDataFrame(rows, schema), levels, style.read_style(xml), box, 15)["primitives"].collect())
    assert drawn([row], (0, 0, 20000, 20000)) == [("coastline", 3, False), ("coastline", 3, True), ("land", 3, True)]
    assert drawn([row], (30000, 0, 40000, 20000)) == [("coastline_broken", 3, True)]
