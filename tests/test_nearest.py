import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_addresses import metres

from geoloom.functions.geo import rounded
from geoloom.operators import nearby, places


def test_nearest_object_matches_brute_force(spark):
    """Clusters, the poles, the antimeridian, places far from all points, equal places, no position."""
    rnd = random.Random(5)
    near = lambda lat, lon, n, d: [(lat + rnd.uniform(-d, d), (lon + rnd.uniform(-d, d) + 180) % 360 - 180) for _ in range(n)]
    objects = near(40, -5, 60, 0.1) + near(-17, 180, 20, 0.5) + near(88, 10, 5, 1.5) + near(0, 0, 10, 60) + [(10.0, 10.0)] * 2
    points = near(40, -5, 60, 0.2) + near(-17, 180, 40, 1) + near(88, -170, 20, 1.9) + near(0, 0, 60, 85) + [(90.0, 0.0), (-90.0, 5.0), (10.0, 10.0)]
    frame = lambda at: spark.createDataFrame([(i, *x) for i, x in enumerate(at)] + [(999, None, 1.0)], "id long, lat double, lon double")
    got = {r["p_id"]: (r["o_id"], r["m"]) for r in places.nearest_object(frame(points), frame(objects)).collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        m, o = min((metres(p, q), j) for j, q in enumerate(objects))
        assert abs(got[i][1] - m) < 1e-3
        assert got[i][0] == o or abs(metres(p, objects[got[i][0]]) - m) < 1e-3
    assert got[len(points) - 1][0] == len(objects) - 2
    assert places.nearest_object(frame(points), frame([])).count() == 0


def test_candidates_are_dealt_and_not_shuffled_again(spark):
    """One file's points among many objects: the candidates come from several tasks, and ranks need no other shuffle."""
    rnd = random.Random(8)
    spots = lambda n: [(i, 40 + rnd.random() / 5, -5 + rnd.random() / 5) for i in range(n)]
    at, of = spots(3000), [(*o, "CITY") for o in spots(40)]
    points, objects = spark.createDataFrame(at, "id long, lat double, lon double").coalesce(1), spark.createDataFrame(of, "id long, lat double, lon double, kind string")
    made = places.closest_candidates(points, objects, 13, of_objects=("kind",))
    plan = places.relative_order(made)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_id" not in plan
    got = {(r["p_id"], r["o_id"]): r["rank"] for r in places.relative_order(made).collect()}
    for i, lat, lon in at[:50]:
        own = sorted((metres((lat, lon), o[1:3]), o[0]) for o in of if (i, o[0]) in got)
        assert [got[i, o] for _, o in own] == list(range(1, len(own) + 1))
    sizes = [n for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 3 and sum(sizes) == len(got)


def test_repeated_ids_take_their_smallest_ring(spark):
    points = spark.createDataFrame([(1, 40.0, -5.0), (1, 60.0, -5.0)], "id long, lat double, lon double")
    objects = spark.createDataFrame([(7, 40.01, -5.0), (8, 75.0, -5.0)], "id long, lat double, lon double")
    assert [(r["p_id"], r["o_id"], r["ring"]) for r in places.closest_candidates(points, objects, 13).collect()] == [(1, 7, 3)]


def test_nearest_object_deals_its_points(spark, monkeypatch):
    """The points of one file go to several tasks, and a point isn't repeated for the tiles around it."""
    seen = []
    cut = places.cut_lineage
    monkeypatch.setattr(places, "cut_lineage", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    points = spark.range(5000).selectExpr("id", "40 + id / 25000.0D AS lat", "-5 + (id * 37 % 5000) / 25000.0D AS lon").coalesce(1)
    assert places.nearest_object(points, points.where("id % 50 = 0")).count() == 5000
    assert any("RepartitionByExpression [p_id" in plan for plan in seen) or any("array_min" in plan for plan in seen)


def test_city_parts_look_among_few_places(spark, monkeypatch):
    """Points and places of one boundary aren't all compared; the nearest of those within reach is taken."""
    rnd = random.Random(4)
    kinds = ("CITY", "VILLAGE", "SUBURB")
    of = [(1, f"n{i}", kinds[i % 3], 40 + rnd.random() * 2, -5 + rnd.random() * 2) for i in range(90)]
    at = [(i, 1, 39.9 + rnd.random() * 2.3, -5.1 + rnd.random() * 2.3) for i in range(400)] + [(900, 2, 40.0, -5.0), (901, 1, None, None)]
    points, own = spark.createDataFrame(at, "p_id long, b_id long, lat double, lon double"), spark.createDataFrame(of, "b_id long, name string, kind string, lat double, lon double")
    asked = []
    search = places.nearest_object
    monkeypatch.setattr(places, "nearest_object", lambda *a, **k: (asked.append(k), search(*a, **k))[1])
    none = spark.createDataFrame([], "p_id long, name string, level int")
    got = {r["p_id"]: r["part"] for r in places.city_parts(points, none, own, spark.createDataFrame([(1, "b")], "b_id long, b_name string")).collect()}
    reach = {"CITY": 15000, "VILLAGE": 1950, "SUBURB": 600}
    for i, b, lat, lon in at:
        near = [(metres((lat, lon), o[3:]), o[1]) for o in of if lat is not None and o[0] == b and metres((lat, lon), o[3:]) <= reach[o[2]]]
        assert got[i] == (min(near)[1] if near else {1: "b"}.get(b))
    assert asked == [{"by": ("b_id", "kind")}]


def nested_and_flat(spark, points, objects, step=3):
    """Candidates of both forms; points in two tiles of several, some ids twice, far apart as well, and null."""
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    o = spark.createDataFrame(objects, "id long, lat double, lon double, kind string")
    return [places.closest_candidates(p, o, 13, step, of_objects=("kind",), nested=n) for n in (True, False)]


def scattered(rnd, n, m, odd):
    spot = lambda: (40 + rnd.randrange(40) / 200, -5 + rnd.randrange(40) / 200)
    points = [(i, *spot()) for i in range(n)]
    if odd:
        points += [(i % 7, *spot()) for i in range(20)] + [(3, 60.0, 20.0), (None, 40.1, -4.9), (None, 40.1, -4.9), points[9], (11, None, 1.0)]
    objects = [(i, *spot(), rnd.choice(["CITY", "TOWN", "VILLAGE", None])) for i in range(m)]
    return points, objects + [objects[3], (4, 40.0, -5.0, "HAMLET")] * odd


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("few", [0, 10**6])
def test_nested_candidates_are_the_same_pairs(spark, monkeypatch, odd, few):
    monkeypatch.setattr(places, "AROUND_ROWS", few)
    nested, flat = nested_and_flat(spark, *scattered(random.Random(3), 700, 40, odd))
    got = Counter(map(tuple, places.candidate_pairs(nested).collect()))
    assert got == Counter(map(tuple, flat.select("p_id", "o_id", "ring").collect())) and len(got) > 5000


def test_pairs_are_not_sorted_and_stand_object_by_object(spark):
    nested, _ = nested_and_flat(spark, [(i, 40.0, -5.0) for i in range(600)], [(i, 40.0, -5.0, "CITY") for i in range(50)])
    pairs = places.candidate_pairs(nested)
    assert not re.search(r"Sort \[p_id|Window", pairs._jdf.queryExecution().executedPlan().toString())
    rows = pairs.collect()
    assert len(rows) == 600 * 50
    assert sum(a["o_id"] != b["o_id"] for a, b in zip(rows, rows[1:], strict=False)) < 1000  # not one run a pair


@pytest.mark.parametrize("odd", [False, True])
def test_nested_candidates_are_ranked_without_a_sort(spark, odd):
    nested, flat = nested_and_flat(spark, *scattered(random.Random(6), 500, 60, odd))
    ranked = places.relative_order(nested)
    assert "row_number" not in ranked._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((str(r["p_id"]), r["rank"], r["o_id"], round(r["rel"], 6)) for r in df.collect())
    assert rows(ranked) == rows(places.relative_order(flat))


def test_rounded_is_round(spark):
    rnd = random.Random(2)
    values = [rnd.uniform(-3, 3) for _ in range(3000)] + [round(rnd.uniform(0, 9), 6) + 5e-7 for _ in range(3000)] + [1e300, -1e18, 0.0, 2.5, 1e9 + 0.1234565, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 6).alias("a"), F.round("v", 6).alias("b")).collect()
    assert all(repr(r["a"]) == repr(r["b"]) or r["a"] == r["b"] for r in rows)


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("every", [1, 13, 10**6])
def test_streets_of_nested_candidates(spark, odd, every):
    """As from candidates one by one: what contains or names, what is near, else the nearest; without a sort."""
    points, objects = scattered(random.Random(every), 300, 60, odd)
    nested, flat = nested_and_flat(spark, [p for p in points if p[0] is not None], objects)

    def flags(objects):
        o = objects.field("o_id").to_numpy(zero_copy_only=False)
        total = lambda points: points.field("p_id").to_numpy(zero_copy_only=False)[:, None] + o
        return lambda points: (total(points) % every == 5, total(points) % every == 7, o % 3 > 0)

    k = F.col("p_id") + F.col("o_id")
    made = places.streets_to_cities(nested, flags=flags)
    assert "row_number" not in made._jdf.queryExecution().executedPlan().toString()
    want = places.streets_to_cities(flat.withColumns({"contains": k % every == 5, "named": k % every == 7, "has_boundary": F.col("o_id") % 3 > 0}))
    got = Counter(map(tuple, made.collect()))
    assert got == Counter(map(tuple, want.collect())) and len(got) >= 300


def test_lists_and_texts_meet_many_objects():
    ids, names = pa.array([5, None, 7, 5, 9]), pa.array(["ab", "", None, "b c", "ab"])
    assert nearby.listed(ids)(pa.array([[5, 8], None, [], [9, 7]])).astype(int).tolist() == [[1, 0, 0, 1, 0], [0] * 5, [0] * 5, [0, 0, 1, 0, 1]]
    assert nearby.contained(names)(pa.array(["xab c", None, "", "b"])).astype(int).tolist() == [[1, 1, 0, 1, 1], [0] * 5, [0, 1, 0, 0, 0], [0, 1, 0, 0, 0]]
