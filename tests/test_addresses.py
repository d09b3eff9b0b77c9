import math
import random

from geoloom.operators import address
from geoloom.plans import QUERIES


def metres(a, b):
    (p, x), (q, y) = a, b
    h = math.sin(math.radians(q - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(q)) * math.sin(math.radians(y - x) / 2) ** 2
    return 2 * 6372.8e3 * math.asin(math.sqrt(h))


def merged(rows, max_m=900.0):
    """Brute force over all pairs of vertices."""
    parent = {r[1]: r[1] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, r in enumerate(rows):
        for s in rows[:i]:
            if r[1] != s[1] and r[2] and s[2] and (r[0], r[2].lower()) == (s[0], s[2].lower()) and metres(r[3:], s[3:]) <= max_m:
                a, b = find(r[1]), find(s[1])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_street_merge_matches_brute_force(spark):
    """A chain of 60 streets, any latitude, the antimeridian, a hot cell, two cases and no name."""
    rnd = random.Random(3)
    rows = [(1, 1000 + (7 * i) % 60, "Chain" if i % 2 else "chain", 10.0, 20.0 + i * 0.008) for i in range(60)]
    rows += [(1, 2000 + i, None, 10.0, 20.0) for i in range(2)] + [(2, 3000 + i, "hot", 50.0, 5.0 + i * 1e-5) for i in range(40)]
    for at, (lat, lon) in enumerate([(0.0, 0.0), (47.0, 8.0), (-64.0, 180.0), (70.0, -30.0)]):
        spread = 0.06
        for i in range(60):
            x = lon + rnd.uniform(-spread, spread) / math.cos(math.radians(lat))
            rows.append((3, 4000 + 100 * at + i // 2, f"s{i % 4 // 2}{at}", lat + rnd.uniform(-spread, spread), (x + 180) % 360 - 180))
    df = spark.createDataFrame(rows, "city_id int, street_id long, name string, lat double, lon double")
    got = {r["street_id"]: r["merged_id"] for r in address.merge_streets(df).collect()}
    want = merged(rows)
    assert got == want and len({want[i] for i in range(1000, 1060)}) == 1 and len(set(want.values())) > 20


def test_street_merge_query_takes_all_ways(spark, small_dir):
    ways = spark.read.parquet(f"{small_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["i12_street_merge"](spark, small_dir).count() > 0.9 * ways


def test_streets_of_a_cell_are_no_nodes_of_the_search(spark, monkeypatch):
    """Only the first streets of cells are linked, however many streets there are."""
    rows = [(1, k, "High", 48.0 + k % 2 * 0.02, 11.0) for k in range(400)] + [(1, 1000, "High", 48.0, 11.0), (1, 1000, "high", 48.01, 11.0)]
    nodes, whole = [], address.components
    monkeypatch.setattr(address, "components", lambda links: nodes.append(links.select("a").union(links.select("b")).distinct().count()) or whole(links))
    got = {r["street_id"]: r["merged_id"] for r in address.merge_streets(spark.createDataFrame(rows, "city_id long, street_id long, name string, lat double, lon double")).collect()}
    assert got == {k: k % 2 for k in range(400)} | {1000: 0} and max(nodes) <= 4
