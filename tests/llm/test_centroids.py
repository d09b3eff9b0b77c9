"""Centroid clustering against a plain version with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from geoloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, id string, ints int"


def plain(rows, k, rounds, size, seed="2"):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, m), c) for c, m in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, vs in groups.items():
            middle[c] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = {}
    for _, c, d in out:
        total[c] = total.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for i, c, d in out), key=str)


def clustered(spark, rows, **how):
    made = centroids.cluster_vectors(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA), **how)
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=str)


def made_vectors(kind):
    rnd = random.Random(7)
    if kind == "ties":  # a coarse grid: many equal distances, repeated vectors and ids
        rows = [(i % 60, [rnd.choice([-0.5, 0.0, 0.5]) for _ in range(3)]) for i in range(150)]
    elif kind == "large":  # beyond 64 bits and beyond exact floating point
        rows = [(i, [rnd.choice([1e5, -7e5, 1e6, 0.1]) * rnd.random() for _ in range(3)]) for i in range(80)]
    else:
        rows = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    odd = [None, [], [1.0], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0, 3.0, 4.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, [0.0, 0.25, -0.25]), (None, [0.0, 0.25, -0.25])]


@pytest.mark.parametrize("kind", ["ties", "large", "plain"])
def test_equals_plain_version(spark, kind):
    rows = made_vectors(kind)
    assert clustered(spark, rows, k=9, rounds=4, size=3) == plain(rows, 9, 4, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.0])]
    assert clustered(spark, rows, k=9, rounds=2, size=2) == plain(rows, 9, 2, 2)
    assert clustered(spark, [(1, None)], size=2) == []
    assert clustered(spark, [(1, [0.0])] * 2, size=1, k=3, rounds=0) == plain([(1, [0.0])] * 2, 3, 0, 1)


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 40])
def test_tournament_finds_the_nearest(top):
    rnd = np.random.default_rng(3)
    middle = rnd.integers(-top, top, (12, 5)).tolist() + [[0] * 5] * 2
    x = np.concatenate([rnd.integers(-top, top, (300, 5)), np.zeros((1, 5), np.int64)])
    won, distance = centroids.Bisectors(middle).nearest(x)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middle)) for v in x.tolist()]
    assert [(int(d), int(c)) for d, c in zip(distance, won, strict=True)] == want
