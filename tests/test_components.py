"""Connected components against a plain union of sets."""

import random

import pytest

from geoloom.operators import components


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


@pytest.mark.parametrize("small", [300_000, 0])
def test_components(monkeypatch, spark, small):
    monkeypatch.setattr(components, "SMALL_ROWS", small)
    dice = random.Random(5)
    chain = [(10_000 + i, 10_001 + i) for i in range(150)]
    star = [(20_000, 20_001 + i) for i in range(150)]
    loose = [(dice.randrange(400), dice.randrange(400)) for _ in range(170)]
    links = chain + star + loose + loose[:5] + [(7, 7), (30_000, 30_000), (None, 3), (4, None)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    rows = [(r["node"], r["root"]) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == plain(links)


def test_no_links_and_text_nodes(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    got = components.components(spark.createDataFrame([("x", "b"), ("b", "q"), ("u", "v")], "a string, b string"))
    assert {(r["node"], r["root"]) for r in got.collect()} == {("x", "b"), ("b", "b"), ("q", "b"), ("u", "u"), ("v", "u")}
