"""Feature encoding: the constant in the plan against a join and against plain Python."""

import random

import pytest

from geoloom.operators import rules

PATTERN = [{"tag": "highway", "value": None}, {"tag": "foot", "value": "yes"}]
RULES = [
    {"tag": "highway", "value": "primary", "minzoom": 8},
    {"tag": "highway", "value": "path", "target_id": 1, "minzoom": 12},
    {"tag": "highway", "minzoom": 14},
    {"tag": "natural", "value": "tree", "only_point": True, "minzoom": 10},
    {"tag": "oneway", "value": "yes", "kind": "additional", "apply_to": PATTERN},
    {"tag": "oneway", "value": "yes", "minzoom": 16},
    {"tag": "lit", "kind": "additional", "apply_to": []},
    {"tag": "name", "kind": "text"},
    {"tag": "name:en", "kind": "text"},
]
VALUES = {
    "highway": ["primary", "path", "track"], "natural": ["tree", "rock"], "oneway": ["yes", "no"], "lit": ["yes"], "foot": ["yes", "no"],
    "name": ["A", "B \"quoted\"", ""], "name:en": ["A", "C"], "area": ["YES", "no"], "slash\\key": ["x"],
}


def entities(n):
    dice = random.Random(3)
    rows = [(i, {k: dice.choice(v) for k, v in VALUES.items() if dice.random() < 0.4}, dice.random() < 0.5, f"e{i}") for i in range(n)]
    return rows + [(n, None, True, "null"), (n + 1, {}, True, "empty"), (n + 2, {"highway": None, "name": None}, False, "null value")]


def plain(rows, table, zoom):
    out = {}
    for id_, tags, is_node, _ in rows:
        got = {"main": set(), "additional": set(), "text": set()}
        for k, v in (tags or {}).items():
            exact = [r for r in table if r["tag"] == k and r["value"] is not None and r["value"] == v]
            for r in exact or [r for r in table if r["tag"] == k and r["value"] is None]:
                applies = not r["apply_to"] or any(p["tag"] in tags and p["value"] in (None, tags[p["tag"]]) for p in r["apply_to"])
                if not r["minzoom"] <= zoom <= r["maxzoom"] or (r["only_point"] and not is_node) or (r["kind"] != "main" and not applies):
                    continue
                if k == "name:en" and v is not None and v == tags.get("name"):
                    continue
                number = r["target_id"] or r["rule_id"]
                got[r["kind"]].add((number, v) if r["kind"] == "text" else number)
        if got["main"]:
            area = (tags.get("area") or "").lower() in ("yes", "true")
            out[id_] = (sorted(got["main"]), sorted(got["additional"]), dict(got["text"]), area)
    return out


def collected(df):
    return {r["id"]: (r["types"], r["add_types"], r["names"], r["area"]) for r in df.collect()}


@pytest.fixture(scope="module")
def table(spark):
    return rules.rule_table(spark, RULES)


@pytest.fixture(scope="module")
def rows():
    return entities(200)


@pytest.fixture(scope="module")
def objects(spark, rows):
    return spark.createDataFrame(rows, "id long, tags map<string,string>, is_node boolean, extra string")


@pytest.mark.parametrize("zoom", [9, 14, 16])
@pytest.mark.parametrize("most", [10_000, 0])
def test_features(monkeypatch, objects, table, rows, zoom, most):
    monkeypatch.setattr(rules, "RULES_IN_PLAN", most)
    assert collected(rules.encode_features(objects, table, zoom)) == plain(rows, [r.asDict(recursive=True) for r in table.collect()], zoom)


def test_levels_keep_columns(objects, table, rows):
    got = rules.encode_levels(objects, table, {0: 16, 1: 14, 2: 9}, "extra")
    for level, zoom in ((0, 16), (1, 14), (2, 9)):
        at = got.where(f"level = {level}")
        found = collected(at)
        assert found == collected(rules.encode_features(objects, table, zoom))
        assert {r["id"]: r["extra"] for r in at.collect()} == {r[0]: r[3] for r in rows if r[0] in found}


def test_no_shuffle_and_folded(objects, table):
    plan = rules.encode_features(objects, table, 14)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "from_json" not in plan


def test_without_rules(objects, table):
    assert rules.encode_features(objects, table.limit(0), 14).count() == 0
