"""Clashing names, ids of any type, and results that don't hang on how keys are dealt."""

from collections import Counter

import numpy as np
import pytest

from geoloom.llm import bpe, exact_dedup, mixing, ngram_join, sharding, tokencount, toxicity

NEAR = [f"one two three four five six seven eight nine ten {w} twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty" for w in ("a", "b")]
ROWS = [("b", "Same text here"), ("a", "same TEXT here"), ("b", "Same text here"), (None, "same text here"), ("c", None), ("d", ""), ("e", NEAR[0]), ("f", NEAR[0] + " more")]
CLASHES = "__key string, __h int, __cell int, shard string, key int, node long, id int, digest binary, `drop` int, few int, h int, source string"


def clashing(spark, rows=ROWS):
    schema = f"doc_id {'string' if isinstance(rows[0][0], str) else 'long'}, text string, {CLASHES}"
    return spark.createDataFrame([(*r, "k", 1, 2, "s", 3, 4, 5, b"d", 6, 7, 8, "web") for r in rows], schema)


def test_exact_dedup_takes_ids_of_any_type(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(clashing(spark)).collect()}
    assert got == {
        ("b", "b", 4, True), ("a", "b", 4, False), (None, "b", 4, False), ("c", "d", 2, False), ("d", "d", 2, True), ("e", "e", 1, True), ("f", "f", 1, True)
    }


def test_exact_dedup_with_many_shards(spark, monkeypatch):
    whole = sorted(map(str, exact_dedup.exact_dedup(clashing(spark)).collect()))
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 0.05)
    assert sorted(map(str, exact_dedup.exact_dedup(clashing(spark)).collect())) == whole


def test_stages_keep_clashing_columns(spark):
    docs = clashing(spark)
    last = exact_dedup.keep_last_copies(docs)
    assert last.columns == docs.columns
    assert sorted(r["doc_id"] for r in last.collect()) == ["b", "d", "e", "f"]
    near = ngram_join.keep_representatives(last, words=5, percent=80)
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect()) == ["b", "d", "e"]
    assert Counter(r["__key"] for r in near.collect()) == {"k": 3}
    mixed = mixing.take_mix(near)
    assert mixed.columns == docs.columns and mixed.count() >= 2
    assert {r["doc_id"] for r in bpe.bpe_roundtrip(mixed, _vocabulary()).collect()} <= {"b", "d", "e"}
    assert tokencount.token_counts(docs, _vocabulary()).count() == len(ROWS)


def test_toxicity_stage_keeps_clashing_columns(spark):
    rows = [(i, "you are a nasty gronk" if i % 2 else "a quiet day by the sea") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = clashing(spark, rows)
    kept = toxicity.drop_toxic(docs, labels, threshold=0.7)
    assert kept.columns == docs.columns
    assert 0 < kept.count() <= 60


def test_shards_keep_clashing_columns(spark, tmp_path):
    docs = clashing(spark)
    sharding.write_shards(docs, f"{tmp_path}/shards", limit_bytes=40)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert set(docs.columns) <= set(back.columns)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("parts", [2, 500])
def test_near_copies_with_few_and_many_ranges(spark, parts, monkeypatch):
    rows = [(i, f"{NEAR[i % 2]} w{i % 7} " + " ".join(f"x{i}_{k}" for k in range(i % 3))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = lambda: sorted(map(tuple, ngram_join.ngram_jaccard_join(docs, words=4, percent=85, frequent=4).collect()))
    whole = join()
    assert len({r[2] for r in whole}) < 120
    monkeypatch.setattr(ngram_join, "_parts", lambda docs: parts)
    assert join() == whole


def test_ranges_of_sorted_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**48, 5000, dtype=np.uint64))
    for parts in (1, 7, 10_000):
        found = list(ngram_join._by_range(keys, parts, 48))
        assert [a for _, a, _ in found] == [0] + [b for _, _, b in found][:-1] and found[-1][2] == len(keys)
        assert [p for p, *_ in found] == sorted({p for p, *_ in found}) and found[-1][0] < parts
    assert list(ngram_join._by_range(keys[:0], 4, 48)) == []


def _vocabulary():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
