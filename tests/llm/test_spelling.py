"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from test_llm_operators import FOLD, docs_frame

from geoloom.llm import spelling
from geoloom.llm.queries import QUERIES


def plain_words(rows, least, least_count, every):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= least_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))


def plain_groups(rows, least=7, least_count=2, every=31, times=10):
    n = plain_words(rows, least, least_count, every)
    around = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        around[w] = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    want = plain_groups(docs)
    assert sum(v[3] > 0 for v in want.values()) > 10
    assert as_dict(QUERIES["op12_spelling_groups"](spark, small_dir)) == want


@pytest.fixture(scope="module")
def dense():
    """Short alphabets, so that most words have many near ones; chains of forms; letters of two bytes."""
    rnd = random.Random(5)
    texts = []
    for alphabet in ("ab", "aé", "abcdÀÿ×÷Z"):
        base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 9))) for _ in range(40)]
        for _ in range(60):
            texts.append("|".join(base[min(39, int(rnd.expovariate(0.2)))] for _ in range(30)))
    chain = ["variants", "variant", "varient", "varrient"]
    texts += [" ".join([w] * 12**k) for k, w in zip((3, 2, 1, 0), chain, strict=True) for _ in range(2)]
    texts += ["", None, " 123 ", "\u4e2d" * 50 + "abcdefg", "Ā" + "Straßenbahn" * 2, "abcdefg", "x" * 300 + "y", "x" * 300 + "y", "x" * 301 + "y", "x" * 301 + "y", "É" * 40, "É" * 40]
    return texts


@pytest.mark.parametrize("window", [1 << 20, 64])
def test_dense_words(spark, dense, window, monkeypatch):
    monkeypatch.setattr(spelling, "WINDOW", window)
    got = as_dict(spelling.spelling_groups(docs_frame(spark, dense), least=5, delete_every=5))
    assert got == plain_groups(list(enumerate(dense)), least=5, every=5)


def test_forms_are_followed_to_the_last(spark):
    texts = [" ".join([w] * n) for w, n in (("variants", 2000), ("variant", 200), ("varient", 20), ("varrient", 2))]
    got = as_dict(spelling.spelling_groups(docs_frame(spark, texts), delete_every=10**9))
    assert {w: v[:2] for w, v in got.items()} == {
        "variants": (None, "variants"), "variant": ("variants", "variants"), "varient": ("variant", "variants"), "varrient": ("varient", "variants")
    }


def test_ids_repeats_and_empty_tables(spark):
    rows = [(None, "harbour harbour"), (None, "harbour harbour"), ("x", "harbor harbor " * 30), ("x", None)]
    docs = spark.createDataFrame(rows, "word string, text string")
    assert as_dict(spelling.spelling_groups(docs, least=6, id_col="word")) == plain_groups(rows, least=6)
    assert spelling.spelling_groups(docs.limit(0), id_col="word").count() == 0


def test_every_near_pair_shares_a_signature():
    rnd = random.Random(9)
    for _ in range(300):
        w = "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 12)))
        k, c = rnd.randrange(len(w) + 1), rnd.choice("abcdé")
        v = rnd.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]])
        if v and near(w, v):
            number, sig, role = spelling.signatures(pa.array([w, v]), {97: 0, 98: 1})
            keys = [{(s, r) for m, s, r in zip(number, sig, role, strict=True) if m == i} for i in (0, 1)]
            assert any((s, {0: 0, 1: 2, 2: 1}[r]) in keys[1] for s, r in keys[0])
