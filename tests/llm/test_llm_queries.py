"""The registered queries of the corpus operators, and the pipeline, on a small folder."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from compare import assert_same, database
from test_llm_operators import FOLD, components, docs_frame, shingles

from geoloom.llm import mixing, toxicity
from geoloom.llm.queries import ORACLE_SQL, QUERIES

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, small_dir, name):
    assert_same(QUERIES[name](spark, small_dir), database(small_dir), ORACLE_SQL[name])


def last_copies(rows):
    """Of equal texts the row of the largest id; null ids come last."""
    best = {}
    for i, t, *rest in rows:
        key = (t or "").translate(FOLD)
        if key not in best or (i is not None, i or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = (i, t, *rest)
    return Counter(best.values())


def representatives(rows):
    """Of near copies the row of the smallest id, then of the smallest digest; without words all."""
    sets = [shingles(t, 5) for _, t, *_ in rows]
    groups = {}
    for n, c in enumerate(components(sets, 80)):
        groups.setdefault(c, []).append(rows[n])
    least = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    return Counter(min(g, key=least) for g in groups.values())


def ids_and_texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def roundtrips(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    out = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    return out


def test_pipeline_equals_brute_force(spark, small_dir):
    """Every stage on what its predecessor kept, and run() on the whole."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, small_dir)
        before, rows = ids_and_texts(at), after.collect()
        if name == "bpe":
            assert Counter(map(tuple, rows)) == roundtrips(before)
            break
        assert after.columns == docs.columns
        got = Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(at, labels, threshold=0.7).collect()}
            assert got == Counter(r for r in before if scores[r[0]] < 0.7) and 0 < len(got) < len(before)
        elif name == "exact_dedup":
            assert got == last_copies(before)
        elif name == "ngram_join":
            assert got == representatives(before)
        else:
            mix = {r["doc_id"]: r for r in mixing.mix_sources(at).collect()}
            part = {i: divmod(r["taken"], max(1, r["size"])) for i, r in mix.items()}
            times = {i: 1 if not r["size"] else part[i][0] + (2 * part[i][1] >= r["size"]) for i, r in mix.items()}
            assert got == Counter({r: times[r[0]] for r in before if times[r[0]]})
        at = spark.createDataFrame(rows, docs.schema)
    again = corpus_pipeline.run(spark, small_dir)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))


LONG = " ".join(f"w{i}" for i in range(60))
ODD = [
    (5, "aaa"), (5, "bbb"), (9, "bbb"), (None, "AAA"), (None, "ccc"), (None, "ccc"), (7, None), (8, ""), (8, ""), (2, "  "),
    (3, LONG), (3, LONG), (4, LONG + " end"), (3, "other words " + LONG[40:]), (4, "other words " + LONG[40:] + " z"), (None, LONG + " tail"), (1, "x" * 70_000),
]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_rows(spark, small_dir, name):
    """Repeated and null ids, null, empty and long texts, repeated rows, and an empty table."""
    docs = docs_frame(spark, [t for _, t in ODD], sources=[None if i is None else "s" for i, _ in ODD], ids=[i for i, _ in ODD])
    run = lambda df: STAGES[name](spark, df, small_dir)
    assert run(docs.where("false")).count() == 0
    if name == "bpe":
        assert Counter(map(tuple, run(docs).collect())) == roundtrips(ODD)
        return
    out = run(docs)
    assert out.columns == docs.columns
    got = Counter(ids_and_texts(out))
    if name == "toxicity":
        assert got == Counter(ODD)
    elif name == "exact_dedup":
        assert got == last_copies(ODD)
    elif name == "ngram_join":
        assert got == representatives(ODD)
    else:
        assert set(got) <= set(ODD) and all(got[r] <= 2 * ODD.count(r) for r in got)
