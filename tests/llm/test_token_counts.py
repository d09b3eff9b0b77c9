"""Token counts against the vocabulary's own library."""

import random

import pytest
from test_llm_operators import docs_frame

from geoloom.llm import tokencount
from geoloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_table(spark, small_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_token_counts"](spark, small_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    want = dict(zip(docs, library(list(docs.values())), strict=True))
    for r in rows:
        text = docs[r["doc_id"]] or ""
        n = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_odd_texts(spark, vocabulary, library):
    rnd = random.Random(3)
    odd = ["", None, " ", "\n\n  ", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "it's I'LL", "\u200b\u00a0\u3000x", "\x1c\x1f a", "漢字 ١٢ ½"]
    odd += ["a" * 70_000, "ab" * 40_000, " " * 140_000 + "x", "x" + " \n" * 70_000, "word " * 30_000 + "<|endoftext|>" + " tail " * 20_000]
    odd += ["".join(rnd.choice("ab tTh'se  \n<|endoftext|>1é漢😀\u2003!?") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    made = tokencount.token_counts(docs_frame(spark, odd), vocabulary, limit=3).collect()
    got = {r["doc_id"]: r["n_tokens"] for r in made}
    assert [got[i] for i in range(len(odd))] == library(odd)
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in made)


def test_repeated_and_null_ids_and_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([("x", "a b"), ("x", "a b"), (None, "a"), (None, None)], "n_tokens string, text string").withColumnRenamed("n_tokens", "id")
    rows = tokencount.token_counts(docs, vocabulary, id_col="id").collect()
    assert sorted((str(r["id"]), r["n_tokens"]) for r in rows) == [("None", 0), ("None", 1), ("x", 2), ("x", 2)]
    assert tokencount.token_counts(docs.limit(0), vocabulary, id_col="id").count() == 0


def test_forgetting_keeps_counts(vocabulary, library, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 3)
    monkeypatch.setattr(tokencount, "CHUNK_CHARS", 5)
    texts = ["one two three four five six seven", "seven one  two\n\n three", "aaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbb"]
    own = tokencount.MergeCounter(vocabulary)
    assert [own.count(t) for t in texts * 2] == library(texts * 2)
