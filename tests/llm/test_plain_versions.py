"""Bin additions of the quality model against a plain sum; encodings for training files."""

import bisect
import math

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from geoloom.llm import bpe, quality


def test_gam_scores_are_plain_sums_of_bins():
    rnd = np.random.default_rng(5)
    x = np.round(rnd.normal(size=(900, 4)), 1)  # many values on the edges of bins
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit_gam(x, y)
    assert model.pairs
    got = model.score(x)
    for row, score in zip(x.tolist(), got.tolist(), strict=True):
        total = model.intercept
        for j, v in enumerate(row):
            total += model.tables[j][bisect.bisect_right(model.edges[j].tolist(), v)]
        for a, b, table in model.pairs:
            total += table[bisect.bisect_right(model.coarse[a].tolist(), row[a])][bisect.bisect_right(model.coarse[b].tolist(), row[b])]
        assert math.isclose(score, 1 / (1 + math.exp(-min(max(total, -30), 30))), abs_tol=1e-12)
    assert ((got > 0.5) == (y == 1)).mean() > 0.9


def test_encodings_for_training_files(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    rows = [(1, "two words"), (1, "two words"), (None, "x"), (2, None), (3, ""), (4, "long " * 20_000 + "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in bpe.bpe_tokens(docs, path).collect()), key=str)
    assert got == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    assert bpe.bpe_tokens(docs.limit(0), path).count() == 0
