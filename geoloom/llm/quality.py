"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is reduced to a few numbers that don't depend on its language. Each feature is cut into bins;
boosting goes round the features and fits a shallow tree to the residuals of one feature's bins
at a time, adding its leaves to the feature's lookup table. The pairs of features with the
strongest residual interaction then get tables of their own in the same way. A score is a sum of
table entries, looked up for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import lean, materialize

#: Labelled rows to learn from, those of the smallest hash: the default of `sample_rows`, a bound on what is
#: learned, not on what is scored.
SAMPLE_ROWS = 20_000
BINS = 24
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 150
RATE = 0.1

FEATURES = (
    "words", "bytes_per_word", "upper", "digits", "stops", "symbols", "spaces", "lines_per_word", "wide",
    "distinct", "most_frequent", "repeated_pairs", "repeated_shingles", "marked_words", "brackets",
)


def _byte_classes() -> np.ndarray:
    """Rows of indicators by byte: letter, upper, digit, stop, symbol, space, newline, wide, bracket."""
    out = np.zeros((9, 256), np.int64)
    letters = [*range(65, 91), *range(97, 123)]
    for row, chosen in enumerate(
        (letters, range(65, 91), range(48, 58), b".,!?;:", b"#$%&*|~^+=@_\\/", b" \t\n\r\x0b\x0c", b"\n", range(192, 256), b"<>{}[]()")
    ):
        out[row, list(chosen)] = 1
    return out


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; zeros for empty and null texts."""
    data, offsets = texthash.buffers(column)
    words, counts = texthash.word_hashes(column)
    n = len(counts)
    classes = _byte_classes()
    sums = np.zeros((9, n), np.float64)
    marked = np.zeros(n)
    symbol_at_end = classes[4].astype(bool) | np.isin(np.arange(256), list(b"!"))
    for i in range(n):
        part = data[offsets[i] : offsets[i + 1]]
        if len(part):
            histogram = np.bincount(part, minlength=256)
            sums[:, i] = classes @ histogram
            space = classes[5][part].astype(bool)
            ends = np.flatnonzero(space[1:] & ~space[:-1])
            marked[i] = symbol_at_end[part[ends]].sum()
    length = np.diff(offsets).astype(np.float64)
    size = np.maximum(length, 1)
    w = np.maximum(counts, 1).astype(np.float64)
    distinct, most, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    stop = np.cumsum(counts)
    for i in range(n):
        own = words[stop[i] - counts[i] : stop[i]]
        if len(own):
            _, each = np.unique(own, return_counts=True)
            distinct[i], most[i] = len(each) / len(own), each.max() / len(own)
            if len(own) > 1:
                pairs[i] = 1 - len(np.unique(texthash.mix(own[:-1]) + own[1:])) / (len(own) - 1)
    _, shingles = texthash.shingle_sets(column, 4)
    possible = np.maximum(counts - 3, np.minimum(counts, 1))
    repeated = np.where(possible > 0, 1 - np.diff(shingles) / np.maximum(possible, 1), 0.0)
    letters = np.maximum(sums[0], 1)
    return np.column_stack(
        (
            np.log1p(counts), length / w, sums[1] / letters, sums[2] / size, sums[3] / w, sums[4] / size, sums[5] / size,
            sums[6] / w, sums[7] / size, distinct, most, pairs, repeated, marked / w, sums[8] / size,
        )
    )


@dataclass
class Gam:
    """Lookup tables by feature and by pair of features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], "right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a row of bins, and where it is."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((hl > 1e-3) & (h.sum() - hl > 1e-3), gain, -1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of so many levels over ordered bins: its leaf value for each bin."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.r_[_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut along an axis, then one along the other on each side: gain and leaf values."""
    best, out = 0.0, np.full(g.shape, -g.sum() / (h.sum() + 1))
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, gg.shape[0]):
            total, sides = 0.0, []
            for part in (slice(None, cut), slice(cut, None)):
                p, q = gg[part].sum(axis=0), hh[part].sum(axis=0)
                gain, at = _best_cut(p, q)
                total += max(gain, 0) + p.sum() ** 2 / (q.sum() + 1)
                row = np.empty(len(p))
                for piece in (slice(None, at), slice(at, None)) if gain > 0 else (slice(None),):
                    row[piece] = -p[piece].sum() / (q[piece].sum() + 1)
                sides.append(np.tile(row, (cut if part.start is None else gg.shape[0] - cut, 1)))
            total -= g.sum() ** 2 / (h.sum() + 1)
            if total > best:
                made = np.vstack(sides)
                best, out = total, made if axis == 0 else made.T
    return best, out


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of single features, then of the strongest pairs."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(intercept=float(np.log(rate / (1 - rate))))
    cuts = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k)) if len(v) else np.zeros(0)
    model.edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(y) == 0 or y.min() == y.max():
        return model
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(fine[j], g, len(table)), np.bincount(fine[j], h, len(table)))
            table += step
            z += step[fine[j]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return np.bincount(wide[a] * shape[1] + wide[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(ROUNDS // 5):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            table += step
            z += step[wide[a], wide[b]]
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    label_col: str = "quality",
    training: str = "pmod(crc32(cast({id} as string)), 3) <> 1",
    threshold: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(<id_col>, held_out, score, predicted), one row per input row.

    labels: <id_col> and `label_col` (0 or 1; null rows are unlabelled; of repeated ids the
    larger label counts). training: SQL for the ids whose labels may be used, {id} stands for
    the id. Null and empty texts have features of zero and get the score of that. sample_rows: the
    bound of labelled rows that are learned from (those of the smallest hash of the id; of a repeated
    id one text); all rows are scored, whole texts. Without labels the score is 0.5. Rows with a null
    id are held out. Repeated rows are scored each. A score equal to the threshold is predicted 1.
    Only the named columns are read. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (~F.coalesce(F.expr(training.format(id=f"`{id_col}`")), F.lit(False))).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texthash.slices(batches, "text"):
            x = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["id", "held_out", *FEATURES]
            )

    schema = ", ".join(f"{f} double" for f in FEATURES)
    measured = materialize(rows.mapInArrow(lean(measure), f"id {id_type}, held_out boolean, {schema}"))
    chosen = (
        labels.where(F.expr(training.format(id=f"`{id_col}`")) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("double").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    sample = measured.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct(*FEATURES)).alias("x"))
    sample = sample.orderBy("id").select("y", "x.*").toArrow()  # a row for each of the chosen ids
    x = np.column_stack([sample.column(f).to_numpy() for f in FEATURES]).astype(np.float64)
    model = docs.sparkSession.sparkContext.broadcast(fit_gam(x, sample.column("y").to_numpy().astype(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(model.value.score(features))], ["id", "held_out", "score"]
            )

    scored = measured.mapInArrow(score, f"id {id_type}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
