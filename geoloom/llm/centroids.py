"""Centroid clustering of integer vectors by a bisector tournament.

For every pair of centroids a < b the integer normal 2 * (b - a) and the threshold |b|^2 - |a|^2 of
their bisecting plane are worked out beforehand: normal . x - threshold is |x - a|^2 - |x - b|^2.
A vector starts with centroid 0 and meets the others in turn; the sign of one linear test decides
which of the two stays, zero favours the smaller number. After k - 1 tests one centroid is left,
and only its distance is computed. A task adds up its vectors by centroid before the shuffle, so a
round moves k rows of sums a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

SMALL = 1 << 24  # components up to this size are tested in 64-bit integers, larger ones in Python's
BLOCK = 1 << 13  # vectors tested at once


def grid(vectors: pa.Array | pa.ChunkedArray, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have `size` finite components, and floor(scale * x) of these."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    fits = (np.diff(vectors.offsets.to_numpy()) == size) & vectors.is_valid().to_numpy(zero_copy_only=False)
    values = vectors.filter(pa.array(fits)).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # null components become NaN
    ok = np.isfinite(x).all(axis=1)
    fits[np.flatnonzero(fits)[~ok]] = False
    x = x[ok]
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    if not len(scaled) or np.abs(scaled).max() <= SMALL:
        return fits, scaled.astype(np.int64)
    exact = [[int(v * scale // 1) if np.isfinite(v * scale) else int(v) * scale for v in row] for row in x.tolist()]
    return fits, np.array(exact, dtype=object)


class Bisectors:
    """The planes between all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.k = len(centroids)
        small = all(abs(v) <= SMALL for c in centroids for v in c)
        self.centroids = np.array(centroids, dtype=np.int64 if small else object)
        size = self.centroids.shape[1] if self.k else 0
        self._normal = np.zeros((self.k, self.k, size), self.centroids.dtype)
        self._threshold = np.zeros((self.k, self.k), self.centroids.dtype)
        square = (self.centroids * self.centroids).sum(axis=1) if self.k else self.centroids
        for b in range(self.k):
            for a in range(b):
                self._normal[b, a] = 2 * (self.centroids[b] - self.centroids[a])
                self._threshold[b, a] = square[b] - square[a]
        # beyond 2**53 floating-point products of matrices aren't exact
        top = int(abs(self.centroids).max()) if self.k and size else 0
        most = (1 << 53) // max(1, 8 * top * max(size, 1))
        self._exact_below = most if small and top <= most else -1
        self._float = self._normal.astype(np.float64) if small else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of every row, and the squared distance."""
        if x.dtype == object or self.centroids.dtype == object:
            x = x.astype(object)
        left = np.zeros(len(x), np.int64)
        fast = x.dtype != object and len(x) > 0 and np.abs(x).max() <= self._exact_below
        for lo in range(0, len(x), BLOCK):
            part, won = x[lo : lo + BLOCK], left[lo : lo + BLOCK]
            real = part.astype(np.float64) if fast else None
            for b in range(1, self.k):
                # one linear test a vector, by those that share their plane
                for a in np.unique(won).tolist():
                    rows = np.flatnonzero(won == a)
                    if fast:
                        gain = real[rows] @ self._float[b, a] - float(self._threshold[b, a])
                    else:
                        gain = part[rows] @ self._normal[b, a] - self._threshold[b, a]
                    won[rows[np.asarray(gain > 0, bool)]] = b
        off = x - self.centroids[left] if len(x) else x
        return left, (off * off).sum(axis=1)


def _read(batch: pa.RecordBatch) -> np.ndarray:
    """The integer vectors of a batch of kept rows."""
    column = batch.column("ints")
    if not batch.num_rows:
        return np.zeros((0, 0), np.int64)
    flat = column.flatten()
    if pa.types.is_string(flat.type):
        made = np.array([int(v) for v in flat.to_pylist()], dtype=object).reshape(batch.num_rows, -1)
        return made.astype(np.int64) if max(map(abs, made.flat), default=0) <= SMALL else made
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(<id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector.

    Kept are vectors of exactly `size` components, none null or not finite; each component becomes
    the integer floor(scale * x). Centroids start as the `k` kept vectors of the smallest hexadecimal
    sha256 of "<seed>:<id>", in that order (equal ids: by their components). Each of `rounds` rounds
    assigns all vectors and replaces every non-empty centroid by the exact floor of its vectors'
    componentwise means; empty ones stay. Then all are assigned once more. Of equally near centroids
    the smaller number wins. distance is squared; cluster_inertia its sum over the cluster, inertia
    over all; centroid_sha256 is of the final centroid's components as decimals joined by commas.

    Null, short, long and unfinished vectors have no row; a null id counts as empty in the hash.
    Repeated rows stay. Fewer than `k` kept vectors give as many centroids; an empty table gives no
    rows. Other columns are not read. Components of any size are exact; a distance, or a sum of them,
    that doesn't fit a long is an error.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = grid(batch.column("vector"), size, scale)
            ids = batch.column("id").filter(pa.array(fits))
            offsets = pa.array(np.arange(len(ids) + 1) * size, pa.int32())
            wide = x.dtype == object
            texts = pa.array([str(v) for v in x.flat], pa.string()) if wide else pa.nulls(0, pa.string())
            ints = pa.array([], pa.int32()) if wide else pa.array(x.ravel(), pa.int32())
            none = pa.array(np.zeros(len(ids) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(none if wide else offsets, ints), pa.ListArray.from_arrays(offsets if wide else none, texts)], ["id", "ints", "wide"]
            )

    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = materialize(kept.mapInArrow(lean(integers), f"id {id_type}, ints array<int>, wide array<string>"))
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(start.alias("h"), "ints", "wide").orderBy("h", "ints", "wide").limit(k).collect()  # k rows
    centroids = [[int(v) for v in (r["wide"] or r["ints"])] for r in first]
    small, wide = kept.where(F.size("wide") == 0).select("id", "ints"), kept.where(F.size("wide") > 0).select("id", F.col("wide").alias("ints"))
    tables = [small] if wide.isEmpty() else [small, wide]

    def assigned(schema: str, result) -> DataFrame:
        """`result` of every task's batches, for the vectors of both kinds."""
        made = [t.mapInArrow(lean(result), schema) for t in tables]
        return made[0] if len(made) == 1 else made[0].unionByName(made[1])

    for _ in range(rounds if centroids else 0):
        planes = Bisectors(centroids)

        def totals(batches: Iterator[pa.RecordBatch], planes: Bisectors = planes) -> Iterator[pa.RecordBatch]:
            count = [0] * planes.k
            total = [np.zeros(size, object) for _ in range(planes.k)]
            for batch in batches:
                x = _read(batch)
                if len(x):
                    won, _ = planes.nearest(x)
                    for c in np.unique(won).tolist():
                        total[c] = total[c] + x[won == c].sum(axis=0).astype(object)
                        count[c] += int((won == c).sum())
            rows = [(c, i, count[c], str(v)) for c in range(planes.k) if count[c] for i, v in enumerate(total[c])]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["cluster", "i", "n", "total"])

        sums = assigned("cluster int, i int, n long, total string", totals)
        sums = sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for r in sums.collect():  # k * size rows
            centroids[r["cluster"]][r["i"]] = int(r["total"]) // r["n"]

    planes = Bisectors(centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _read(batch)
            if len(x):
                won, distance = planes.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(won, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["id", "cluster", "distance"]
                )

    out = materialize(assigned(f"id {id_type}, cluster int, distance long", last))
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = pd.DataFrame(
        [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], columns=["cluster", "cluster_inertia", "inertia", "centroid_sha256"]
    )
    per_cluster = out.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = out.join(F.broadcast(per_cluster), "cluster")  # k rows at most
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
