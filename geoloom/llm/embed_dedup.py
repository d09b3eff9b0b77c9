"""Near-duplicate vectors by an exact metric range join.

On unit vectors, cosine >= c is Euclidean distance <= r = sqrt(2 - 2 c). Pivots partition the
vectors: each belongs to the cell of its nearest pivot (of its own label). By the triangle
inequality a vector within r of x can be at home in the cell of pivot p only if
d(x, p) - d(x, home) <= 2 r, which sets the replication over boundaries. Each cell is then joined
by itself: its own vectors against them and the replicas, so every vector meets all its
neighbours in its home cell. Cells over a bound are dealt into a grid of blocks. A block returns
one count a vector and a spanning forest of its links, never the pairs.

Equal vectors of a label are folded into one node before the join, by their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, lean_group, materialize

PER_PIVOT = 2_000
PIVOT_BYTES = 32 << 20  # of pivots that are broadcast; beyond it cells grow, and are dealt into more blocks
BLOCK = 2_048
SLACK = 1e-7  # over the error of a distance taken from a cosine


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine_near_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    cosine: float = 0.98,
) -> DataFrame:
    """(<id_col>, n_links, component_id, kept), one row per input row.

    Rows link when their labels are equal and not null, their vectors have the same length and
    their cosine (double precision) is at least `cosine`. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without a label, link with nothing:
    n_links 0, component_id their own id. n_links counts all other rows linked directly, equal
    vectors included. component_id is the smallest id of the component; kept says that a row has
    it. Rows with a null id take part and get the component's smallest id. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine))
    v = F.col(vector_col)
    sound = (
        F.col(label_col).isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(v, lambda c: c != 0)
    )
    plain = F.transform(v.cast("array<double>"), lambda c: c + F.lit(0.0))  # one zero
    space = F.concat_ws("/", F.col(label_col).cast("string"), F.size(v))
    rows = vectors.select(
        F.col(id_col).alias("id"), F.when(sound, space).alias("space"), F.when(sound, plain).alias("vector")
    ).withColumn("print", F.when(F.col("space").isNotNull(), F.struct(F.xxhash64("space", "vector"), F.xxhash64("vector", F.lit(1)))))
    folded = (
        rows.where("space is not null")
        .groupBy("print", "space", "vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        .withColumn("key", F.monotonically_increasing_id())  # written next, so it is settled
    )
    folded = materialize(folded)
    width = F.max(F.size("vector")).alias("width")
    total, width = folded.agg(F.count("*"), width).first()
    per_pivot = max(PER_PIVOT, -(-(total or 0) * 8 * (width or 1) // PIVOT_BYTES))
    # about one vector of per_pivot, of every label: what is gathered has PIVOT_BYTES at most, give or take its spread
    drawn = folded.where(F.pmod(F.xxhash64("print", F.lit(7)), F.lit(per_pivot)) == 0).select("space", "vector").collect()
    pivots: dict[str, np.ndarray] = {}
    for space in {r["space"] for r in drawn}:
        pivots[space] = _unit([np.array(r["vector"]) for r in drawn if r["space"] == space])
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column("space").to_pylist(), dtype=object)
            held = batch.column("vector").to_pylist()
            keys, copies = batch.column("key").to_numpy(), batch.column("copies").to_numpy()
            out: list[list] = [[], [], [], [], [], []]
            for space in set(spaces.tolist()):
                at = np.flatnonzero(spaces == space)
                x = _unit([np.array(held[i], np.float64) for i in at])
                own = shared.value.get(space)
                if own is None:
                    home, row, cell = np.zeros(len(at), np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
                else:
                    home = np.zeros(len(at), np.int64)
                    row, cell = [], []
                    for i in range(0, len(at), step := max(1, (1 << 20) // len(own))):
                        d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[i : i + step] @ own.T)))
                        home[i : i + step] = d.argmin(axis=1)
                        near = np.nonzero(d - d.min(axis=1, keepdims=True) <= 2 * radius + SLACK)
                        row.append(near[0] + i)
                        cell.append(near[1])
                    row, cell = np.concatenate(row), np.concatenate(cell)
                out[0] += [space] * len(row)
                out[1] += cell.tolist()
                out[2] += keys[at[row]].tolist()
                out[3] += copies[at[row]].tolist()
                out[4] += (home[row] == cell).tolist()
                out[5] += [x[i].tobytes() for i in row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)],
                ["space", "cell", "key", "copies", "home", "x"],
            )

    schema = "space string, cell int, key long, copies long, home boolean, x binary"
    placed = materialize(folded.select("space", "vector", "key", "copies").mapInArrow(lean(assign), schema))
    sizes = placed.groupBy("space", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("h_blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("m_blocks")
    )
    # a vector goes to one row of the grid as a home vector, to one column as a member
    grid = placed.join(sizes.where("h_blocks > 0"), ["space", "cell"])
    h = F.pmod(F.col("key"), F.col("h_blocks")).cast("int")
    m = F.pmod(F.shiftright("key", 17), F.col("m_blocks")).cast("int")
    as_home = grid.where("home").select(
        "space", "cell", h.alias("hb"), F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"), "key", "copies", "home", "x"
    )
    as_member = grid.select(
        "space", "cell", F.explode(F.sequence(F.lit(0), F.col("h_blocks") - 1)).alias("hb"), m.alias("mb"), "key", "copies", F.lit(False).alias("home"), "x"
    )

    def join(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy(zero_copy_only=False)
        keys, copies = table.column("key").to_numpy(), table.column("copies").to_numpy()
        x = np.stack([np.frombuffer(b, np.float64) for b in table.column("x").to_pylist()])
        a, b = keys[home], keys[~home]
        near = x[home] @ x[~home].T >= cosine
        near &= a[:, None] != b[None, :]
        links = near @ copies[~home] if len(b) else np.zeros(len(a), np.int64)
        # spanning forest: the smallest key reachable inside the block
        label_a, label_b = a.copy(), b.copy()
        linked_a, linked_b = near.any(axis=1), near.any(axis=0)
        sub = near[np.ix_(linked_a, linked_b)]
        la, lb = label_a[linked_a], label_b[linked_b]
        top = np.iinfo(np.int64).max
        while sub.size:
            na = np.minimum(la, np.where(sub, lb[None, :], top).min(axis=1))
            nb = np.minimum(lb, np.where(sub, na[:, None], top).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        node = np.r_[a, b[linked_b]]
        to = np.r_[a, lb]
        to[: len(a)][linked_a] = la
        return pa.table(
            {"key": node, "to": to, "links": np.r_[links, np.zeros(int(linked_b.sum()), np.int64)].astype(np.int64)}
        )

    met = as_home.unionByName(as_member).groupBy("space", "cell", "hb", "mb").applyInArrow(lean_group(join), "key long, to long, links long")
    met = materialize(met)
    roots = connected_components(met.where("key <> to").select(F.col("key").alias("a"), F.col("to").alias("b")))
    counts = met.groupBy("key").agg(F.sum("links").alias("links"))
    groups = folded.select("key", "print", "copies", "first").join(counts, "key", "left")
    groups = groups.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "print", "first", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    smallest = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = groups.join(smallest, "root").select("print", "n_links", "component_id")
    # a row finds its node by 128 bits of its label and vector
    done = rows.select("id", "print").join(groups, "print", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return done.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
