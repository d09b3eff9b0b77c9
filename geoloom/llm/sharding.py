"""Sharding by extendible hashing.

A row's place is a 60-bit hash of its id and text. The directory is indexed by the hash's
leading bits; a bucket that holds more bytes than the limit splits on one more bit, the others
stay, until every shard fits. The splits are found on a histogram of fine hash cells, all levels
at once, and repeated on deeper bits for the cells that are still too large, so documents are
never gathered and the directory is a distributed table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

BITS = 60
MARGIN = 4  # the histogram's cells are this many levels finer than an even split


def row_hash(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the MD5 of "<id>:<text>"; null counts as empty."""
    text = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _leading(h: Column, depth: Column | int) -> Column:
    """The hash's leading bits; `depth` is at most BITS."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit_bytes: int = 1 << 20
) -> DataFrame:
    """(<id_col>, n_bytes, shard, depth, shard_bytes, shard_rows), one row per input row.

    n_bytes: the text's UTF-8 bytes (null: 0). shard: the bits of the shard's hash prefix, a
    string of `depth` characters (empty when all rows fit into one). A bucket stops splitting
    when it holds at most `limit_bytes`, or when all its rows have one hash: a single text over
    the limit, or rows that agree in id and text, are then a shard of their own over the limit.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        row_hash(id_col, text_col).alias("h"),
    )
    rows = materialize(rows)
    out = None
    for fine, named in _directory(rows, limit_bytes):
        part = rows.withColumn("cell", _leading(F.col("h"), fine)).join(named, "cell")
        part = part.select(F.col("id").alias(id_col), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
        out = part if out is None else out.unionByName(part)
    return out


def _directory(rows: DataFrame, limit_bytes: int) -> list[tuple[int, DataFrame]]:
    """The directory for rows (n_bytes, h): tables (cell, shard, depth, shard_bytes, shard_rows), cell
    being so many leading bits; a row is in one cell of one of the tables."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, math.ceil(math.log2(max(1, total / limit_bytes))) + MARGIN)
    todo, base, done = rows, 0, []
    while True:
        cells = todo.groupBy(_leading(F.col("h"), depth).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        cells = materialize(cells)
        levels = cells.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(depth))))
        levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("level")))
        nodes = levels.groupBy("level", "prefix").agg(
            F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        open_ = nodes.where((F.col("bytes") > limit_bytes) & (F.col("lo") < F.col("hi"))).select("level", "prefix")
        # an open node's parents are open too, so a cell's depth is the number of its open nodes
        open_cells = levels.join(open_, ["level", "prefix"]).groupBy("cell").agg((F.count("*") + base).alias("depth"))
        placed = cells.join(open_cells, "cell", "left").select(
            "cell", "bytes", "n", F.coalesce("depth", F.lit(base)).cast("int").alias("depth"), F.lit(depth).alias("fine")
        )
        placed = materialize(placed)
        done.append((depth, placed.where(F.col("depth") <= depth)))
        deeper = placed.where(F.col("depth") > depth).select("cell")
        if depth == BITS or deeper.isEmpty():
            break
        todo = materialize(todo.withColumn("cell", _leading(F.col("h"), depth)).join(deeper, "cell", "left_semi").drop("cell"))
        base, depth = depth, min(BITS, depth + 8)
    out = []
    for fine, placed in done:
        bits = F.lpad(F.bin("cell"), fine, "0") if fine else F.lit("")
        named = placed.withColumn("shard", F.substring(bits, F.lit(1), F.col("depth")))
        sums = named.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        out.append((fine, named.join(sums, "shard").select("cell", "shard", "depth", "shard_bytes", "shard_rows")))
    return out


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit_bytes: int = 1 << 27) -> None:
    """Write `docs` as Parquet, one folder a shard, each row once: rows find their shard by hash, so
    repeated and null ids don't multiply or lose rows. Null texts count as empty. The folders are
    named by the column shard (shard_ if `docs` has one of that name). An empty table gives no file
    with rows."""
    name, h, at = (free_name(docs, stem) for stem in ("shard", "__h", "__cell"))
    keyed = docs.withColumn(h, row_hash(id_col, text_col))
    rows = materialize(keyed.select(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(h).alias("h")))
    out = None
    for fine, named in _directory(rows, limit_bytes):
        cells = named.select(F.col("cell").alias(at), F.concat(F.lit("s"), F.col("shard")).alias(name))
        part = keyed.withColumn(at, _leading(F.col(h), fine)).join(cells, at).drop(at, h)
        out = part if out is None else out.unionByName(part)
    out.repartition(name).write.partitionBy(name).parquet(path)
