"""Helpers shared by the corpus operators: shared-folder tables and connected components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and everything runs on one machine (tests) a temporary
    folder is set; on a cluster that is an error, since executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="geoloom-")
        atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back: cuts the lineage and
    survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete what `materialize` wrote for `table`, once the only tables made from it are written
    themselves; it can't be read afterwards."""
    jvm = table.sparkSession._jvm
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give what a Python worker has freed back to the system. Workers are kept and reused, so
    without this each would hold on to its largest batch beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that releases its memory when its task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run


def lean_group(function: Callable[[pa.Table], pa.Table]):
    """A function for applyInArrow that releases its memory after each group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            release_memory()

    return run


def free_name(df: DataFrame, stem: str) -> str:
    """`stem`, or with underscores behind it a name that no column of `df` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without_rows(docs: DataFrame, id_col: str, key: Column, drop: DataFrame, twice: DataFrame) -> DataFrame:
    """`docs` without the rows in `drop`, and with one of the rows that `twice` names.

    Both tables are (id, key); a row is told by its id, null or not, together with `key`, a digest
    of its text, so rows of one id and different texts are different rows. Rows that agree in id
    and text are interchangeable: of those in `twice` any one stays.
    """
    same = lambda t: docs[id_col].eqNullSafe(F.col(f"{t}.id")) & (key == F.col(f"{t}.key"))
    once = docs.join(drop.alias("drop"), same("drop"), "left_anti")
    if twice.isEmpty():
        return once
    own = free_name(docs, "__key")
    few = docs.join(twice.alias("few"), same("few"), "left_semi").withColumn(own, key)
    few = few.dropDuplicates([id_col, own]).drop(own)
    return once.join(twice.alias("few"), same("few"), "left_anti").unionByName(few)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few columns up to which a table is broadcast; a larger one is shuffled.
SMALL_ROWS = 300_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint if the (materialised, narrow) table has at most `rows` rows, else `df`."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (columns a, b: long).

    Returns (node, root): one row per node that has an edge; root is the same for all nodes
    of a component (it is a member, not necessarily the smallest). Each round lets every node
    point at the neighbour with the smallest hash, then contracts the graph along those
    pointers; a star or clique vanishes in one round, and any graph loses a constant share of
    its nodes, so the number of rounds is logarithmic. Work shrinks with the graph. No group is
    collected: the neighbour is a minimum, combined before the shuffle. Pointers are broadcast
    only while they are few. Empty input gives no rows; self-links and repeated links are
    harmless; null ends are dropped.
    """
    hashed = lambda c: F.xxhash64(F.col(c))
    links = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    links = links.where("a <> b")
    mapping: DataFrame | None = None
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(hashed("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(hashed("a").alias("h"), F.col("a").alias("id"))
        step = materialize(nearest.select(F.col("a").alias("node"), F.least(own, F.col("m"))["id"].alias("to")))
        # pointer jumps: the pointers form a forest, since each goes to a smaller hash
        hop = broadcast_if_small(step)
        for k in range(2):
            ahead = hop.select(F.col("node").alias("to"), F.col("to").alias(f"next{k}"))
            step = step.join(ahead, "to", "left").select("node", F.coalesce(f"next{k}", "to").alias("to"))
        step = materialize(step)
        hop = broadcast_if_small(step)
        if mapping is None:
            mapping = step.withColumnRenamed("to", "root")
        else:
            mapping = mapping.join(hop.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        ends = links
        for end in ("a", "b"):
            ends = ends.join(hop.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end, "left")
        links = materialize(
            ends.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b").distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if mapping is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(mapping, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
