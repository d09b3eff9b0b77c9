"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for one machine, as tests and the benchmark use it. On a cluster, submit with the
    cluster's own settings; nothing in the package sets any."""
    base = {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")),
    }
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=base | conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; only where the session names none and
    everything runs on one machine (tests), a temporary one. On a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet files in the shared folder, read again: for wide rows, which a checkpoint writes whole and
    uncompressed. Spark's cleaner is told that the shuffles that made them can go."""
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(folder)
    df.sparkSession._jvm.System.gc()  # shuffle files go with the driver's objects for them
    return df.sparkSession.read.schema(schema).parquet(folder)


def ranked(df: DataFrame, *columns: str) -> DataFrame:
    """Adds n, each row's place from 1 in the order of `columns`. The rows are sorted by range; a row's
    place is its number inside its range after the sizes of the ranges before, so no task sees them all."""
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = placed.withColumn("__at", F.monotonically_increasing_id())  # the range, then the row inside it
    placed = cut_lineage(placed.select("*", F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND(2**33 - 1).alias("__row")))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = placed.groupBy("__range").agg(F.count("*").alias("size"))
    sizes = sizes.select("__range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__ahead"))
    numbered = placed.join(sizes, "__range").withColumn("n", F.col("__ahead") + F.col("__row") + 1)
    return numbered.drop("__at", "__range", "__row", "__ahead")


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A dimension table (rules, layers) with a broadcast hint if it has at most `rows` rows; a larger
    one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts_of(df: DataFrame, rows: int) -> int:
    """Into how many partitions `df` goes for about `rows` rows each: one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def in_parts(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """`df` dealt by `columns` into a fixed number of partitions of about `rows` rows, where the work on a
    row is far more than its bytes tell: small files would be read, and small shuffles joined, in one task."""
    return df.repartition(parts_of(df, rows), *columns)
