"""Streams of changes, from files."""

from pyspark.sql import functions as F

from geoloom.streaming import changes


def test_tile_activity_and_first_sightings(spark, tmp_path):
    rows = [(i % 3, "c", "s", 40.0 + i / 100, -5.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, category string, subtype string, lat double, lon double")
    df = df.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.monotonically_increasing_id() % 60))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made in (("tiles", changes.tile_activity(stream)), ("seen", changes.first_sightings(stream))):
        mode = "complete" if name == "tiles" else "append"
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("tiles").agg(F.sum("n")).first()[0] == 6
    assert spark.table("seen").count() == 3
