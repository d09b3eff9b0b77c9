"""Streams of changed points of interest kept as tile counts.

The batch operators read finite extracts; these keep their products up to date from a stream of
changes (id, category, subtype, lat, lon, at timestamp).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.poi import with_tile


def tile_activity(changes: DataFrame, zoom: int = 12, window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """(start, tx, ty, category, n): changes by tile, category and time window. Changes later than
    `lateness` behind the latest are dropped, so the state stays bounded."""
    tiled = with_tile(changes.withWatermark("at", lateness), zoom)
    counts = tiled.groupBy(F.window("at", window), "tx", "ty", "category").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "tx", "ty", "category", "n")


def first_sightings(changes: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """Each (id, category, subtype) once within the lateness: the key that the POI table is unique by."""
    return changes.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id", "category", "subtype"])
