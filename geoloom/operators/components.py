"""Connected components, and groups of them for work that stays inside a component."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import bounded, cut_lineage

SMALL_ROWS = 300_000  # pointers (two columns) up to which a round broadcasts them
GROUP_ROWS = 5_000  # rows of a group of components, on average


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected links a, b; root is the component's smallest node.

    Each round nodes point at the neighbour of the smallest hash, pointers are followed twice more, and
    the graph is contracted along them. It loses a constant share of its nodes each time, so rounds
    are logarithmic; if it doesn't settle this raises. A round writes its pointers and what is left of
    the links; pointers are broadcast only while they are few. Links to itself and repeated ones are
    harmless, those with a null end go.
    """
    links = cut_lineage(links.select("a", "b").dropna().distinct())
    mapping = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    links = links.where("a <> b")
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        to = cut_lineage(least.select("a", F.least(own, "m")["id"].alias("to")))
        hop = bounded(to, SMALL_ROWS).select(F.col("a").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            to = to.join(hop, "to").select("a", F.col("next").alias("to"))
        to = cut_lineage(to)
        hop = bounded(to, SMALL_ROWS)
        mapping = mapping.join(hop.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        ends = links.join(hop.withColumnRenamed("to", "a_to"), "a").join(hop.select(F.col("a").alias("b"), F.col("to").alias("b_to")), "b")
        links = cut_lineage(ends.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    mapping = cut_lineage(mapping)
    smallest = mapping.groupBy("root").agg(F.min("node").alias("least"))
    return mapping.join(smallest, "root").select("node", F.col("least").alias("root"))


def dealt(rows: int, *key: str) -> Column:
    """A group number for whole keys, so that a group has about GROUP_ROWS of `rows` rows."""
    return F.pmod(F.xxhash64(*key), F.lit(math.ceil(rows / GROUP_ROWS) or 1))
