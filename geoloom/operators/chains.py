"""Chains: list ranking by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import cut_lineage


def chain_positions(links: DataFrame) -> DataFrame:
    """(node, head, pos) of every node of the links (node, prev), in which a node has at most one
    predecessor and is one at most once: pos 0 is the first node of a chain, the head; a circle begins
    at its smallest node.

    Each round doubles the way that nodes look back, so a chain takes as many rounds as its length has
    binary digits, and no task ever holds one. Once a round reaches no further head and finds no
    smaller node, what hasn't reached a head is circles; they are cut before their smallest node.
    """
    links = cut_lineage(links.select("node", "prev"))
    ranked, circles = _look_back(links)
    if circles is None:
        return ranked
    first = circles.where("node = least").select("node")
    cut = links.join(circles.select("node"), "node", "left_semi").join(first, "node", "left_anti")
    again, _ = _look_back(cut_lineage(cut))
    return ranked.unionByName(again)


def _look_back(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Positions in the chains that have a head; and (node, least) of those in circles, if any."""
    heads = links.select(F.col("prev").alias("node")).distinct().join(links.select("node"), "node", "left_anti")
    ways = links.select("node", F.col("prev").alias("to"), F.lit(1).cast("long").alias("d"), F.least("node", "prev").alias("least"), F.lit(False).alias("done"))
    state = ways.unionByName(heads.select("node", F.col("node").alias("to"), F.lit(0).cast("long").alias("d"), F.col("node").alias("least"), F.lit(True).alias("done")))
    state = cut_lineage(state)
    while True:
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        moved = F.col("done2") & ~F.col("done") | ~F.col("done2") & (F.col("least2") < F.col("least"))
        state = state.join(ahead, "to").select(
            "node", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"), moved.alias("moved")
        )
        state = cut_lineage(state)
        seen = state.agg(F.bool_or("moved").alias("moved"), F.bool_and("done").alias("done")).first()
        state = state.drop("moved")
        if seen["done"] or not seen["moved"]:
            break
    ranked = state.where("done").select("node", F.col("to").alias("head"), F.col("d").alias("pos"))
    return ranked, None if seen["done"] or seen["done"] is None else state.where("NOT done").select("node", "least")
