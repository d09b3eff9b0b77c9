"""I18 over the whole map: labels that keep clear of those in neighbouring tiles, and the turns of the
map through which they stay clear."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import cut_lineage

FULL_TURN = 2 * math.pi
PLACED = "tx long, ty long, prio double, id long, x double, y double, w double, h double, scale double, first_turn double, last_turn double"


def free_turn(dx: np.ndarray, dy: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For upright boxes at (0, 0) and (dx, dy), with w and h their half extents together: the turn of
    the map, from 0 to a full one, at which they first touch, and the one at which they last part;
    a full turn and 0 where they never touch."""
    far, angle = np.hypot(dx, dy), np.arctan2(dy, dx)
    with np.errstate(divide="ignore", invalid="ignore"):
        across, along = np.arccos(w / far), np.arcsin(h / far)  # NaN where no turn gets them there
    at = np.stack([across, -across, np.pi - across, np.pi + across, along, -along, np.pi - along, np.pi + along])
    turns = np.sort(np.where(np.isnan(at), 0.0, np.mod(at - angle, FULL_TURN)), axis=0)
    turns = np.concatenate([np.zeros((1, len(far))), turns, np.full((1, len(far)), FULL_TURN)])
    middle = (turns[:-1] + turns[1:]) / 2 + angle
    touch = (np.abs(far * np.cos(middle)) < w) & (np.abs(far * np.sin(middle)) < h) & (turns[1:] > turns[:-1])
    first = np.where(touch, turns[:-1], FULL_TURN).min(axis=0)
    last = np.where(touch, turns[1:], 0.0).max(axis=0)
    return first, last


def _place(labels: pd.DataFrame, obstacles: pd.DataFrame, max_scale: float, padding: float, reach: float) -> pd.DataFrame:
    """The labels of one tile in order of priority, beside what is placed around it."""
    labels = labels.sort_values(["prio", "id", "x", "y"])
    columns = ("x", "y", "w", "h", "scale")
    cells: dict[tuple[int, int], list[tuple]] = {}

    def keep(x: float, y: float, *rest: float) -> None:
        cells.setdefault((math.floor(x / reach), math.floor(y / reach)), []).append((x, y, *rest))

    for r in obstacles.itertuples():
        keep(r.x, r.y, r.w, r.h, r.scale)
    out = []
    for r in labels.itertuples():
        cx, cy = math.floor(r.x / reach), math.floor(r.y / reach)
        near = [k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((cx + i, cy + j), ())]
        scale, first, last = 1.0, FULL_TURN, 0.0
        if near:
            o = dict(zip(columns, np.array(near).T, strict=True))
            dx, dy, w, h = o["x"] - r.x, o["y"] - r.y, (o["w"] + r.w) / 2 + padding, (o["h"] + r.h) / 2 + padding
            with np.errstate(divide="ignore"):
                scale = max(1.0, float(np.minimum(w / np.abs(dx), h / np.abs(dy)).max()))
            if scale <= max_scale:
                both = np.maximum(scale, o["scale"])
                firsts, lasts = free_turn(dx * both, dy * both, w, h)
                first, last = float(firsts.min()), float(lasts.max())
        if scale <= max_scale:
            keep(r.x, r.y, r.w, r.h, scale)
            out.append((r.tx, r.ty, r.prio, r.id, r.x, r.y, r.w, r.h, scale, first, last))
    return pd.DataFrame(out, columns=[c.split(" ")[0] for c in PLACED.split(", ")])


def place_map_labels(labels: DataFrame, tile_size: float, max_scale: float = 2.0, padding: float = 1.0) -> DataFrame:
    """I18. (id, scale, first_turn, last_turn) of the labels that find room on a map of any size.

    labels: id, prio, x, y (the anchor, on the map), w, h. At scale s anchors are s times as far apart
    while boxes keep their size; scale is the smallest at which a label is clear of all that were
    placed before it, and those that need more than `max_scale` go. Tiles are dealt four colours, as on
    a chess board of two by two; a colour's tiles don't touch each other and are worked on at the same
    time, and labels of earlier colours, also of neighbouring tiles, come first; inside a tile the
    smaller prio, then the smaller id. A map that is turned by less than first_turn, or by more than
    last_turn up to a full one, keeps the label clear of those placed before it, at the scale at which
    both are drawn. Tiles are made as large as labels that can touch need them to be. Labels with nulls
    go; equal anchors leave room for one label; repeated rows are labels of their own.
    """
    known = labels.select("id", F.col("prio").cast("double").alias("prio"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h"))).dropna()
    size = known.agg(F.max("w").alias("w"), F.max("h").alias("h")).first()
    reach = math.hypot((size["w"] or 0) + 2 * padding, (size["h"] or 0) + 2 * padding) + 1e-9
    side = max(float(tile_size), reach)
    tile = lambda c: F.floor(F.col(c) / side)
    tiled = cut_lineage(known.withColumn("tx", tile("x")).withColumn("ty", tile("y")))
    session = labels.sparkSession
    placed = session.createDataFrame([], PLACED)
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    for colour in range(4):
        mine = tiled.where((F.pmod("tx", F.lit(2)) + 2 * F.pmod("ty", F.lit(2))) == colour)
        around = placed.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("tx", F.col("tx") + F.col("dx")).withColumn("ty", F.col("ty") + F.col("dy"))
        close = lambda c, t: (F.col(c) > F.col(t) * side - reach) & (F.col(c) < (F.col(t) + 1) * side + reach)
        around = around.where((F.pmod("tx", F.lit(2)) + 2 * F.pmod("ty", F.lit(2))) == colour).where(close("x", "tx") & close("y", "ty"))
        run = lambda a, b: _place(a, b, max_scale, padding, reach)
        made = mine.groupBy("tx", "ty").cogroup(around.select("tx", "ty", "x", "y", "w", "h", "scale").groupBy("tx", "ty")).applyInPandas(run, PLACED)
        placed = cut_lineage(placed.unionByName(made))
    return placed.select("id", "scale", "first_turn", "last_turn")
