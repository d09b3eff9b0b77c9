"""I6. Multipolygons as geometry: nested rows of an outer ring and its holes, one for each outer ring,
and their simplification for a level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.containment import located_rings
from geoloom.operators.geometry import assemble_rings, build_multipolygons, inside_ring, pixels, simplified_points
from geoloom.session import cut_lineage, in_parts

AT_ONCE = 2_000  # polygons that a task simplifies
RING = "struct<lats:array<double>,lons:array<double>>"
Ring = tuple[np.ndarray, np.ndarray]


def polygons_of_ways(member_ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons and rejects (as in `polygons_of_rings`) of relations whose rings are cut into ways.
    member_ways: rel_id, role, ord, node_ids; nodes: id, lat, lon. Lines that don't close are rejected."""
    made = cut_lineage(assemble_rings(member_ways))
    open_ = made.where("NOT closed").select("rel_id", F.array().cast("array<int>").alias("inners"), F.lit("open ring").alias("reason"))
    rings = cut_lineage(located_rings(made, nodes).withColumnRenamed("b_id", "rel_id").withColumn("closed", F.lit(True)))
    polygons, rejects = polygons_of_rings(rings)
    return polygons, rejects.unionByName(open_)


def polygons_of_rings(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons (id, rel_id, polygon, lats, lons, holes) and rejects (rel_id, inners, reason).

    rings: rel_id, role, ring, lats, lons, closed. A relation gives one polygon for each outer ring,
    numbered from 0 by ring, with a new id made of both; its holes are the inner rings that C20 gives
    it, by ring.
    """
    built, rejects = build_multipolygons(rings)
    own = rings.where("closed").select("rel_id", "role", "ring", "lats", "lons")
    outer = own.where("role = 'outer'").select("rel_id", F.col("ring").alias("outer"), "lats", "lons")
    inner = own.where("role = 'inner'").select("rel_id", F.col("ring").alias("inner"), F.struct("lats", "lons").alias("shape"))
    holes = built.select("rel_id", "polygon", F.explode("inners").alias("inner")).join(inner, ["rel_id", "inner"])
    holes = holes.groupBy("rel_id", "polygon").agg(F.array_sort(F.collect_list(F.struct("inner", "shape")))["shape"].alias("holes"))
    out = built.join(outer, ["rel_id", "outer"]).join(holes, ["rel_id", "polygon"], "left")
    none = F.array().cast(f"array<{RING}>")
    return out.select(F.xxhash64("rel_id", "polygon").alias("id"), "rel_id", "polygon", "lats", "lons", F.coalesce("holes", none).alias("holes")), rejects


def _small(ring: Ring, zoom: float) -> bool:
    """I2's bound: a ring that is only a few pixels wide."""
    x, y = pixels(*ring, zoom)
    w, h = np.ptp(np.floor(x * 256)), np.ptp(np.floor(y * 256))
    return bool((w <= 2 and h <= 4) or (w <= 4 and h <= 2))


def _meet(one: Ring, other: Ring) -> bool:
    """Whether edges of two closed rings cross."""
    (ay, ax), (by, bx) = one, other
    turn = lambda px, py, qx, qy, rx, ry: (ry - py) * (qx - px) - (qy - py) * (rx - px)
    c, d = (bx[None, :-1], by[None, :-1]), (bx[None, 1:], by[None, 1:])
    step = max(1, 1_000_000 // max(1, len(bx)))  # edges at once
    for i in range(0, len(ax) - 1, step):
        j = min(i + step, len(ax) - 1)
        a, b = (ax[i:j, None], ay[i:j, None]), (ax[i + 1 : j + 1, None], ay[i + 1 : j + 1, None])
        if ((turn(*a, *b, *c) * turn(*a, *b, *d) < 0) & (turn(*c, *d, *a) * turn(*c, *d, *b) < 0)).any():
            return True
    return False


def simplified_polygon(outer: Ring, holes: list[Ring], zoom: int, smoothness: int = 2) -> tuple[Ring, list[Ring]] | None:
    """An outer ring and its holes simplified for a zoom; None if the outer ring is too small to see.

    Holes that are too small go. A hole stays inside the outer ring and apart from the others: where
    simplification breaks that, all rings of the polygon are simplified with half the tolerance, at
    last not at all.
    """
    depth = zoom + min(smoothness // 2, 3)
    if len(outer[0]) < 4 or _small(outer, depth):
        return None
    holes = [h for h in holes if len(h[0]) > 3 and not _small(h, depth)]

    def thinned(ring: Ring, epsilon: float) -> Ring:
        kept = simplified_points(*ring, zoom + 8 + smoothness, epsilon)
        return (ring[0][kept], ring[1][kept]) if len(kept) > 3 else ring

    for halving in range(6):
        shell, rest = thinned(outer, 3.0 / 2**halving), [thinned(h, 3.0 / 2**halving) for h in holes]
        fits = all(inside_ring(h[1], h[0], shell[1], shell[0]).all() and not _meet(h, shell) for h in rest)
        if fits and not any(_meet(a, b) for i, a in enumerate(rest) for b in rest[:i]):
            return shell, rest
    return outer, holes


def simplify_polygons(polygons: DataFrame, zoom: int, smoothness: int = 2) -> DataFrame:
    """The same rows with lats, lons and holes simplified for `zoom`; polygons too small to see, and
    those with nulls or under four points, go."""
    columns, schema = polygons.columns, polygons.schema
    at = columns.index

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                lats, lons, holes = row[at("lats")], row[at("lons")], row[at("holes")]
                if lats is None or lons is None:
                    continue
                ring = lambda a, o: (np.asarray(a, float), np.asarray(o, float))
                made = simplified_polygon(ring(lats, lons), [ring(h["lats"], h["lons"]) for h in (holes if holes is not None else [])], zoom, smoothness)
                if made is not None:
                    values = list(row)
                    values[at("lats")], values[at("lons")] = made[0]
                    values[at("holes")] = [{"lats": a, "lons": o} for a, o in made[1]]
                    out.append(values)
            yield pd.DataFrame(out, columns=columns)

    return in_parts(polygons, AT_ONCE).mapInPandas(run, schema)
