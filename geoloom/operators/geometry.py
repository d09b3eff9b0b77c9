"""Geometry that needs more than column expressions: simplification, rings, merging, clipping, labels.

Per-object functions are Arrow pandas UDFs; per-group ones run under applyInPandas by relation,
tile or line class. Plain arrays of numbers go in and out.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.chains import chain_positions
from geoloom.operators.components import GROUP_ROWS, components, dealt
from geoloom.session import cut_lineage, in_parts, ranked, written

MERCATOR_LIMIT = 85.0511
MEMBER_ROWS = 20_000  # member ways that a task joins


def pixels(lat: np.ndarray, lon: np.ndarray, zoom: float) -> tuple[np.ndarray, np.ndarray]:
    """Fractional tile coordinates."""
    rad = np.radians(np.clip(lat, -MERCATOR_LIMIT, MERCATOR_LIMIT))
    n = 2.0**zoom
    return (lon + 180) / 360 * n, (1 - np.log(np.tan(rad) + 1 / np.cos(rad)) / math.pi) / 2 * n


def _off_line(x: np.ndarray, y: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distances of the points between a and b from segment a-b."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
    whole = dx * dx + dy * dy
    share = np.clip((px * dx + py * dy) / whole, 0, 1) if whole > 0 else np.zeros(len(px))
    return np.hypot(px - share * dx, py - share * dy)


def _crosses(x: np.ndarray, y: np.ndarray, a: int, b: int) -> bool:
    """Whether segment a-b crosses another segment of the line."""
    i = np.r_[np.arange(0, max(a - 1, 0)), np.arange(b + 1, len(x) - 1)]
    if not len(i):
        return False
    turn = lambda ax, ay, bx, by, cx, cy: (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)
    cx, cy, dx, dy = x[i], y[i], x[i + 1], y[i + 1]
    one = turn(x[a], y[a], cx, cy, dx, dy) != turn(x[b], y[b], cx, cy, dx, dy)
    return bool((one & (turn(x[a], y[a], x[b], y[b], cx, cy) != turn(x[a], y[a], x[b], y[b], dx, dy))).any())


def simplify(x: np.ndarray, y: np.ndarray, epsilon: float, guard: bool = False, fixed: np.ndarray | None = None) -> np.ndarray:
    """I1. Kept flags of Douglas-Peucker with an explicit stack.

    Ends that coincide with the start are trimmed first (a closed line keeps its first point twice
    in the result of `simplified_points`). guard: also split where the shortcut would cross the line.
    fixed: points that stay.
    """
    n = len(x)
    kept = np.zeros(n, bool)
    last = n - 1
    while last > 0 and abs(x[0] - x[last]) + abs(y[0] - y[last]) < 1e-3:
        last -= 1
    if last < 1:
        return kept
    kept[[0, last]] = True
    if fixed is not None:
        kept[: last + 1] |= fixed[: last + 1]
    stops = np.flatnonzero(kept)
    stack = list(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = _off_line(x, y, a, b)
        at = a + 1 + int(d.argmax())
        if d.max() >= epsilon or (guard and _crosses(x, y, a, b)):
            kept[at] = True
            stack += [(a, at), (at, b)]
    return kept


def simplified_points(lat: np.ndarray, lon: np.ndarray, zoom: int, epsilon: float, guard: bool = False) -> list[int]:
    """I1. Indexes of the points that stay, the first again at the end of a closed line."""
    x, y = pixels(lat, lon, min(zoom, 31))
    kept = simplify(x, y, epsilon, guard)
    out = np.flatnonzero(kept).tolist()
    if out and len(lat) > 1 and abs(x[0] - x[-1]) + abs(y[0] - y[-1]) < 1e-3:
        out.append(0)
    return out


Lines = tuple[np.ndarray, np.ndarray, np.ndarray]  # points of all lines one after the other, and where each line starts


def _flat(a: pd.Series, o: pd.Series) -> Lines:
    """The numbers of two columns of arrays of equal sizes."""
    starts = np.r_[0, np.cumsum([len(v) for v in a])].astype(np.int64)
    join = lambda c: np.concatenate([np.zeros(0), *c]).astype(float)
    return join(a), join(o), starts


def _last_apart(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line the last point that isn't where its first is; its first where there is none, or no point."""
    first = starts[:-1]
    line = np.repeat(np.arange(len(first)), np.diff(starts))
    last = first.copy()
    apart = np.flatnonzero(np.abs(x - x[first[line]]) + np.abs(y - y[first[line]]) >= 1e-3) if len(x) else np.zeros(0, np.int64)
    np.maximum.at(last, line[apart], apart)
    return last


def simplify_many(x: np.ndarray, y: np.ndarray, starts: np.ndarray, epsilon: float, fixed: np.ndarray | None = None) -> np.ndarray:
    """`simplify` for many lines at once: kept flags of all points. Every round looks at all segments that
    are left, so there are as many rounds as the deepest line has splits below each other."""
    kept = np.zeros(len(x), bool)
    last = _last_apart(x, y, starts)
    first, last = starts[:-1][last > starts[:-1]], last[last > starts[:-1]]
    if not len(first):
        return kept
    kept[first] = kept[last] = True
    if fixed is not None:
        inner = np.zeros(len(x) + 1, np.int64)
        np.add.at(inner, first, 1)
        np.add.at(inner, last + 1, -1)
        kept |= fixed & (np.cumsum(inner)[:-1] > 0)
    stops = np.flatnonzero(kept)
    line = np.searchsorted(starts, stops, side="right")
    a, b = stops[:-1], stops[1:]
    inside = (line[:-1] == line[1:]) & (b - a > 1)
    a, b = a[inside], b[inside]
    while len(a):
        size = b - a - 1
        begin = np.r_[0, np.cumsum(size)[:-1]]
        seg = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(seg)) - begin[seg] + a[seg] + 1
        dx, dy = (x[b] - x[a])[seg], (y[b] - y[a])[seg]
        px, py = x[at] - x[a][seg], y[at] - y[a][seg]
        whole = dx * dx + dy * dy
        share = np.clip(np.divide(px * dx + py * dy, whole, out=np.zeros(len(whole)), where=whole > 0), 0, 1)
        # as SQL has it: a square root of squares, which differs from hypot in the last bit, so equal distances stay equal
        off = np.sqrt((px - share * dx) ** 2 + (py - share * dy) ** 2)
        most = np.maximum.reduceat(off, begin)
        top = np.flatnonzero(off == most[seg])
        far = at[top[np.searchsorted(seg[top], np.arange(len(a)))]]  # the first of equal ones
        split = most >= epsilon
        a, b, far = a[split], b[split], far[split]
        kept[far] = True
        a, b = np.r_[a, far], np.r_[far, b]
        a, b = a[b - a > 1], b[b - a > 1]
    return kept


def _kept_lists(kept: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The numbers of kept points line by line."""
    at = np.flatnonzero(kept)
    cuts = np.searchsorted(at, starts)
    line = np.repeat(np.arange(len(starts) - 1), np.diff(cuts))
    return np.split((at - starts[:-1][line]).astype(np.int32), cuts[1:-1])


def _simplified_many(lat: np.ndarray, lon: np.ndarray, starts: np.ndarray, zoom: int, epsilon: float) -> list[np.ndarray]:
    """`simplified_points` for many lines at once."""
    x, y = pixels(lat, lon, min(zoom, 31))
    out = _kept_lists(simplify_many(x, y, starts, epsilon), starts)
    some = np.flatnonzero(np.diff(starts) > 1)
    a, b = starts[some], starts[some + 1] - 1
    for i in some[np.abs(x[a] - x[b]) + np.abs(y[a] - y[b]) < 1e-3].tolist():
        if len(out[i]):
            out[i] = np.append(out[i], np.int32(0))
    return out


def simplify_lines(lines: DataFrame, zoom: int, epsilon: float = 3.0, guard: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """I1. (id, kept array<int>) of lines (id, lats, lons), and the columns `keep`."""

    @F.pandas_udf("array<int>")
    def run(lats: pd.Series, lons: pd.Series) -> pd.Series:
        if not guard and (lats.map(len) == lons.map(len)).all():
            return pd.Series(_simplified_many(*_flat(lats, lons), zoom, epsilon), dtype=object)
        return pd.Series([simplified_points(np.asarray(a, float), np.asarray(o, float), zoom, epsilon, guard) for a, o in zip(lats, lons, strict=True)])

    once = run.asNondeterministic()  # so that a filter on `kept` isn't a second call
    return lines.select("id", once("lats", "lons").alias("kept"), *keep)


def simplify_cycles(rings: DataFrame, zoom: int, smoothness: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """I2. (id, kept) of closed ways that aren't too small at the zoom, and the columns `keep`; none with
    under two points."""

    @F.pandas_udf("array<int>")
    def run(lats: pd.Series, lons: pd.Series) -> pd.Series:
        lat, lon, starts = _flat(lats, lons)
        x, y = pixels(lat, lon, zoom + min(smoothness // 2, 3))
        some = np.flatnonzero(np.diff(starts) > 0)  # those between have no points, so neighbours bound each other
        span = lambda v: np.maximum.reduceat(v, starts[some]) - np.minimum.reduceat(v, starts[some]) if len(some) else v[:0]
        w, h = np.zeros(len(lats)), np.zeros(len(lats))
        w[some], h[some] = span(np.floor(x * 256)), span(np.floor(y * 256))
        small = (np.diff(starts) < 2) | ((w <= 2) & (h <= 4)) | ((w <= 4) & (h <= 2))
        kept = _simplified_many(lat, lon, starts, zoom + 8 + smoothness, 3.0)
        return pd.Series([k if len(k) >= 2 and not s else k[:0] for k, s in zip(kept, small.tolist(), strict=True)], dtype=object)

    once = run.asNondeterministic()  # so that the filter isn't a second call
    return rings.select("id", once("lats", "lons").alias("kept"), *keep).where(F.size("kept") > 0)


def simplify_roads(lines: DataFrame, epsilon_m: float = 15.0) -> DataFrame:
    """I3. (id, kept) with an error in metres; points where other roads attach stay.
    lines: id, lats, lons, fixed array<boolean>."""

    @F.pandas_udf("array<int>")
    def run(lats: pd.Series, lons: pd.Series, fixed: pd.Series) -> pd.Series:
        lat, lon, starts = _flat(lats, lons)
        metres = math.pi / 180 * 6372800
        size, total = np.diff(starts), np.zeros(len(lats))
        np.add.at(total, np.repeat(np.arange(len(size)), size), lat)  # in the order of the points, as SQL adds them
        mean = total / np.maximum(size, 1)
        y, x = lat * metres, lon * metres * np.repeat(np.cos(np.radians(mean)), size)
        flags = np.concatenate([np.zeros(0, bool), *fixed]).astype(bool)
        return pd.Series(_kept_lists(simplify_many(x, y, starts, epsilon_m, flags), starts), dtype=object)

    return lines.select("id", run("lats", "lons", "fixed").alias("kept"))


def skip_close_points(x: np.ndarray, y: np.ndarray, limit: float = 31.0) -> list[int]:
    """E7. Indexes kept: a point goes while it is within `limit` of the line from the last kept to the next."""
    kept = [0] if len(x) else []
    for i in range(1, len(x) - 1):
        a, b = kept[-1], i + 1
        sx, sy = np.array([x[a], x[i], x[b]], float), np.array([y[a], y[i], y[b]], float)
        if _off_line(sx, sy, 0, 2)[0] > limit:
            kept.append(i)
    return kept + [len(x) - 1] if len(x) > 1 else kept


def skip_close(lines: DataFrame, limit: float = 31.0) -> DataFrame:
    """E7. (id, kept) of lines (id, xs, ys) in 31-bit units."""

    @F.pandas_udf("array<int>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([skip_close_points(np.asarray(x, float), np.asarray(y, float), limit) for x, y in zip(xs, ys, strict=True)])

    return lines.select("id", run("xs", "ys").alias("kept"))


def join_ways(ways: list[list[int]]) -> list[list[int]]:
    """I5. Ways (lists of node ids) joined at equal ends, in any direction, into rings and lines.

    Ends are looked up in a table, so the work grows with the number of ways. Ways of fewer than
    two nodes are left out; where several fit, the first by position is taken.
    """
    left = {i: list(w) for i, w in enumerate(ways) if len(w) >= 2}
    at: dict[int, set[int]] = defaultdict(set)
    for i, w in left.items():
        if w[0] != w[-1]:
            at[w[0]].add(i)
            at[w[-1]].add(i)
    done = []
    for i in sorted(left):
        if i not in left:
            continue
        line = left.pop(i)
        if line[0] != line[-1]:
            at[line[0]].discard(i)
            at[line[-1]].discard(i)
        grown = True
        while grown and line[0] != line[-1]:
            grown = False
            for end in (line[-1], line[0]):
                if at[end]:
                    j = min(at[end])
                    other = left.pop(j)
                    at[other[0]].discard(j)
                    at[other[-1]].discard(j)
                    if end == line[-1]:
                        line += other[1:] if other[0] == end else other[-2::-1]
                    else:
                        line = (other[:-1] if other[-1] == end else other[:0:-1]) + line
                    grown = True
                    break
        done.append(line)
    return done


def assemble_rings(member_ways: DataFrame) -> DataFrame:
    """I5. (rel_id, role, ring, node_ids, closed) from (rel_id, role, ord, node_ids)."""

    @F.pandas_udf("array<array<bigint>>")
    def joined(ways: pd.Series) -> pd.Series:
        return pd.Series([join_ways([list(w) for w in held]) for held in ways], dtype=object)

    key = ("rel_id", "role")
    way = F.struct(F.col("ord").isNull().alias("unplaced"), "ord", "node_ids")
    held = in_parts(member_ways.select(*key, way.alias("way")), MEMBER_ROWS, *key).groupBy(*key).agg(F.array_sort(F.collect_list("way"))["node_ids"].alias("ways"))
    rings = held.select(*key, F.posexplode(joined("ways")).alias("ring", "node_ids"))
    return rings.withColumn("closed", F.element_at("node_ids", 1) == F.element_at("node_ids", -1))


def inside_ring(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I7. Ray casting parity of points against a closed ring."""
    x1, y1, x2, y2 = x[:-1], y[:-1], x[1:], y[1:]
    over = (y1[None] > py[:, None]) != (y2[None] > py[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1[None] + (py[:, None] - y1[None]) * (x2 - x1)[None] / (y2 - y1)[None]
    return (over & (px[:, None] < at)).sum(axis=1) % 2 == 1


def is_clockwise(x: np.ndarray, y: np.ndarray) -> bool:
    """I7. Orientation of a closed ring, y upwards."""
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) < 0


def build_multipolygons(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C20, I6. Polygons (rel_id, polygon, outer, inners) and rejects (rel_id, reason).

    rings: rel_id, role, ring, lats, lons, closed. Each inner ring goes to the first outer ring that
    holds all its points while it holds none of the outer's; open rings and inner rings without an
    outer are rejected. outer and inners are ring numbers.
    """

    def built(rel: int, pdf: pd.DataFrame) -> list[tuple]:
        out: list[tuple] = []
        shape = {}
        for role, ring, lats, lons, closed in zip(pdf["role"], pdf["ring"], pdf["lats"], pdf["lons"], pdf["closed"], strict=True):
            if closed:
                shape[role, ring] = (np.asarray(lons, float), np.asarray(lats, float))
            else:
                out.append((rel, -1, -1, [], "open ring"))
        outers = [k for k in shape if k[0] == "outer"]
        holes: dict[tuple, list[int]] = {k: [] for k in outers}
        for k in (k for k in shape if k[0] == "inner"):
            x, y = shape[k]
            home = next((o for o in outers if inside_ring(x, y, *shape[o]).all() and not inside_ring(*shape[o], x, y).any()), None)
            if home is None:
                out.append((rel, -1, -1, [int(k[1])], "inner without outer"))
            else:
                holes[home].append(int(k[1]))
        return out + [(rel, i, int(o[1]), holes[o], "") for i, o in enumerate(outers)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All relations of a group, one after the other."""
        codes, rels = pd.factorize(pdf["rel_id"], use_na_sentinel=False)
        order = np.lexsort((pdf["ring"].to_numpy(), codes))
        pdf, cuts = pdf.iloc[order], np.searchsorted(codes[order], np.arange(len(rels) + 1))
        out = [row for i, rel in enumerate(rels.tolist()) for row in built(rel, pdf.iloc[cuts[i] : cuts[i + 1]])]
        return pd.DataFrame(out, columns=["rel_id", "polygon", "outer", "inners", "reason"])

    rings = rings.select("rel_id", "role", "ring", "lats", "lons", "closed")
    group = dealt(rings.count(), "rel_id")
    grouped = in_parts(rings.withColumn("group", group), GROUP_ROWS, "group")
    made = grouped.groupBy("group").applyInPandas(run, "rel_id long, polygon int, outer int, inners array<int>, reason string")
    made = cut_lineage(made)
    return made.where("reason = ''").drop("reason"), made.where("reason <> ''").select("rel_id", "inners", "reason")


def merge_lines(lines: DataFrame) -> DataFrame:
    """C24. (level, types, line_ids, node_ids, name): lines of one level and types chained at shared ends.

    lines: id, level, types (array), name, node_ids. At every node the lines that end there and those
    that begin there choose each other, the smallest free ids first, until one side has none left: the
    k-th smallest that ends goes on in the k-th smallest that begins (of equal ids, in any order). A
    line isn't followed by itself. Where no more than one line ends and one begins at a node, that is
    also what a walk from any line finds. A circle begins with its smallest id. The name is that of
    all lines of the chain, null if they differ. Lines without nodes are chains by themselves.
    """
    kind = F.array_join(F.col("types").cast("array<string>"), ",")
    lines = ranked(lines.select("id", "level", "types", "name", "node_ids", kind.alias("kind")), "id", "level", "kind")
    lines = written(lines.withColumnRenamed("n", "line"))
    some = lines.where(F.size("node_ids") > 0)
    turn = F.row_number().over(Window.partitionBy("level", "kind", "node").orderBy("line"))
    ends = some.select("level", "kind", F.element_at("node_ids", -1).alias("node"), "line").withColumn("turn", turn)
    starts = some.select("level", "kind", F.element_at("node_ids", 1).alias("node"), F.col("line").alias("next")).withColumn("turn", F.row_number().over(Window.partitionBy("level", "kind", "node").orderBy("next")))
    links = ends.join(starts, ["level", "kind", "node", "turn"]).where("line <> next").select(F.col("next").alias("node"), F.col("line").alias("prev"))
    placed = lines.join(chain_positions(links).withColumnRenamed("node", "line"), "line", "left")
    chains = placed.groupBy(F.coalesce("head", "line").alias("chain")).agg(
        F.first("level").alias("level"), F.first("types").alias("types"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "id", F.coalesce("node_ids", F.array()).alias("nodes")))).alias("parts"),
        F.when(F.count("name") == F.count("*"), F.when(F.min("name") == F.max("name"), F.min("name"))).alias("name"),
    )
    path = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["nodes"]).otherwise(F.slice(p["nodes"], F.lit(2), F.greatest(F.size(p["nodes"]) - 1, F.lit(0))))))
    return chains.select("level", "types", F.col("parts.id").alias("line_ids"), path.alias("node_ids"), "name")


def chain_roads(roads: DataFrame, most_degrees: float = 90.0) -> DataFrame:
    """I11. (chain, road_ids): roads of one class, ref and name continued at their ends by the road of
    the smallest turning angle below `most_degrees`; pairs take each other only if both prefer it.
    roads: id, class, ref, name, node_ids, lats, lons. Roads of under two points are chains by themselves.

    Ends choose among those at their node, which are one row of it, in column expressions; an end without
    a direction (null coordinates) takes no part. The pairs make chains, which are walked in groups of
    whole chains.
    """
    roads = cut_lineage(roads.select("id", "class", "ref", "name", "node_ids", "lats", "lons"))
    point = lambda c, i: F.element_at(c, i)
    side = lambda n, p, q: F.struct(
        F.lit(n).alias("side"), point("node_ids", p).alias("node"), F.atan2(point("lats", q) - point("lats", p), point("lons", q) - point("lons", p)).alias("angle")
    )
    both = roads.where((F.size("node_ids") > 1) & (F.size("lats") > 1))
    ends = both.select("id", "class", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("name", F.lit("")).alias("name"), F.explode(F.array(side(0, 1, 2), side(1, -1, -2))).alias("e"))
    ends = ends.select("id", "class", "ref", "name", "e.*").where("angle IS NOT NULL")
    met = ends.groupBy("class", "ref", "name", "node").agg(F.array_sort(F.collect_list(F.struct("id", "side", "angle"))).alias("ends")).where(F.size("ends") > 1)

    def turn(a: Column, b: Column) -> Column:
        d = a["angle"] - b["angle"] + math.pi
        return F.abs(F.degrees(math.pi - F.abs((d - F.floor(d / (2 * math.pi)) * (2 * math.pi)) - math.pi)))

    other = lambda e: F.filter("ends", lambda o: o["id"] != e["id"])
    best = lambda e: F.array_min(F.transform(other(e), lambda o: F.struct(turn(e, o).alias("turn"), o["id"].alias("id"), o["side"].alias("side"))))
    chosen = F.transform("ends", lambda e: F.struct(e["id"].alias("id"), e["side"].alias("side"), best(e).alias("to")))
    chosen = met.select(F.filter(chosen, lambda e: e["to"]["turn"] < most_degrees).alias("chosen"))
    same = lambda a, b: (a["id"] == b["id"]) & (a["side"] == b["side"])
    mutual = F.filter("chosen", lambda e: F.exists("chosen", lambda o: same(o, e["to"]) & same(o["to"], e)))
    links = chosen.select(F.explode(mutual).alias("e")).select(F.col("e.id").alias("a"), F.col("e.side").alias("a_side"), F.col("e.to.id").alias("b"), F.col("e.to.side").alias("b_side"))
    links = cut_lineage(links)
    roots = components(links)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        link = {(r.a, r.a_side): (r.b, r.b_side) for r in pdf.itertuples()}
        seen, out = set(), []
        for i in sorted(set(pdf["a"])):
            if i in seen:
                continue
            chain, seen_here = deque([i]), {i}
            for side in (0, 1):
                at, s = i, side
                while (nxt := link.get((at, s))) and nxt[0] not in seen_here:
                    at, s = nxt[0], 1 - nxt[1]
                    seen_here.add(at)
                    chain.appendleft(at) if side == 0 else chain.append(at)
            seen |= seen_here
            out.append((int(min(chain)), [int(c) for c in chain]))
        return pd.DataFrame(out, columns=["chain", "road_ids"])

    rooted = links.join(roots.select(F.col("node").alias("a"), "root"), "a")
    walked = rooted.groupBy(dealt(links.count(), "root").alias("group")).applyInPandas(walk, "chain long, road_ids array<long>")
    alone = roads.select("id").distinct().join(links.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    return walked.unionByName(alone.select(F.col("id").alias("chain"), F.array("id").alias("road_ids")))


def clip_segment(ax: float, ay: float, bx: float, by: float, box: tuple[float, float, float, float]) -> tuple[float, float, float, float] | None:
    """I14. The part of a segment inside a box (min x, min y, max x, max y), or None."""
    t0, t1, dx, dy = 0.0, 1.0, bx - ax, by - ay
    for p, q in ((-dx, ax - box[0]), (dx, box[2] - ax), (-dy, ay - box[1]), (dy, box[3] - ay)):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    if t0 > t1:
        return None
    return ax + t0 * dx, ay + t0 * dy, ax + t1 * dx, ay + t1 * dy


def clip_segments(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """I14. Segments (id, ax, ay, bx, by) cut to a box, as column expressions."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    dx, dy = bx - ax, by - ay
    enter, leave, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, ax - box[0]), (dx, box[2] - ax), (-dy, ay - box[1]), (dy, box[3] - ay)):
        t = F.try_divide(q, p)
        enter = F.when(p < 0, F.greatest(enter, t)).otherwise(enter)
        leave = F.when(p > 0, F.least(leave, t)).otherwise(leave)
        out = out | ((p == 0) & (q < 0))
    timed = segments.select("*", enter.alias("__in"), leave.alias("__out"), out.alias("__gone")).where("NOT __gone AND __in <= __out")
    at = lambda a, d, t: a + d * F.col(t)
    return timed.select("id", at(ax, dx, "__in").alias("ax"), at(ay, dy, "__in").alias("ay"), at(ax, dx, "__out").alias("bx"), at(ay, dy, "__out").alias("by"))


def _around(x: float, y: float, box: tuple[float, float, float, float]) -> float:
    """Position on a box's edge, counter-clockwise from the lower left corner, in 0..4."""
    x0, y0, x1, y1 = box
    if y == y0:
        return (x - x0) / (x1 - x0)
    if x == x1:
        return 1 + (y - y0) / (y1 - y0)
    if y == y1:
        return 2 + (x1 - x) / (x1 - x0)
    return 3 + (y1 - y) / (y1 - y0)


def _clipped_pieces(lines: list[np.ndarray], box: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """The parts of lines inside a box as lists of points, in order: `clip_segment` for all segments at once."""
    lines = [line for line in lines if len(line) > 1]
    if not lines:
        return []
    points = np.concatenate(lines).astype(float)
    inner = np.ones(len(points), bool)
    inner[np.cumsum([len(line) for line in lines]) - 1] = False  # no segment from a line's last point
    at = np.flatnonzero(inner)
    (ax, ay), (bx, by) = points[at].T, points[at + 1].T
    dx, dy = bx - ax, by - ay
    t0, t1, out = np.zeros(len(at)), np.ones(len(at)), np.zeros(len(at), bool)
    for p, q in ((-dx, ax - box[0]), (dx, box[2] - ax), (-dy, ay - box[1]), (dy, box[3] - ay)):
        t = np.divide(q, p, out=np.zeros(len(at)), where=p != 0)
        t0, t1 = np.where(p < 0, np.fmax(t0, t), t0), np.where((p < 0) | (p == 0), t1, np.fmin(t1, t))
        out |= (p == 0) & (q < 0)
    out |= t0 > t1
    cut = np.column_stack([ax + t0 * dx, ay + t0 * dy, ax + t1 * dx, ay + t1 * dy])
    kept = np.flatnonzero(~out & ((cut[:, 0] != cut[:, 2]) | (cut[:, 1] != cut[:, 3])))
    cut, at = np.minimum(np.maximum(cut[kept], [box[0], box[1]] * 2), [box[2], box[3]] * 2), at[kept]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (cut[1:, :2] != cut[:-1, 2:]).any(axis=1)
    pieces: list[list[tuple[float, float]]] = []
    for new, (x0, y0, x1, y1) in zip(fresh.tolist(), cut.tolist(), strict=True):
        if new:
            pieces.append([(x0, y0)])
        pieces[-1].append((x1, y1))
    return pieces


def coast_polygons(lines: list[np.ndarray], box: tuple[float, float, float, float]) -> tuple[list[np.ndarray], int]:
    """I13. Closed rings of coastlines in a box, and the number of broken pieces.

    Lines (n x 2, y upwards) are cut to the box and chained at equal ends. Land is on the left, so a
    piece that leaves the box goes on counter-clockwise along the edges to where the next one enters.
    Closed lines inside stay; pieces that end inside the box are broken.
    """
    x0, y0, x1, y1 = box
    pieces = _clipped_pieces(lines, box)
    by_start: dict[tuple, deque[int]] = defaultdict(deque)
    for i, p in enumerate(pieces):
        by_start[p[0]].append(i)
    used, chained = set(), []
    incoming = {p[-1] for p in pieces}
    for i in sorted(range(len(pieces)), key=lambda i: (pieces[i][0] in incoming, i)):
        if i in used:
            continue
        used.add(i)
        line = list(pieces[i])
        while line[0] != line[-1] and (waiting := by_start.get(line[-1])):
            j = waiting.popleft()
            if j not in used:
                used.add(j)
                line += pieces[j][1:]
        chained.append(line)
    edge = lambda p: p[0] in (x0, x1) or p[1] in (y0, y1)
    rings = [p for p in chained if p[0] == p[-1]]
    open_ = [p for p in chained if p[0] != p[-1] and edge(p[0]) and edge(p[-1])]
    broken = len(chained) - len(rings) - len(open_)
    corners = [(0.0, (x0, y0)), (1.0, (x1, y0)), (2.0, (x1, y1)), (3.0, (x0, y1))]
    # pieces in the order of their starts round the box; the next free one from a place on is found by halving
    starts = [_around(*p[0], box) for p in open_]
    order = sorted(range(len(open_)), key=lambda i: (starts[i] % 4, i))
    places, rank = [starts[i] % 4 for i in order], {i: k for k, i in enumerate(order)}
    skip = list(range(len(order) + 1))

    def free(k: int) -> int:
        while skip[k] != k:
            skip[k] = skip[skip[k]]
            k = skip[k]
        return k

    for first in range(len(open_)):
        if free(rank[first]) != rank[first]:
            continue
        skip[rank[first]] = rank[first] + 1
        ring = list(open_[first])
        while True:
            here = _around(*ring[-1], box)
            gap = lambda i: (starts[i] - here) % 4  # noqa: B023, E731
            k = free(bisect_left(places, here % 4))
            k = free(0) if k == len(order) else k
            at = first if k == len(order) or gap(first) <= gap(order[k]) else order[k]
            ring += [c for k, c in sorted(corners, key=lambda kc: (kc[0] - here) % 4) if 0 < (k - here) % 4 < gap(at)]
            if at == first:
                ring.append(ring[0])
                break
            ring += open_[at]
            skip[rank[at]] = rank[at] + 1
        rings.append(ring)
    return [np.array(r) for r in rings], broken


def polygonize_coast(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """I13. (tile, kind land or water, xs, ys) by tile; lines: tile, line_id, ord, x, y; boxes: tile,
    min_x, min_y, max_x, max_y. Counter-clockwise rings are land. A tile whose rings are all islands
    inside it gets a ring of water around it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        box = tuple(float(pdf[c].iloc[0]) for c in ("min_x", "min_y", "max_x", "max_y"))
        tile = pdf["tile"].iloc[0]
        pdf = pdf.dropna(subset=["line_id"]).sort_values(["line_id", "ord"])
        ids, points = pdf["line_id"].to_numpy(), pdf[["x", "y"]].to_numpy(float)
        lines_ = np.split(points, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        rings, _ = coast_polygons(lines_, box)
        out = []
        on_edge = lambda r: ((r[:, 0] == box[0]) | (r[:, 0] == box[2]) | (r[:, 1] == box[1]) | (r[:, 1] == box[3])).any()
        if rings and not any(on_edge(r) for r in rings) and not any(is_clockwise(r[:, 0], r[:, 1]) for r in rings):
            out.append((tile, "water", [box[0], box[0], box[2], box[2], box[0]], [box[1], box[3], box[3], box[1], box[1]]))
        for r in rings:
            out.append((tile, "water" if is_clockwise(r[:, 0], r[:, 1]) else "land", r[:, 0].tolist(), r[:, 1].tolist()))
        return pd.DataFrame(out, columns=["tile", "kind", "xs", "ys"])

    return lines.join(F.broadcast(boxes) if boxes.count() <= 100_000 else boxes, "tile").groupBy("tile").applyInPandas(
        run, "tile string, kind string, xs array<double>, ys array<double>"
    )


def rewind_rings(parts: list[int], x: list[float], y: list[float]) -> tuple[list[float], list[float]]:
    """I15. A shape's rings with outer ones clockwise and inner ones counter-clockwise; a ring is inner
    if the midpoint of its first edge is inside an odd number of the others."""
    stops = [*parts[1:], len(x)]
    rings = [(np.asarray(x[a:b], float), np.asarray(y[a:b], float)) for a, b in zip(parts, stops, strict=True)]
    ox, oy = [], []
    for i, (rx, ry) in enumerate(rings):
        if len(rx) > 1:
            mx, my = np.array([(rx[0] + rx[1]) / 2]), np.array([(ry[0] + ry[1]) / 2])
            depth = sum(int(inside_ring(mx, my, *r)[0]) for j, r in enumerate(rings) if j != i and len(r[0]) > 2)
            if is_clockwise(rx, ry) == bool(depth % 2):
                rx, ry = rx[::-1], ry[::-1]
        ox += rx.tolist()
        oy += ry.tolist()
    return ox, oy


def rewind(shapes: DataFrame) -> DataFrame:
    """I15. Shapes (rec_no, parts, x, y) with their rings wound as they should be."""

    @F.pandas_udf("struct<x:array<double>,y:array<double>>")
    def run(parts: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = [rewind_rings(list(p), list(a), list(b)) for p, a, b in zip(parts, x, y, strict=True)]
        return pd.DataFrame({"x": [o[0] for o in out], "y": [o[1] for o in out]})

    made = shapes.withColumn("__xy", run("parts", "x", "y"))
    return made.withColumn("x", F.col("__xy.x")).withColumn("y", F.col("__xy.y")).drop("__xy")


#: fixed values: smallest scales of the anchors, in turn, by the largest scale
ANCHOR_SCALES = {1: (0.5,), 2: (0.5, 2.0), 4: (0.5, 4.0, 2.0, 4.0), 8: (0.5, 8.0, 4.0, 8.0, 2.0, 8.0, 4.0, 8.0)}


def line_anchors(lines: DataFrame, spacing: float, max_scale: int = 8, start: int = 0) -> DataFrame:
    """I17. (id, n, x, y, angle, min_scale): points every `spacing` along lines (id, xs, ys); `max_scale` is
    1, 2, 4 or 8, and the turn of scales begins at `start`."""
    scales = ANCHOR_SCALES[max_scale]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, y = np.asarray(r.xs, float), np.asarray(r.ys, float)
                far = np.r_[0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
                marks = np.arange(spacing, far[-1], spacing) if len(x) > 1 else []
                for n, d in enumerate(marks):
                    i = min(int(np.searchsorted(far, d, "right")) - 1, len(x) - 2)
                    k = (d - far[i]) / (far[i + 1] - far[i]) if far[i + 1] > far[i] else 0.0
                    angle = math.atan2(y[i + 1] - y[i], x[i + 1] - x[i])
                    out.append((r.id, n, x[i] + k * (x[i + 1] - x[i]), y[i] + k * (y[i + 1] - y[i]), angle, scales[(start + n) % len(scales)]))
            yield pd.DataFrame(out, columns=["id", "n", "x", "y", "angle", "min_scale"])

    return lines.mapInPandas(run, "id long, n int, x double, y double, angle double, min_scale double")


def place_labels(labels: DataFrame, max_scale: float = 2.0, padding: float = 1.0) -> DataFrame:
    """I18. Labels (tile, id, prio, x, y, w, h) with the smallest scale at which each is free of the
    ones before it, by tile and in order of priority; those that need more than `max_scale` go.

    At scale s anchors are s times as far apart while boxes keep their size.

    Null positions and sizes go. Labels are compared with those in the cells around theirs; a cell is
    as large as two labels of the tile can be apart and still touch.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y", "w", "h"]).sort_values(["prio", "id"])
        across, down = max(pdf["w"].max() + padding, 1e-6), max(pdf["h"].max() + padding, 1e-6)
        kept: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        out = []
        for r in pdf.itertuples():
            scale, cx, cy = 1.0, math.floor(r.x / across), math.floor(r.y / down)
            for cell in [(cx + i, cy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                for x, y, w, h in kept.get(cell, ()):
                    dx, dy = abs(r.x - x), abs(r.y - y)
                    apart_x = ((r.w + w) / 2 + padding) / dx if dx else math.inf
                    apart_y = ((r.h + h) / 2 + padding) / dy if dy else math.inf
                    scale = max(scale, min(apart_x, apart_y))
            if scale <= max_scale:
                kept[cx, cy].append((r.x, r.y, r.w, r.h))
                out.append((r.tile, r.id, scale))
        return pd.DataFrame(out, columns=["tile", "id", "scale"])

    return labels.groupBy("tile").applyInPandas(run, "tile string, id long, scale double")
