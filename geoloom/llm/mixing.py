"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a target number of words (weights, capped at a number of passes over the
source, the excess shared out again) and a weight schedule over training time t in [0, 1]:
its weight moves linearly from `start` to `end`. The integral of the schedule, scaled to the
target, is the source's cumulative token demand D(t); inverting it at a document's place in the
source's stream of words gives the document's training position, in each pass over the source.
Documents are then sorted by range of position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A source's words are laid out in 2**12 hash ranges, whose sums are accumulated first, so
#: that a source with a third of all rows is never ordered in one task.
RANGE_BITS = 12
#: (weight at t = 0, at t = 1), by the source's rank, repeating.
SCHEDULES = ((1.0, 0.5), (0.5, 1.5), (1.0, 1.0))


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, passes: float, schedules: Sequence[tuple[float, float]]
) -> DataFrame:
    """(source, source_size, target, start, end) from (source, source_size), one row a source.

    Water filling: with the sources in order of cap / weight, the level is what is left of the
    total over the weights left; sources whose cap is below it get their cap, the others
    weight * level. Sources are ordered by code point, null last, for the weights and schedules.
    """
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at % len(values) + 1)
    ranked = sizes.select(
        "source",
        "source_size",
        pick([float(w) for w in weights]).alias("weight"),
        pick([float(a) for a, _ in schedules]).alias("start"),
        pick([float(b) for _, b in schedules]).alias("end"),
        (F.col("source_size") * F.lit(float(passes))).alias("cap"),
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("level", level)
    open_ = F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(everything)
    return filled.withColumn("settled", open_).select(
        "source",
        "source_size",
        F.round(F.least("cap", F.coalesce(F.col("weight") * F.col("settled"), F.col("cap"))), 6).alias("target"),
        "start",
        "end",
    )


def _placed(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: Sequence[float],
    share: float,
    passes: int,
    schedules: Sequence[tuple[float, float]],
    seed: int,
    carry: Sequence[str],
) -> DataFrame:
    """Every row with id, size, source_size, target, taken, passes and carry_0 .. carry_n; passes is an
    array of (taken, position), one for each pass over the source."""
    if not 0 < share <= passes:
        raise ValueError("share must be over 0 and at most passes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.md5(text)), F.lit(str(seed)))
    key = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")  # 60 bits
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("of"),  # never null
        size.alias("size"),
        key.alias("key"),
        F.md5(text).alias("tie"),
        F.shiftright(key, 60 - RANGE_BITS).alias("range"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)),
    )
    ranges = rows.groupBy("source", "of", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(
        ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, passes, schedules
    )
    order = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "of", "range", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("base"))
    targets = targets.withColumnRenamed("source", "s")
    starts = materialize(starts.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("source", "s"))
    within = Window.partitionBy("of", "range").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # dealt by (of, range) already: the starts come to the rows
    placed = placed.join(starts, ["of", "range"])
    begin = F.col("base") + F.col("ahead")
    slope = F.col("end") - F.col("start")

    def turn(p: int):
        """What pass p takes of a document, and when its first word of that pass is due: the demand by t
        is target * (start t + (end - start) t^2 / 2) / mean; solved for t."""
        at = begin + F.col("source_size") * p
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - at)).cast("long")
        due = F.try_divide(at, F.col("target")) * ((F.col("start") + F.col("end")) / 2)
        root = F.sqrt(F.greatest(F.lit(0.0), F.col("start") * F.col("start") + 2 * slope * due))
        position = F.when(slope == 0, F.try_divide(due, F.col("start"))).otherwise(F.try_divide(root - F.col("start"), slope))
        return F.struct(taken.alias("taken"), F.when(taken > 0, F.round(position, 9)).alias("position"))

    placed = placed.withColumn("passes", F.array(*(turn(p) for p in range(passes))))
    return placed.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda total, x: total + x["taken"]))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    passes: int = 2,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    seed: int = 17,
) -> DataFrame:
    """(<id_col>, size, source_size, target, taken, positions array<double>), one row per input row,
    sorted by first position.

    size: the text's words (null: 0). share: the mix's words as a share of all words; must be at
    most `passes`, which bounds how often a document is taken. A source's words form a stream:
    its documents in hash order, `passes` times over; the first `target` words are taken, so a
    source's taken words are its target, rounded down, and one document a source may be taken in
    part. positions: for each pass that takes something of the document, when its first word of that
    pass is due, in [0, 1]; a second pass comes a whole source later than the first. Empty if nothing
    is taken. Null is a source of its own. Rows that tie in id and text are interchangeable; reruns
    agree. Empty texts have size and taken 0. An empty table gives an empty result. Columns other than
    those named are not read. The number of sources is taken to fit one task (they are ranked and
    filled in order); documents, ranges and words aren't.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, share, passes, schedules, seed, ())
    due = F.filter(F.transform("passes", lambda x: x["position"]), lambda x: x.isNotNull())
    out = placed.select(
        F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), "taken", due.alias("positions")
    )
    return out.orderBy(F.try_element_at("positions", F.lit(1)), id_col)


def take_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    passes: int = 2,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, in order of position.

    Every copy stands at the position of its own pass, so the copies of a document are a whole pass
    over its source apart. Where a pass takes a document in part, it is taken whole if that is at
    least half of it; texts without words are taken once, by the first pass. Repeated and null ids
    are rows like others, and a null source is one of its own. An empty table stays empty.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, share, passes, schedules, seed, docs.columns)
    half = F.filter("passes", lambda x: (x["taken"] > 0) & (2 * x["taken"] >= F.col("size")))
    copies = placed.withColumn("pass", F.explode(F.when(F.col("size") == 0, F.slice("passes", 1, 1)).otherwise(half)))
    return copies.orderBy("pass.position", "id").select(*(F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)))
