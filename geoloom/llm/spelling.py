"""Spelling variants: words within one edit of each other, found by PartEnum signatures.

A word's letters are a multiset, seen as a binary vector (letter, how many times before). One edit
changes at most two of its dimensions: two if a letter is replaced, one if a letter is inserted or
deleted. The dimensions are dealt into PARTS partitions; two words of one length leave at least
PARTS - 2 of them alone, two of neighbouring lengths PARTS - 1. So a word has a signature for every
choice of that many partitions, over its letters in them; a single edit also leaves the front or
the back half of a word as it is, and each signature comes once with either half. Words that agree
in a signature meet in an equi-join and are verified by their distance, so no near pair is missed
and none is wrong.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import lean, materialize

LEAST_LETTERS, LEAST_COUNT, DELETE_EVERY, TIMES = 7, 2, 31, 10
PARTS = 4
WINDOW = 1 << 20  # bytes of text looked at once; bounds memory, never cuts a run
FLUSH = 1 << 18  # words a task holds before it adds up equal ones

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
_LOWER = np.frombuffer(texthash.LOWER, np.uint8)


def _crc(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 carried on from `state` over each data[start : start + size]."""
    order = np.argsort(-sizes, kind="stable")
    register, starts = (~state[order]).astype(np.uint32), starts[order]
    alive = len(order) - np.searchsorted(sizes[order][::-1], np.arange(int(sizes.max(initial=0))), "right")
    for step, n in enumerate(alive.tolist()):
        head = register[:n]
        register[:n] = _CRC[(head ^ data[starts[:n] + step]) & 0xFF] ^ head >> np.uint32(8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~register
    return out


def _runs(data: np.ndarray, starts: np.ndarray, seeds: np.ndarray, least: int, every: int) -> pa.Array:
    """The words of `data` that are long enough, lower-cased and with their deletions. Texts begin at
    `starts`; seeds: crc32 of what a run's hash has before the run."""
    data = _LOWER[data]
    n = len(data)
    after_c3 = np.zeros(n, bool)
    after_c3[1:] = data[:-1] == 0xC3
    letter = _LETTER[data] | (data == 0xC3) | after_c3  # À to ÿ are C3 80 to C3 BF
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    first = starts[starts < n]
    begin[first] = letter[first]
    first = first[first > 0]
    end[first - 1] = letter[first - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    seconds = np.r_[0, np.cumsum(after_c3)]
    points = e - s - (seconds[e] - seconds[s])
    long_ = points >= least
    s, e, points = s[long_], e[long_], points[long_]
    h = _crc(seeds[np.searchsorted(starts, s, "right") - 1], data, s, e - s)
    cut = h % np.uint32(every) == 0
    kept = np.zeros(n + 1, np.int8)
    kept[s] += 1
    kept[e] -= 1
    kept = np.cumsum(kept[:n]) > 0
    sizes = e - s
    if cut.any():
        leads = np.flatnonzero(letter & ~after_c3)
        at = leads[np.searchsorted(leads, s[cut]) + (h[cut] % points[cut]).astype(np.int64)]
        kept[at] = False
        wide = at[data[at] == 0xC3] + 1
        kept[wide] = False
        sizes[cut] -= 1 + (data[at] == 0xC3)
        points[cut] -= 1
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    return words.filter(pa.array(points >= least))


def _windows(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Parts of a long text that end where no run does."""
    while lo < hi:
        to = min(hi, lo + WINDOW)
        while to < hi and (_LETTER[data[to]] or data[to] == 0xC3 or data[to] & 0xC0 == 0x80):  # up to another character
            to += 1
        yield lo, to
        lo = to


def count_words(docs: DataFrame, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """(word, n): the words of all texts. Tasks add up equal words before the shuffle."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def counted(words: pa.Array) -> pa.Table:
        values = pc.value_counts(words)
        return pa.table({"word": values.field("values").cast(pa.large_string()), "n": values.field("counts").cast(pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in texthash.slices(batches, "text", WINDOW):
            data, offsets = texthash.buffers(batch.column("text"))
            seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column("id").to_pylist()], np.uint32)
            lo, hi = int(offsets[0]), int(offsets[-1])
            if batch.num_rows == 1:
                found = [_runs(data[a:b], np.zeros(1, np.int64), seeds, least, every) for a, b in _windows(data, lo, hi)]
            else:
                found = [_runs(data[lo:hi], offsets[:-1] - lo, seeds, least, every)]
            more = [counted(words) for words in found if len(words)]
            held += more
            size += sum(t.num_rows for t in more)
            if size > FLUSH:
                held = [added(held)]
                size = held[0].num_rows
                if size > FLUSH:
                    yield from held[0].cast(made).to_batches(max_chunksize=1 << 16)
                    held, size = [], 0
        if held:
            yield from added(held).cast(made).to_batches(max_chunksize=1 << 16)

    made = pa.schema([("word", pa.string()), ("n", pa.int64())])
    return rows.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _dimensions(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of all words: the word, the letter and how often it came before; and the
    words' lengths. Letters are sorted within their word."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(word << 21 | points, kind="stable")
    points = points[order]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    before = np.arange(len(points)) - np.repeat(at, np.diff(np.r_[at, len(points)]))
    return word, points, before, sizes


def _text_hash(texts: pa.Array, salt: int) -> np.ndarray:
    """A 64-bit hash of each text's bytes."""
    data, offsets = texthash.buffers(texts)
    lo = int(offsets[0]) if len(offsets) else 0
    data, offsets = data[lo : int(offsets[-1])], offsets - lo
    size = np.diff(offsets)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(texthash.mix(data.astype(np.uint64) << np.uint64(32) | within.astype(np.uint64), salt), out=sums[1:])
    return texthash.mix(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64), salt)


def signatures(words: pa.Array, partition: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, signature, role) of all signatures. Role 0: pairs of one length; 1 the shorter
    and 2 the longer word of a pair of neighbouring lengths. partition: letter -> its partition's
    turn; occurrences of a letter go to the partitions after it in turn."""
    word, letter, before, sizes = _dimensions(words)
    distinct, which = np.unique(letter, return_inverse=True)
    turn = np.array([partition.get(c, c) for c in distinct.tolist()], np.int64)[which]
    part = (turn + before) % PARTS
    sums = np.zeros((len(sizes), PARTS), np.uint64)
    np.add.at(sums, (word, part), texthash.mix((letter << 32 | before).astype(np.uint64)))
    numbers, out, roles, texts = [], [], [], words.to_pylist()
    all_ = np.arange(len(sizes))

    def add(role: int, length: np.ndarray, half: int) -> None:
        """Signatures of pairs whose shorter word has `length` letters. The front half of the shorter
        word is its first length // 2 letters, the back half the rest."""
        cut = (length // 2 if half == 0 else length // 2 - length).tolist()
        key = _text_hash(pa.array([t[:c] if half == 0 else t[c:] for t, c in zip(texts, cut, strict=True)], pa.string()), 3 + half)
        least = PARTS - (2 if role == 0 else 1)
        for n, chosen in enumerate(itertools.combinations(range(PARTS), least)):
            own = sums[:, list(chosen)].sum(axis=1, dtype=np.uint64)
            kind = np.uint64((n << 2 | half << 1 | (role > 0)) + 1) << np.uint64(40)
            numbers.append(all_)
            out.append(texthash.mix(texthash.mix(own + key) + kind + length.astype(np.uint64)))
            roles.append(np.full(len(all_), role, np.int8))

    for half in (0, 1):
        add(0, sizes, half)
        add(1, sizes, half)
        add(2, sizes - 1, half)
    return np.concatenate(numbers), np.concatenate(out).view(np.int64), np.concatenate(roles)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): all ordered pairs of words at a distance of exactly one edit.
    words: word, n; distinct words without null."""
    # at most as many letters as the alphabet has; partitions of about equal weight
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c")
    partition = {ord(r["c"]): i for i, r in enumerate(letters.collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(i, 1 << 13)
                number, sig, role = signatures(part.column("word"), partition)
                picked = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig), pa.array(role), part.column("word").take(picked), part.column("n").take(picked)], ["sig", "role", "word", "n"]
                )

    keyed = words.select("word", "n").mapInArrow(lean(run), "sig long, role byte, word string, n long")
    a = keyed.select("sig", F.col("role").alias("a_role"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select("sig", F.col("role").alias("b_role"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    roles = F.col("a_role") * 4 + F.col("b_role")  # both sides' roles in one term: no side is filtered, so both read one shuffle
    met = a.join(b, "sig").where((roles == 6) | ((roles == 0) & (F.col("a") < F.col("b"))))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n").distinct()
    pairs = materialize(pairs)
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n"))
    return pairs.unionByName(turned)


def spelling_groups(
    docs: DataFrame,
    least: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    delete_every: int = DELETE_EVERY,
    times: int = TIMES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for every word that is found in the texts.

    Runs of A-Z, a-z and U+00C0 to U+00FF are lower-cased (A-Z only); where `delete_every` divides h,
    the crc32 of "<id>:<run>", the code point h % length goes. Words are the results of at least
    `least` code points that are found at least `least_count` times (n). Words are near at a distance
    of exactly one inserted, deleted or replaced code point; n_near counts them. form is the near word
    of the largest n (of equals the first in code-point order) if that is at least `times` the word's
    own n, else null; form_n its n; root where following forms ends, the word itself without one.

    Null and empty texts have no words; a null id counts as empty. Repeated rows count as often as
    they are there. Other columns are not read. A table without words gives no rows. Texts of any
    length are read in windows; no run is cut.
    """
    if times < 2:
        raise ValueError("a form has to be at least twice as frequent, or following forms may not end")
    words = materialize(count_words(docs, id_col, text_col, least, delete_every).where(F.col("n") >= least_count))
    near = near_words(words)
    best = F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("w")))
    per_word = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    named = words.join(per_word, "word", "left")
    far = -F.col("best.m") >= times * F.col("n")
    named = materialize(
        named.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(far, F.col("best.w")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"),
        )
    )
    # every step multiplies n by `times` at least, so chains are short; each round doubles the reach
    steps, size = 0, (named.agg(F.max("n")).first()[0] or 0) // max(least_count, 1)
    while size >= times:
        steps, size = steps + 1, size // times
    hop = named.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    reach = 1
    while reach < steps:
        ahead = hop.select(F.col("word").alias("to"), F.col("to").alias("next"))
        hop = materialize(hop.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
        reach *= 2
    out = named.join(hop, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
