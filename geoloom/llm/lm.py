"""Language-model scoring with a weighted backoff automaton.

Training counts of word n-grams up to `order` are gathered from all training texts. The automaton's
states are the stored n-grams of fewer than `order` words, down to the empty one. A state h of k words
has an arc for every word w that was seen after it, weighted ``(c(h w) + K p(w | h')) / (c(h) + K)``,
h' being h without its first word and K the strength for k words; it leads to the state h w (its last
order - 1 words). Any other word takes the failure arc to h', weighted ``K / (c(h) + K)``, and is
tried again there. The empty state has an arc for every word, ``(c(w) + 1) / (N + V + 1)``. The
weights of a state sum to one over the vocabulary (Dirichlet smoothing).

A text is traversed once from left to right, from the state after an end token; the traversal carries
the state and adds up the logarithms. The texts of a chunk are traversed side by side, long ones in
lanes: the automaton forgets where it started after order - 1 words, so a lane begins that many words
early and is in the right state when it starts to count.

The model is never gathered. Texts become chunks of word numbers, where they are read; a chunk sends
its distinct n-grams, sorted and packed, with its training counts to hash ranges. A range adds up the
counts and answers every chunk in the order of its request; the answers are exactly that chunk's part
of the automaton. Ranges are by the hash of the whole n-gram, so a word that a third of all n-grams
begin with isn't gathered anywhere, and a chunk asks for it once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import lean, lean_group, materialize, release_memory, shuffle_partitions
from .ngram_join import _by_range, _pack_sorted, _unpack_sorted

CHUNK_BYTES = 6 << 20
RANGE_BYTES = 16 << 20  # of text for each hash range of an order
MOST_TASKS = 20_000  # of a shuffle; beyond that a task takes several ranges or chunks, one after the other
LANE = 256
GRAM_BITS = 54  # of an n-gram's key: 2 in 10^6 keys clash in a model of 10^11 n-grams
END = np.uint64(0x51ED270B9A3C5F17)


def _tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and the number of tokens of each."""
    words, counts = texthash.word_hashes(column)
    offsets = np.r_[0, np.cumsum(counts + 1)].astype(np.int64)
    out = np.full(int(offsets[-1]), END, np.uint64)
    place = np.ones(len(out), bool)
    place[offsets[1:] - 1] = False
    out[place] = words
    return out, counts + 1


def _grams(tokens: np.ndarray, first: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 .. order: the key of the n-gram that ends at each token, and which of them exist. The word
    before a text is an end token; nothing is before that. Single words have 64-bit keys, longer n-grams
    GRAM_BITS."""
    keys, there = tokens, np.ones(len(tokens), bool)
    yield keys, there
    for k in range(2, order + 1):
        before = np.r_[END, keys[:-1]][: len(keys)]
        exists = np.r_[True, there[:-1]][: len(keys)]
        if k == 2:
            before[first] = END
        else:
            exists[first] = False
        keys, there = texthash.mix(texthash.mix(before, 41) + tokens, 43), exists
        yield keys >> np.uint64(64 - GRAM_BITS), there


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Two bits for each count; those of 3 and more follow as a byte, those of 255 and more in full."""
    low = np.minimum(counts, 3).astype(np.uint8)
    low = np.r_[low, np.zeros(-len(low) % 4, np.uint8)].reshape(-1, 4)
    bits = (low << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    more = counts[counts >= 3]
    return bits.tobytes(), np.minimum(more, 255).astype(np.uint8).tobytes() + more[more >= 255].astype("<u8").tobytes()


def _unpack_counts(bits: bytes, more: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(bits, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    out = low.ravel()[:n].astype(np.int64)
    at = np.flatnonzero(out == 3)
    out[at] = np.frombuffer(more, np.uint8, len(at))
    out[at[out[at] == 255]] = np.frombuffer(more, "<u8", offset=len(at)).astype(np.int64)
    return out


class Automaton:
    """The part of the automaton that a chunk of texts can reach.

    tokens, first: the chunk's tokens and where its texts begin; counts: for each order, training
    counts of the chunk's distinct n-grams in hash order. `weight[k][g]` and `to[k][g]` are the arcs
    out of states of k words, numbered by the n-gram g of k + 1 words (weight nan: no such arc);
    `arc[k][t]` is the number of the arc that token t could take from there. States are numbered by
    order, then n-gram; 0 is the empty one.
    """

    def __init__(self, tokens: np.ndarray, first: np.ndarray, counts: Sequence[np.ndarray], n: int, v: int, strengths: Sequence[float]):
        order = len(strengths) + 1
        self.first = first
        self.arc, self.weight, self.to, at = [], [], [], []
        for keys, exists in _grams(tokens, first, order):
            _, index, inverse = np.unique(keys[exists], return_index=True, return_inverse=True)
            number = np.full(len(tokens), -1, np.int32)
            number[exists] = inverse
            self.arc.append(number)
            at.append(np.flatnonzero(exists)[index].astype(np.int32))  # a token that ends each n-gram
            del keys, exists, index, inverse
        base = np.cumsum([1, *(len(c) for c in counts[: order - 1])])  # the first state of 1, 2, ... words
        self.depth = np.repeat(np.arange(order, dtype=np.int8), np.diff(np.r_[0, base]))
        self.fail_to = np.zeros(len(self.depth), np.int32)
        self.fail_weight = np.zeros(len(self.depth))
        for k in range(1, order):
            state = slice(base[k - 1], base[k])
            self.fail_weight[state] = np.log10(strengths[k - 1] / (counts[k - 1] + strengths[k - 1]))
            if k > 1:
                self.fail_to[state] = base[k - 2] + self.arc[k - 2][at[k - 1]]
        end = self.arc[0][first[0] - 1] if len(first) and first[0] else (self.arc[0][len(tokens) - 1] if len(tokens) else 0)
        self.start = int(base[0] + end) if order > 1 and len(tokens) and counts[0][end] else 0
        p = (counts[0] + 1) / (n + v + 1)
        self.unigram = np.log10(p)
        for k in range(order):
            if k:
                before = self.arc[k - 1][at[k] - 1]
                if k == 1:
                    before = np.where(np.isin(at[k], first), end, before)
                p = (counts[k] + strengths[k - 1] * p[self.arc[k - 1][at[k]]]) / (counts[k - 1][before] + strengths[k - 1])
            self.weight.append(np.where((counts[k] > 0) | (k == 0), np.log10(p), np.nan))
            suffix = min(k + 1, order - 1)
            to = base[suffix - 1] + self.arc[suffix - 1][at[k]] if suffix else np.zeros(len(p), np.int64)
            self.to.append(np.where(counts[k] > 0, to, 0).astype(np.int32))

    def traverse(self, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of every token, read from left to right."""
        order = len(self.arc)
        out = np.zeros(int(sizes.sum()))
        lanes = -(-sizes // LANE)
        begin = np.repeat(self.first, lanes) + LANE * (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(begin + LANE, np.repeat(self.first + sizes, lanes))
        head = np.repeat(self.first, lanes)
        early = np.maximum(head, begin - (order - 1))
        by_length = np.argsort(early - stop, kind="stable")
        begin, stop, early, head = begin[by_length], stop[by_length], early[by_length], head[by_length]
        length = stop - early
        state = np.where(early == head, self.start, 0)
        for step in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -step, "left"))
            t = early[:live] + step
            at, gained = state[:live], np.zeros(live)
            open_ = np.ones(live, bool)
            for k in range(order - 1, -1, -1):
                here = np.flatnonzero(open_ & (self.depth[at] == k))
                arc = self.arc[k][t[here]]
                weight = np.where(arc >= 0, self.weight[k][arc], np.nan)
                fits = ~np.isnan(weight)
                taken, failed = here[fits], here[~fits]
                gained[taken] += weight[fits]
                at[taken] = self.to[k][arc[fits]]
                open_[taken] = False
                gained[failed] += self.fail_weight[at[failed]]
                at[failed] = self.fail_to[at[failed]]
            counted = t >= begin[:live]
            out[t[counted]] = gained[counted]
        return out


def lm_score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    training: str = "pmod(crc32(cast({id} as string)), 7) <> 2",
    strengths: Sequence[float] = (20.0, 5.0),
) -> DataFrame:
    """(<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    training: SQL for the rows to learn from; {id} stands for the id. A row for which it is null
    (null id) is held out. Words are compared after lower-casing A-Z; each text ends in an end
    token, which counts. Null texts count as empty: one end token. base_score: log10 of the
    add-one unigrams; score: log10 by the automaton. strengths: the Dirichlet strength for states of
    1, 2, ... words; their number is the longest state, the order one more.
    Without training rows N and V are 0. Repeated rows count and score each. Other columns are
    not read. An empty table gives an empty result. A text of any length is one chunk at most.
    """
    spark = docs.sparkSession
    order = len(strengths) + 1
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.expr(training.format(id=f"`{id_col}`")), F.lit(False)).alias("train"),
        F.col(text_col).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks: ids, training flags and sizes of the texts; distinct words; tokens by number."""
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            words, number = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            ids = pa.concat_arrays([h[0] for h in held])
            train = pa.concat_arrays([h[1] for h in held])
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + made], pa.int64()), one(ids), one(train), pa.array([np.concatenate([h[3] for h in held]).astype("<u4").tobytes()]),
                    pa.array([_pack_sorted(words)]), pa.array([(number & 0xFFFF).astype("<u2").tobytes()]),
                    *(pa.array([x], pa.binary()) for x in _pack_counts(number >> 16)),
                ],
                ["chunk", "ids", "train", "sizes", "words", "numbers", "high", "higher"],
            )

        for batch in texthash.slices(batches, "text"):
            tokens, sizes = _tokens(batch.column("text"))
            held.append((batch.column("id"), batch.column("train"), tokens, sizes))
            size += batch.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield emit()
                held, size, made = [], 0, made + 1
        if held:
            yield emit()

    chunks = rows.mapInArrow(lean(encode), f"chunk long, ids array<{id_type}>, train array<boolean>, sizes binary, words binary, numbers binary, high binary, higher binary")
    chunks = materialize(chunks)

    def decode(words: bytes, numbers: bytes, high: bytes, higher: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.frombuffer(numbers, "<u2").astype(np.int64)
        n = np.frombuffer(sizes, "<u4").astype(np.int64)
        return _unpack_sorted(words)[low + (_unpack_counts(high, higher, len(low)) << 16)], np.cumsum(n) - n, n

    packed = ("words", "numbers", "high", "higher", "sizes")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(4, 2 * shuffle_partitions(spark), math.ceil(size / RANGE_BYTES))

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams of a chunk with their training counts, by order and hash range."""
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, train = batch.column("chunk")[i].as_py(), batch.column("train")[i].values
                tokens, first, sizes = decode(*(batch.column(c)[i].as_py() for c in packed))
                learn = np.repeat(train.to_numpy(zero_copy_only=False), sizes)
                for kind, (keys, exists) in enumerate(_grams(tokens, first, order)):
                    distinct, number = np.unique(keys[exists], return_inverse=True)
                    counts = np.bincount(number, learn[exists], len(distinct)).astype(np.int64)
                    out = [
                        (chunk, kind, r, _pack_sorted(distinct[a:b]), *_pack_counts(counts[a:b]))
                        for r, a, b in _by_range(distinct, ranges, 64 if kind == 0 else GRAM_BITS)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[j] for o in out], t) for j, t in enumerate(types)], ["chunk", "kind", "range", "keys", "counts", "large"]
                    )

    def answer(table: pa.Table) -> pa.Table:
        """Total counts, for each request in its own order; and the range's N and V."""
        asked = [_unpack_sorted(b) for b in table.column("keys").to_pylist()]
        coded = zip(table.column("counts").to_pylist(), table.column("large").to_pylist(), map(len, asked), strict=True)
        counts = [_unpack_counts(*c) for c in coded]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)
        stops = np.r_[0, np.cumsum([len(a) for a in asked])]
        replies = [_pack_counts(total[at[a:b]]) for a, b in zip(stops[:-1], stops[1:], strict=True)]
        sizes = [len(a) for a in asked]
        del asked, counts, keys
        words = table.column("kind")[0].as_py() == 0
        n, v = (int(total.sum()), int((total > 0).sum())) if words else (0, 0)
        rest = [0] * (table.num_rows - 1)
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "kind": table.column("kind"),
                "range": table.column("range"),
                "counts": pa.array([r[0] for r in replies], pa.binary()),
                "large": pa.array([r[1] for r in replies], pa.binary()),
                "size": pa.array(sizes, pa.int32()),
                "n": pa.array([n, *rest], pa.int64()),
                "v": pa.array([v, *rest], pa.int64()),
            }
        )

    requests = chunks.select("chunk", "train", *packed).mapInArrow(
        lean(request), "chunk long, kind int, range int, keys binary, counts binary, large binary"
    )
    # as many tasks as ranges, later as chunks: what a task reads doesn't grow with the corpus
    requests = requests.repartition(min(order * ranges, MOST_TASKS), "kind", "range")
    answers = requests.groupBy("kind", "range").applyInArrow(
        lean_group(answer), "chunk long, kind int, range int, counts binary, large binary, size int, n long, v long"
    )
    answers = materialize(answers)
    totals = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, vocabulary = totals["n"] or 0, totals["v"] or 0

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        tokens, first, sizes = decode(*(texts.column(c)[0].as_py() for c in packed))
        known = known.drop_columns(["chunk"])
        parts = sorted(zip(*(known.column(c).to_pylist() for c in ("kind", "range", "counts", "large", "size")), strict=True), key=lambda r: r[:2])
        counts = [np.concatenate([np.zeros(0, np.int64), *(_unpack_counts(*r[2:]) for r in parts if r[0] == k)]) for k in range(order)]
        machine = Automaton(tokens, first, counts, n_train, vocabulary, strengths)
        del tokens, parts
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        word = machine.arc[0]
        held_out = ~texts.column("train")[0].values.to_numpy(zero_copy_only=False).astype(bool)
        out = pa.table(
            {
                "id": texts.column("ids")[0].values,
                "held_out": pa.array(held_out),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(add((counts[0][word] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(first), n_train, np.int64)),
                "base_score": pa.array(add(machine.unigram[word])),
                "score": pa.array(add(machine.traverse(sizes))),
            }
        )
        del machine
        release_memory()
        return out

    tasks = min(max(shuffle_partitions(spark), chunks.count()), MOST_TASKS)
    scored = chunks.select("chunk", "ids", "train", *packed).repartition(tasks, "chunk").groupBy("chunk").cogroup(
        answers.select("chunk", "kind", "range", "counts", "large", "size").repartition(tasks, "chunk").groupBy("chunk")
    ).applyInArrow(
        score,
        f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)
