"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles ("tokens", 64-bit hashes). Two documents
link when ``100 * |A and B| >= percent * |A or B|``. The join finds all components of that
graph without comparing all pairs:

1. *Frequencies.* Each task sends its distinct tokens with counts, packed in sorted blobs by
   hash range; a token that a third of all rows hold is one entry per blob. Tokens in at least
   `frequent` documents are the frequent ones, in classes by powers of two. `frequent` is doubled
   until there are at most `max_frequent` of them, so what is broadcast is bounded.
2. *Signatures.* With the global order (class, hash), rare tokens first, a document takes the
   shortest prefix that survives the loss of any ``n - ceil(n * percent / 100)`` tokens. Rare
   tokens are signatures by themselves. Frequent tokens are dealt by hash into G cells (G grows
   with the size class of the document) and count only in combinations of k = 2 of one cell; the
   prefix is extended until enough combinations are certain to survive. Two linked documents
   always share a signature, at the size class of the larger one.
3. *Stars.* In each signature's posting list every document is compared with the least unusual
   one (fewest rare tokens: the original among edited copies), which gives a linear number of
   pairs. Lists of rare tokens are bounded by `frequent`, and fall apart where sizes are too far
   apart to link; lists of combinations are never gathered, but joined with their hub.
4. *Rest.* What a list has left across components is compared exhaustively, except for pairs
   that the counts of their rare tokens and of the hub's tokens they lack rule out (see
   `_open_pairs`). No link is lost and no list is cut.

Exact copies (equal sets) are folded into one node before any of this.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import (
    broadcast_if_small,
    connected_components,
    discard,
    lean,
    lean_group,
    materialize,
    shuffle_partitions,
    without_rows,
)

FLUSH = 500_000  # tokens that a task packs at once
NODE_BITS = np.uint64(2**56 - 1)
PART_BYTES = 4 << 20  # text whose keys make one range
MOST_TASKS = 20_000
RECENT = 1 << 14  # sets that a task remembers, so as to pass over their copies


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as the first one and the steps between them in Rice code: the low bits of
    each step, about as many as the mean step has, as whole bytes and then the bits left of a byte;
    what is above them in unary. At most three bits a value come on top of the low ones."""
    if not len(values):
        return b""
    steps = np.diff(values)
    low = max((int(values[-1] - values[0]) // len(steps)).bit_length() - 1, 0) if len(steps) else 0
    head = bytes([low]) + int(values[0]).to_bytes(8, "little") + len(values).to_bytes(8, "little")
    if not len(steps):
        return head
    whole, left = divmod(low, 8)
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    stops = np.cumsum((steps >> np.uint64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(stops[-1] + 1, bool)
    unary[stops] = True
    rest = np.unpackbits(body[:, whole : whole + 1], axis=1)[:, 8 - left :] if left else body[:, :0]
    return head + body[:, :whole].tobytes() + np.packbits(rest).tobytes() + np.packbits(unary).tobytes()


def _unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    low, first, n = blob[0], int.from_bytes(blob[1:9], "little"), int.from_bytes(blob[9:17], "little")
    out = np.full(n, first, np.uint64)
    if n == 1:
        return out
    whole, left = divmod(low, 8)
    held = np.frombuffer(blob, np.uint8, offset=17)
    ends = np.cumsum([(n - 1) * whole, ((n - 1) * left + 7) // 8])
    steps = np.zeros((n - 1, 8), np.uint8)
    steps[:, :whole] = held[: ends[0]].reshape(n - 1, whole)
    if left:
        bits = np.unpackbits(held[ends[0] : ends[1]], count=(n - 1) * left).reshape(n - 1, left)
        steps[:, whole] = np.packbits(bits, axis=1).ravel() >> (8 - left)
    above = np.diff(np.flatnonzero(np.unpackbits(held[ends[1] :])), prepend=-1) - 1
    out[1:] = steps.view("<u8").ravel() + (above.astype(np.uint64) << np.uint64(low))
    return np.cumsum(out, dtype=np.uint64)


def _by_range(keys: np.ndarray, parts: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, stop) of the ranges that sorted keys of so many bits are in, of `parts` (under
    2**31) equal ones. The work grows with the keys, not with the ranges."""
    if len(keys):
        of = (keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        yield from zip(of[start].tolist(), start.tolist(), [*start[1:].tolist(), len(keys)], strict=True)


def _tasks(parts: int) -> int:
    """As many tasks as ranges, while a driver can follow so many."""
    return min(parts, MOST_TASKS)


def _parts(docs: DataFrame) -> int:
    """Ranges of keys, so that one has what some MB of text hold, however large the corpus is."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * shuffle_partitions(docs.sparkSession), math.ceil(size / PART_BYTES))


def _frequencies(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """(bucket, keys, counts): tokens' upper 48 bits with the number of documents holding them."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
        rows = []
        for p, a, b in _by_range(keys, parts, 48):
            k, c = keys[a:b], counts[a:b]
            many = c > 1
            rows.append((p, _pack_sorted(k[~many]), _pack_sorted(k[many]), c[many].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            ["bucket", "once", "keys", "counts"],
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in texthash.slices(batches, "text"):
            tokens, _ = texthash.shingle_sets(batch.column(0), words)
            if len(tokens):
                held.append(tokens)
                size += len(tokens)
            if size >= FLUSH:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return docs.select("text").mapInArrow(lean(partial), "bucket int, once binary, keys binary, counts binary")


def _frequent_tokens(docs: DataFrame, words: int, frequent: int, max_frequent: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 48-bit keys of the frequent tokens and their class, the power of two of their number
    of documents, from 1; at most `max_frequent`."""
    floor = frequent

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for once, many, held in zip(*(table.column(c).to_pylist() for c in ("once", "keys", "counts")), strict=True):
            keys += [one := _unpack_sorted(once), _unpack_sorted(many)]
            counts += [np.ones(len(one), np.int64), np.frombuffer(held, "<u4").astype(np.int64)]
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, head) if len(key) else count
        key = key[head]
        keep = total >= floor
        power = np.floor(np.log2(np.maximum(total[keep], 1))).astype(np.int64)
        out = [(int(p), int((power == p).sum()), _pack_sorted(key[keep][power == p])) for p in np.unique(power)]
        return pa.table(
            {
                "power": pa.array([r[0] for r in out], pa.int32()),
                "n": pa.array([r[1] for r in out], pa.int64()),
                "keys": pa.array([r[2] for r in out], pa.binary()),
            }
        )

    found = materialize(
        _frequencies(docs, words, parts).repartition(_tasks(parts), "bucket").groupBy("bucket").applyInArrow(lean_group(merge), "power int, n long, keys binary")
    )
    sizes = {r["power"]: r["n"] for r in found.groupBy("power").agg(F.sum("n").alias("n")).collect()}
    first = next(p for p in range(64) if 2**p >= frequent)
    while sum(n for p, n in sizes.items() if p >= first) > max_frequent:
        first += 1
    keys, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for row in found.where(F.col("power") >= first).select("power", "keys").toLocalIterator():
        keys.append(_unpack_sorted(row["keys"]))
        classes.append(np.full(len(keys[-1]), 1 + row["power"] - first, np.uint8))
    key, kind = np.concatenate(keys), np.concatenate(classes)
    order = np.argsort(key)
    return key[order], kind[order]


class _Classes:
    """Looks tokens up among the frequent ones: a bitmap first, then a binary search."""

    def __init__(self, keys: np.ndarray, kinds: np.ndarray):
        self.keys, self.kinds = keys, kinds
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint8)
        if len(self.keys):
            key = tokens >> np.uint64(16)
            maybe = np.flatnonzero(self.bitmap[(key & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == key[maybe]
            out[maybe[hit]] = self.kinds[at[hit]]
        return out


def nodes_of(
    tokens: np.ndarray, offsets: np.ndarray, classes: np.ndarray, clashes: frozenset[int] = frozenset()
) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit id of each set, 7 bits of unusualness (share of rare tokens) and 56 of fingerprint,
    and a second fingerprint of 64 bits. Ids that `clashes` names stand for several sets; there the
    second fingerprint gives the id."""
    n = np.diff(offsets)
    sums = lambda x: np.r_[x.dtype.type(0), np.cumsum(x, dtype=x.dtype)]
    of = lambda total: total[offsets[1:]] - total[offsets[:-1]]
    print_ = texthash.mix(of(sums(texthash.mix(tokens, 3))) + n.astype(np.uint64), 5) & NODE_BITS
    second = texthash.mix(of(sums(texthash.mix(tokens, 61))) + n.astype(np.uint64), 67)
    share = (127 * of(sums((classes == 0).astype(np.int64))) // np.maximum(n, 1)).astype(np.uint64) << np.uint64(56)
    node = share | print_
    if clashes:
        again = np.isin(node, np.fromiter(clashes, np.uint64, len(clashes)))
        node = np.where(again, share | (texthash.mix(second, 71) & NODE_BITS), node)
    return node.astype(np.int64), second.view(np.int64)


class _Fresh:
    """Which sets a task hasn't met lately: a table of fixed size, so a set may come up again after
    others took its place (copies are merged for good after the shuffle)."""

    def __init__(self):
        self._slots = np.full(RECENT, -1, np.int64)

    def of(self, nodes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions of non-empty sets that are new, each set once."""
        _, first = np.unique(nodes, return_index=True)
        first = np.sort(first)
        first = first[np.diff(offsets)[first] > 0]
        slot = nodes[first] & (RECENT - 1)
        new = self._slots[slot] != nodes[first]
        self._slots[slot] = nodes[first]
        return first[new]


def required(n: int, percent: int) -> int:
    """Signatures that must be in the prefix: one more than the tokens a linked set may lack."""
    return n - (percent * n + 99) // 100 + 1


def signatures(tokens: np.ndarray, classes: np.ndarray, percent: int, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(rare tokens, combinations) that one document, a sorted set of tokens, is indexed by."""
    n = len(tokens)
    need = required(n, percent)
    rare = tokens[classes == 0]
    if len(rare) >= need:
        return rare[:need], tokens[:0]
    left = need - len(rare)
    frequent = tokens[classes > 0]
    frequent = frequent[np.argsort(classes[classes > 0], kind="stable")]  # the less frequent first, then by hash
    level = n.bit_length() - 1 if n >= 16 else 0
    following = level + 1 if level else 4
    combos = []
    if not level:  # tiny sets: by themselves
        combos.append(texthash.mix(frequent[:left], 11))
    for at in (level, following):
        if at == 0 or (at == following and 100 * n < percent * 2**following):
            continue  # a linked set can't be of the next size class
        cell = (texthash.mix(frequent, 21) % np.uint64(2**at // 8)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        sorted_cells = cell[order]
        head = np.flatnonzero(np.r_[True, sorted_cells[1:] != sorted_cells[:-1]])
        run = np.empty(len(frequent), np.int64)
        run[order] = np.arange(len(frequent)) - np.repeat(head, np.diff(np.r_[head, len(frequent)]))
        # a token counts once its cell has k; sets of 16 tokens or more always have enough
        stop = int(np.searchsorted(np.cumsum(run >= k - 1), left)) + 1
        chosen, of = frequent[:stop], cell[:stop]
        salt = np.uint64(at * 8 + k)
        for c in np.unique(of):
            members = np.sort(chosen[of == c])
            if len(members) >= k:
                acc = None
                for row in np.array(list(combinations(range(len(members)), k))).T:
                    acc = texthash.mix((salt if acc is None else acc) + members[row], 31)
                combos.append(acc)
    return rare, np.concatenate(combos) if combos else tokens[:0]


def _postings(docs: DataFrame, words: int, percent: int, classes, clashes: frozenset[int], parts: int) -> DataFrame:
    """(sig, node, n, hub, hub_n, r, hub_r) of every signature that two different sets share. n: the
    set's size; r: its rare tokens, in lists of combinations; -1 in lists of a rare token."""

    def send(sigs: list[np.ndarray], nodes: list[int], sizes: list[int], combos: bool) -> pa.RecordBatch:
        each = [len(x) for x in sigs]
        sig, node, n = np.concatenate(sigs), np.repeat(nodes, each), np.repeat(sizes, each)
        order = np.argsort(sig)
        sig, node, n = sig[order], node[order], n[order]
        cut = [(-1, 0, len(sig))] if combos else _by_range(sig, parts, 64)
        rows = [(p, _pack_sorted(sig[a:b]), node[a:b].tobytes(), n[a:b].tobytes()) for p, a, b in cut]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            ["bucket", "sigs", "nodes", "sizes"],
        )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, fresh = _Classes(*classes.value), _Fresh()
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in texthash.slices(batches, "text"):
            tokens, offsets = texthash.shingle_sets(batch.column(0), words)
            kinds = lookup.of(tokens)
            nodes, _ = nodes_of(tokens, offsets, kinds, clashes)
            for i in fresh.of(nodes, offsets):
                node, a, b = int(nodes[i]), offsets[i], offsets[i + 1]
                rare = int((kinds[a:b] == 0).sum())
                for combos, sigs in zip((False, True), signatures(tokens[a:b], kinds[a:b], percent), strict=True):
                    if len(sigs):
                        held[combos].append((sigs, node, (int(b - a) << 32) + rare))
                        size[combos] += len(sigs)
            for combos in (False, True):
                if size[combos] >= FLUSH:
                    yield send(*zip(*held[combos], strict=True), combos)
                    held[combos], size[combos] = [], 0
        for combos in (False, True):
            if held[combos]:
                yield send(*zip(*held[combos], strict=True), combos)

    def unpack(sigs: bytes, nodes: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _unpack_sorted(sigs), np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64)

    def shared(table: pa.Table) -> pa.Table:
        """Lists of rare tokens: each is shorter than the frequent bound. Where two sizes in a row
        are too far apart to link, the list falls into independent ones."""
        got = [unpack(*r) for r in zip(*(table.column(c).to_pylist() for c in ("sigs", "nodes", "sizes")), strict=True)]
        sig, node, n = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((node, sig))
        sig, node, n = sig[order], node[order], n[order]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node, n = sig[fresh], node[fresh], n[fresh] >> 32
        order = np.lexsort((n, sig))
        sig, node, n = sig[order], node[order], n[order]
        split = np.r_[True, (sig[1:] != sig[:-1]) | (100 * n[:-1] < percent * n[1:])]
        part = np.cumsum(split)
        sig = texthash.mix(sig + (part - part[np.searchsorted(sig, sig)]).astype(np.uint64), 51)
        order = np.lexsort((node, part))
        sig, node, n, part = sig[order], node[order], n[order].astype(np.int32), part[order]
        head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        length = np.diff(np.r_[head, len(sig)])
        keep, hub = np.repeat(length > 1, length), np.repeat(head, length)
        return pa.table(
            {
                "sig": sig[keep].view(np.int64),
                "node": node[keep],
                "n": n[keep],
                "hub": node[hub[keep]],
                "hub_n": n[hub[keep]],
                "r": np.full(int(keep.sum()), -1, np.int32),
                "hub_r": np.full(int(keep.sum()), -1, np.int32),
            }
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("sigs", "nodes", "sizes")), strict=True):
                sig, node, n = unpack(*r)
                columns = (sig.view(np.int64), node, (n >> 32).astype(np.int32), (n & 0xFFFFFFFF).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "n", "r"])

    packed = materialize(docs.select("text").mapInArrow(lean(index), "bucket int, sigs binary, nodes binary, sizes binary"))
    schema = "sig long, node long, n int, hub long, hub_n int, r int, hub_r int"
    rare = packed.where("bucket >= 0").repartition(_tasks(parts), "bucket").groupBy("bucket").applyInArrow(lean_group(shared), schema)
    combos = packed.where("bucket < 0").mapInArrow(lean(rows), "sig long, node long, n int, r int")
    hubs = combos.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    sizes = combos.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("r").alias("hub_r")).distinct()
    lists = combos.distinct().join(hubs.select("sig", "hub"), "sig").join(sizes, "hub").select("sig", "node", "n", "hub", "hub_n", "r", "hub_r")
    shared_ = materialize(rare.unionByName(lists))
    discard(packed)
    return shared_


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the size of their sets' intersection and whether they link."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked = [], []
            for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
                p, q = _unpack_sorted(x), _unpack_sorted(y)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both.append(int((q[at] == p).sum()))
                linked.append(100 * both[-1] >= percent * (len(p) + len(q) - both[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int32()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"]
            )

    side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_set"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    return materialize(joined.mapInArrow(lean(count), "a long, b long, both int, linked boolean"))


def _open_pairs(postings: DataFrame, roots: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that a signature's list leaves to be compared.

    In a list of a rare token: all of them; the list is shorter than the frequent bound. In a list
    of combinations, let h be its hub, r a document's rare tokens and lost = |h - x|. Two of its
    documents that share a rare token meet in that token's list. If they share none, their rare
    tokens are r_x + r_y of their symmetric difference, and its frequent ones are at least the
    difference in the frequent tokens of h that they lack. Of d = lost_x - lost_y >= 0, up to
    min(r_h, r_y) may be rare tokens of h that y has and x has not, which r_y has counted already.
    So the difference is at least r_x + r_y + max(0, d - min(r_h, r_y)), and pairs for which that
    is too much to link aren't made. What the far one of a pair (x) would need of the near one is
    first held against the list's extremes, so that documents which can't link to anybody (the
    bulk of what edits have torn from a large group) don't enter the join at all.
    """
    fits = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)
    pair = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    apart = lambda p, q: F.floor((100 - percent) * (p + q) / (100 + percent))
    spread = postings.join(broadcast_if_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = spread.groupBy("sig", "root").agg(F.count("*").alias("m"))
    lists = by.groupBy("sig").agg(F.max(F.struct("m", "root")).alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    lists = materialize(lists.where("lo <> hi").select("sig", F.col("most.root").alias("most")))
    if lists.isEmpty():
        return postings.select(F.col("node").alias("a"), F.col("hub").alias("b")).limit(0)
    spread = materialize(spread.join(broadcast_if_small(lists), "sig"))
    keep = ["sig", "node", "n", "root", "r"]
    side = lambda df: df.select("sig", *(F.col(c).alias(f"x_{c}") for c in df.columns if c != "sig"))

    rare = spread.where("r < 0").select(*keep, "most")
    met = rare.drop("most").join(side(rare.where("root <> most").select(keep)), "sig")
    met = met.where((F.col("root") != F.col("x_root")) & fits(F.col("n"), F.col("x_n"))).select(*pair(F.col("node"), F.col("x_node")))

    known = stars.select("a", "b", "both")
    combos = spread.where("r >= 0").withColumn("a", F.least("node", "hub")).withColumn("b", F.greatest("node", "hub")).join(known, ["a", "b"], "left")
    lost = F.when(F.col("node") == F.col("hub"), 0).otherwise(F.col("hub_n") - F.col("both"))
    # lists of one hub hold much the same documents: together they make each pair once
    entries = combos.select("hub", "hub_r", *keep[1:], lost.alias("lost")).distinct()
    by_hub = entries.groupBy("hub", "root").agg(F.count("*").alias("m"))
    most = by_hub.groupBy("hub").agg(F.max(F.struct("m", "root")).alias("most")).select("hub", F.col("most.root").alias("most"))
    entries = materialize(entries.join(most, "hub"))
    far = 2**30
    extremes = entries.groupBy("hub").agg(
        F.max(F.coalesce(F.col("lost") - F.greatest(F.col("r") - F.col("hub_r"), F.lit(0)), F.lit(far))).alias("spare"),
        F.max("n").alias("top"),
        F.max(F.when(F.col("root") == F.col("most"), F.coalesce("lost", F.lit(far)))).alias("reach"),
    )
    minor = entries.where("root <> most").join(extremes, "hub")
    possible = (
        F.col("lost").isNull()
        | (F.col("spare") >= F.col("lost") + F.col("r") - apart(F.col("n"), F.col("top")))
        | (F.col("lost") <= F.col("reach"))
    )
    minor = minor.where(possible).select("hub", *(F.col(c).alias(f"x_{c}") for c in (*keep[1:], "lost")))
    minor = materialize(minor)
    cross = entries.drop("most").join(broadcast_if_small(minor), "hub")
    near_r = F.when(F.col("lost") < F.col("x_lost"), F.col("r")).otherwise(F.col("x_r"))
    more = F.abs(F.col("lost") - F.col("x_lost")) - F.least("hub_r", near_r)
    least = F.col("r") + F.col("x_r") + F.greatest(F.coalesce(more, F.lit(0)), F.lit(0))
    cross = cross.where(
        (F.col("root") != F.col("x_root")) & fits(F.col("n"), F.col("x_n")) & (least <= apart(F.col("n"), F.col("x_n")))
    ).select(*pair(F.col("node"), F.col("x_node")))
    return met.unionByName(cross).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 5,
    percent: int = 80,
    frequent: int = 16,
    max_frequent: int = 1 << 20,
) -> DataFrame:
    """Components of near-copies: (<id_col>, n_shingles long, component_id).

    One row per input row, other columns are not read (so clashing names are harmless). Words
    are compared after lower-casing A-Z. A text with fewer than `words` words is one shingle of
    all its words; null, empty and blank texts have no shingle and link with nothing
    (component_id is then the row's own id). component_id is the smallest id in the component;
    a row with a null id gets the component's smallest id, or null. Equal rows and repeated ids
    are kept, each as its own row. An empty table gives an empty result.

    percent: the least Jaccard similarity in hundredths. Sets are told apart by 63 bits, held
    against a second fingerprint of 64; shingles have 64 bits in the index and 48 in the final
    comparison, so an error there needs a hash collision inside a pair.
    """
    named, labels = _components(docs, id_col, text_col, words, percent, frequent, max_frequent)
    return named.join(labels, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def _components(
    docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, frequent: int, max_frequent: int
) -> tuple[DataFrame, DataFrame]:
    """(id, n, node, key) of every row, key being the SHA-256 of its text, and (node, component_id,
    component_key): the least (id, key) of the component, null ids last."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = _parts(docs)
    classes = spark.sparkContext.broadcast(_frequent_tokens(docs, words, frequent, max_frequent, parts))

    id_type = docs.schema["id"].dataType.simpleString()

    def named_by(clashes: frozenset[int]) -> DataFrame:
        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = _Classes(*classes.value)
            for batch in texthash.slices(batches, "text"):
                tokens, offsets = texthash.shingle_sets(batch.column("text"), words)
                node, second = nodes_of(tokens, offsets, lookup.of(tokens), clashes)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n), pa.array(node, mask=n == 0), pa.array(second), batch.column("key")],
                    ["id", "n", "node", "second", "key"],
                )

        keyed = docs.withColumn("key", text_key("text"))
        return materialize(keyed.mapInArrow(lean(name), f"id {id_type}, n long, node long, second long, key binary"))

    named = named_by(frozenset())
    # ids that stand for two sets: none are expected below 10^8 sets, a handful at 10^9; they are made anew
    twins = named.groupBy("node").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi and node is not null")
    clashes = frozenset(r["node"] for r in twins.select("node").collect())
    if clashes:
        named = named_by(clashes)
    postings = _postings(docs, words, percent, classes, clashes, parts)

    wanted = materialize(postings.select("node").distinct())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, fresh = _Classes(*classes.value), _Fresh()
        for batch in texthash.slices(batches, "text"):
            tokens, offsets = texthash.shingle_sets(batch.column(0), words)
            node, _ = nodes_of(tokens, offsets, lookup.of(tokens), clashes)
            at = fresh.of(node, offsets)
            blobs = [_pack_sorted(np.unique(tokens[offsets[i] : offsets[i + 1]] >> np.uint64(16))) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(node[at], pa.int64()), pa.array(blobs, pa.binary())], ["node", "tokens"])

    sets = docs.select("text").mapInArrow(lean(sets_of), "node long, tokens binary")
    sets = materialize(sets.join(broadcast_if_small(wanted), "node", "left_semi").dropDuplicates(["node"]))

    fits = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)
    pair = (F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    stars = (
        postings.where((F.col("node") != F.col("hub")) & fits(F.col("n"), F.col("hub_n")))
        .select(*pair)
        .distinct()
    )
    stars = _overlaps(stars, sets, percent)
    links = stars.where("linked").select("a", "b")
    roots = materialize(connected_components(links))
    more = _overlaps(_open_pairs(postings, roots, stars, percent), sets, percent).where("linked").select("a", "b")
    if not more.isEmpty():
        roots = materialize(connected_components(links.unionByName(more)))
    least = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    folded = named.where("node is not null").groupBy("node").agg(F.min(least).alias("first"))
    labels = folded.join(broadcast_if_small(roots), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = labels.groupBy("root").agg(F.min("first").alias("first"))
    labels = labels.select("node", "root").join(smallest, "root")
    return named, labels.select("node", F.col("first.id").alias("component_id"), F.col("first.key").alias("component_key"))


def text_key(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def keep_representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 5,
    percent: int = 80,
    frequent: int = 16,
    max_frequent: int = 1 << 20,
) -> DataFrame:
    """One row of each component of near-copies: that of the smallest id, with all its columns.

    A row is told by id and text: rows that share their id, null or not, with a row that goes stay
    if they are in another component. Of a component's rows with the smallest id the one with the
    smallest SHA-256 of its text stays; of rows that repeat both, one; ids come before null. Rows
    without words link with nothing and all stay. An empty table stays empty.
    """
    named, labels = _components(docs, id_col, text_col, words, percent, frequent, max_frequent)
    rows = named.where("node is not null").join(labels, "node")
    first = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    rows = materialize(rows.select("id", "key", first.alias("first")))
    drop = rows.where("not first").select("id", "key").distinct()
    twice = rows.where("first").groupBy("id", "key").count().where("count > 1").select("id", "key")
    return without_rows(docs, id_col, text_key(text_col), drop, materialize(twice))
