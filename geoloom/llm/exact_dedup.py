"""Exact deduplication with a cuckoo-filter index over live digests.

Texts are equal when identical after lower-casing A-Z. Every row is reduced to the SHA-256
digest of its folded text. Each task runs its rows through a cuckoo-filter index of its own and
sends one entry per digest, so a group of copies that holds a third of all rows is one entry a
task; the entries meet by digest range, where a second index merges them.

The index answers most lookups from the filter: a miss means that the digest is new. A hit is
verified against the bucketed content (the full digests stored under the bucket); a false
positive is inserted like a new digest. When an insertion finds no free slot the filter is
rebuilt at twice the size from the stored keys. Deletions remove the fingerprint and the stored
key, which is how rows of `withdrawn` texts leave the index.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import lean, materialize, shuffle_partitions, without_rows

SHARD_ROWS = 500_000  # rows of an index that one task merges, on average
MOST_TASKS = 20_000
SLOTS = 4
KICKS = 64


class CuckooIndex:
    """Digest -> value, with a cuckoo filter in front of bucketed keys.

    Fingerprints have 16 bits; a digest's two buckets are i and i ^ hash(fingerprint).
    """

    def __init__(self, buckets: int = 256):
        self._size = 1 << max(1, (buckets - 1).bit_length())
        self._table: list[list[int]] = [[] for _ in range(self._size)]
        self._content: dict[int, dict[bytes, object]] = {}
        self._count = 0
        self.resizes = 0
        self.false_positives = 0

    def __len__(self) -> int:
        return self._count

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        i = int.from_bytes(digest[:8], "little") & (self._size - 1)
        return mark, i, i ^ self._jump(mark)

    def _jump(self, mark: int) -> int:
        return (mark * 0x5BD1E995) & (self._size - 1)

    def _slot_key(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:14], "little")

    def get(self, digest: bytes):
        """The stored value, or None: the filter first, then the bucketed content."""
        mark, i, j = self._place(digest)
        if mark not in self._table[i] and mark not in self._table[j]:
            return None
        value = self._content.get(self._slot_key(digest), {}).get(digest)
        if value is None:
            self.false_positives += 1
        return value

    def put(self, digest: bytes, value) -> None:
        """Insert a digest, or replace the value of one that is there."""
        known = self.get(digest) is not None
        self._content.setdefault(self._slot_key(digest), {})[digest] = value
        if known:
            return
        self._count += 1
        if not self._insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it isn't there."""
        bucket = self._content.get(self._slot_key(digest), {})
        if digest not in bucket:
            return False
        del bucket[digest]
        if not bucket:
            del self._content[self._slot_key(digest)]
        mark, i, j = self._place(digest)
        self._table[i if mark in self._table[i] else j].remove(mark)
        self._count -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self._content.values():
            yield from bucket.items()

    def _insert(self, digest: bytes) -> bool:
        mark, i, j = self._place(digest)
        for at in (i, j):
            if len(self._table[at]) < SLOTS:
                self._table[at].append(mark)
                return True
        at = i
        for kick in range(KICKS):
            row, turn = self._table[at], kick % SLOTS
            mark, row[turn] = row[turn], mark
            at ^= self._jump(mark)
            if len(self._table[at]) < SLOTS:
                self._table[at].append(mark)
                return True
        return False  # the mark in hand is lost: the caller rebuilds from the stored keys

    def _resize(self) -> None:
        while True:
            self._size *= 2
            self.resizes += 1
            self._table = [[] for _ in range(self._size)]
            if all(self._insert(digest) for digest, _ in self.items()):
                return


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest) of every row, in input order; null text counts as empty."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texthash.slices(batches, "text", 4 << 20):
            data, offsets = texthash.buffers(batch.column(1))
            view = memoryview(data)
            out = [
                hashlib.sha256(bytes(view[a:b]).translate(texthash.LOWER)).digest()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "digest"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(lean(digest), f"id {docs.schema['id'].dataType.simpleString()}, digest binary")


def _groups(rows: DataFrame, withdrawn: DataFrame | None) -> DataFrame:
    """(digest, keep_id, group_size) of the live texts."""
    shards = max(4 * shuffle_partitions(rows.sparkSession), math.ceil(rows.count() / SHARD_ROWS))
    id_type = rows.schema["id"].dataType.simpleString()

    def fold(index: CuckooIndex, digest: bytes, keep: object, size: int) -> None:
        old = index.get(digest)
        if old is not None:
            keep, size = max((x for x in (keep, old[0]) if x is not None), default=None), size + old[1]
        index.put(digest, (keep, size))

    def emit(index: CuckooIndex, ids: pa.DataType) -> list[pa.Array]:
        items = list(index.items())
        return [
            pa.array([d for d, _ in items], pa.binary()),
            pa.array([v[0] for _, v in items], ids),
            pa.array([v[1] for _, v in items], pa.int64()),
        ]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One entry for each digest; the index is sent on whenever it holds 200,000."""
        index, ids = CuckooIndex(), pa.null()
        for batch in batches:
            ids = batch.column(0).type
            for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fold(index, d, i, 1)
            if len(index) >= 200_000:
                yield pa.RecordBatch.from_arrays(emit(index, ids), ["digest", "keep_id", "group_size"])
                index = CuckooIndex()
        if len(index):
            yield pa.RecordBatch.from_arrays(emit(index, ids), ["digest", "keep_id", "group_size"])

    def merge(table: pa.Table) -> pa.Table:
        index = CuckooIndex(table.num_rows // 2 + 1)
        gone = []
        for d, keep, size in zip(*(table.column(c).to_pylist() for c in ("digest", "keep_id", "group_size")), strict=True):
            if size:
                fold(index, d, keep, size)
            else:
                gone.append(d)
        for d in gone:
            index.delete(d)
        return pa.table(emit(index, table.column("keep_id").type), ["digest", "keep_id", "group_size"])

    entries = rows.mapInArrow(lean(combine), f"digest binary, keep_id {id_type}, group_size long")
    if withdrawn is not None:
        entries = entries.unionByName(
            withdrawn.select("digest", F.lit(None).cast(id_type).alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
        )
    shard = F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long") % shards
    dealt = entries.withColumn("shard", shard).repartition(min(shards, MOST_TASKS), "shard")
    return dealt.groupBy("shard").applyInArrow(merge, f"digest binary, keep_id {id_type}, group_size long")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", withdrawn: DataFrame | None = None
) -> DataFrame:
    """(<id_col>, keep_id, group_size, kept, text_sha256), one row per input row.

    Of equal texts the row with the largest id stays; ids may be of any type that has an order. Null, like empty, texts equal each other.
    Rows with a null id stay only if no row of the group has an id (keep_id is then null and
    each of them is kept). Rows that repeat both text and the largest id are all kept = true:
    they are the same row to this operator. Other columns are not read. `withdrawn` (the same
    two columns) deletes its texts from the index: rows with such a text get keep_id null,
    group_size 0 and kept false. An empty table gives an empty result.
    """
    rows = materialize(_digests(docs, id_col, text_col))  # the texts are read and hashed once
    gone = None if withdrawn is None else _digests(withdrawn, id_col, text_col).select("digest").distinct()
    groups = _groups(rows, gone)
    return rows.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("group_size", F.lit(0)).cast("long").alias("group_size"),
        (F.col("group_size").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_last_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts: that of the largest id, with all of its columns.

    A row is told by id and text: rows that share their id, null or not, with a row that goes stay
    if their own text does. Of rows that repeat both the largest id and the text, or of a group
    without any id, one stays. Null and empty texts are equal. An empty table stays empty.
    """
    rows = materialize(exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"), "kept"))
    drop = rows.where("not kept").select("id", "key").distinct()
    twice = rows.where("kept").groupBy("id", "key").count().where("count > 1").select("id", "key")
    lower = F.translate(F.coalesce(docs[text_col], F.lit("")), string.ascii_uppercase, string.ascii_lowercase)  # as the digests
    return without_rows(docs, id_col, F.sha2(lower, 256), drop, materialize(twice))
