"""Byte-level BPE encoding and decoding, long texts by tree concatenation.

Short texts are encoded whole. A long text is cut into pieces (the leaves of a tree of halves)
that Spark deals out and encodes in parallel; neighbouring encodings are then concatenated up
the tree. Around each join a window of tokens is encoded again and doubled until its encoding
agrees with both sides: it starts and ends at a white-space boundary, where the text splits in
any context, or, in unsplit text, its first and last tokens repeat what the sides have there.
A sequence of BPE tokens is the encoding of its bytes exactly if every two adjacent tokens are,
so tokens in common on both sides of the splice make the whole exact.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import lean, release_memory

LONG_CHARS = 32_768
PIECE_BYTES = 16_384
#: The byte-level split pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BREAKS = b" \n\t\r"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 for itself, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary file (JSON)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self._bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)
        size = max([*ranks.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]

    def encode(self, text: str) -> list[int]:
        """Special tokens' strings become their ids, as in the vocabulary file's own library."""
        if any(s in text for s in self._special):
            return self._bpe.encode(text, allowed_special="all")
        return self._bpe.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")

    def ids_text(self, ids: list[int]) -> str:
        return ",".join([self.decimal[i] for i in ids])

    def concatenate(self, left: list[int], right: list[int], window: int = 32, agree: int = 16) -> list[int]:
        """The encoding of two texts' concatenation, from their encodings."""
        if not left or not right:
            return left + right
        size = window
        while True:
            a, hard_a = self._edge(left[-size - window :], window, last=False)
            a += max(0, len(left) - size - window)
            b, hard_b = self._edge(right[: size + window], size, last=True)
            whole_a, whole_b = a == 0, b == len(right)
            again = self.encode(self.decode(left[a:] + right[:b]))
            fits_a = whole_a or hard_a or again[:agree] == left[a : a + agree] and len(left) - a >= agree
            fits_b = whole_b or hard_b or again[-agree:] == right[b - agree : b] and b >= agree
            if fits_a and fits_b:
                return left[:a] + again + right[b:]
            size *= 2

    def _edge(self, ids: list[int], reach: int, last: bool) -> tuple[int, bool]:
        """An index in `ids` where a window may begin (end, if `last`), and whether the text
        splits there in any context: white space after something else. Else the index is at a
        whole character. Without any, the far end."""
        order = range(reach, len(ids)) if last else range(min(reach, len(ids) - 1), 0, -1)
        soft = None
        for i in order:
            before, after = self.token_bytes[ids[i - 1]], self.token_bytes[ids[i]]
            if after[:1] in (b" ", b"\n", b"\t", b"\r") and before[-1] not in BREAKS and before[-1] < 128:
                return i, True
            if soft is None and (after[0] & 0xC0) != 0x80:
                soft = i
        far = len(ids) if last else 0
        return (far if soft is None else soft), False

    def join_tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            pairs = [self.concatenate(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(parts) - len(parts) % 2 :]
        return parts[0] if parts else []


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _result(of: Codec, ids: list[int]) -> tuple[int, str, str]:
    return (
        len(ids),
        hashlib.sha256(of.ids_text(ids).encode()).hexdigest(),
        hashlib.sha256(of.decode(ids).encode()).hexdigest(),
    )


def _encode_column(docs: DataFrame, vocabulary: str, kept: list[str], result_schema: str, result) -> DataFrame:
    """Replace the last column (text) by what `result` makes of its encoding."""

    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    text = docs.columns[-1]
    fields = [f.split(" ") for f in result_schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(vocabulary)
        for batch in texthash.slices(batches, text):
            out = [result(of, of.encode(t.as_py() or "")) for t in batch.column(len(kept))]
            made = [pa.array([r[i] for r in out], arrow[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), *made], [*kept, *(name for name, _ in fields)]
            )

    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(lean(encode), f"{types}, {result_schema}")


def bpe_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, ids array<int>), one row per input row: the encoding itself, for training files.

    Null texts count as empty and have no ids. Repeated rows and null or repeated ids keep their rows;
    ties don't arise. Other columns are not read. An empty table gives an empty result. A text of any
    length is encoded whole by one task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = _encode_column(rows, vocabulary, ["id"], "ids array<int>", lambda of, ids: (ids,))
    return made.select(F.col("id").alias(id_col), "ids")


def bpe_roundtrip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    ids_sha256: of the decimal ids joined by commas; decoded_sha256: of the decoded text. Null
    texts count as empty: no tokens, and the digest of the empty string. Repeated rows and ids
    keep their rows; ties don't arise. Other columns are not read. An empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    is_long = F.length("text") > LONG_CHARS
    short = _encode_column(rows.where(~is_long), vocabulary, ["id"], schema, _result)

    distinct = rows.where(is_long).groupBy("id", "text").agg(F.count("*").alias("copies"))
    id_type = rows.schema["id"].dataType.simpleString()
    piece_bytes = PIECE_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of about `piece_bytes`, which end before a whole character; one walk over a text."""
        for batch in batches:
            for i in range(batch.num_rows):
                held = memoryview(batch.column("text")[i].as_buffer())
                ends = [0]
                while ends[-1] < len(held):
                    to = min(len(held), ends[-1] + piece_bytes)
                    while to < len(held) and held[to] & 0xC0 == 0x80:
                        to += 1
                    ends.append(to)
                n = len(ends) - 1
                same = lambda c: pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type)  # noqa: B023, E731
                texts = pa.array([str(held[a:b], "utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [same("id"), same("copies"), same("of"), pa.array(range(n), pa.int32()), texts], ["id", "copies", "of", "piece", "text"]
                )

    pieces = distinct.select("id", "copies", F.sha2("text", 256).alias("of"), "text").mapInArrow(
        lean(cut), f"id {id_type}, copies long, of string, piece int, text string"
    )
    pieces = pieces.repartition("of", "piece").select("id", "copies", "of", "piece", "text")
    coded = _encode_column(
        pieces, vocabulary, ["id", "copies", "of", "piece"], "ids binary", lambda of, ids: (np.array(ids, "<i4").tobytes(),)
    )

    def join(table: pa.Table) -> pa.Table:
        of = codec(vocabulary)
        order = np.argsort(table.column("piece").to_numpy())
        blobs = table.column("ids").to_pylist()
        ids = of.join_tree([np.frombuffer(blobs[i], "<i4").tolist() for i in order])
        first = table.slice(0, 1).select(["id", "copies"])
        for name, value in zip(("n_tokens", "ids_sha256", "decoded_sha256"), _result(of, ids), strict=True):
            first = first.append_column(name, pa.array([value]))
        release_memory()
        return first

    long_ = coded.groupBy("id", "of").applyInArrow(join, f"id {id_type}, copies long, {schema}")
    long_ = long_.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(short.columns)
    return short.unionByName(long_).withColumnRenamed("id", id_col)


def ranks_file(path: str) -> dict[bytes, int]:
    """A vocabulary in the other public format: base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
