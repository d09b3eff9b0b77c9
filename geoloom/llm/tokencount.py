"""Token counts by heap-and-linked-list byte-pair merging.

A text is split into pieces as the vocabulary's own library does (special strings first, then words
with the blank before them, numbers, marks and white space). The bytes of a piece are its initial
symbols, kept in a linked list; a heap holds the adjacent pairs that have a merge, by rank and then
position. The lowest is popped and merged, its neighbours' new pairs are pushed, until the heap is
empty. A piece has as many tokens as initial symbols less merges; identifiers are never listed.
Pieces repeat, so a worker remembers the counts of short ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .bpe import byte_alphabet
from .common import lean

CHUNK_CHARS = 1 << 16  # a long text is split at white space into chunks of about this length
SHORT_PIECE, REMEMBERED = 48, 1 << 19  # a worker remembers up to twice so many pieces of up to so many characters
#: The split pattern of byte-level vocabularies.
PIECES = regex.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: No piece has white space after something else, so texts can be cut there.
GAP = regex.compile(r"(?<=\S)(?=\s)")


def _joined(left: int, right: int) -> int:
    return left << 16 | right


class MergeCounter(dict):
    """Counts the tokens of texts with the merges of a vocabulary file (JSON, byte-level BPE); as a
    dictionary: piece -> its tokens."""

    def __init__(self, path: str):
        super().__init__()
        self._older: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        odd = [t for t in spec.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: added tokens or blanks that change the text around them")
        vocab = model["vocab"]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError(f"{path}: more than 65536 symbols")
        self._bytes = [0] * 256
        for char, byte in byte_alphabet().items():
            self._bytes[byte] = vocab[char]
        self._made: list[int] = []  # by rank, the symbol that a merge makes
        self._rank: dict[int, int] = {}  # left symbol << 16 | right symbol -> rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._rank[vocab[left] << 16 | vocab[right]] = rank
            self._made.append(vocab[left + right])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def tokens(self, piece: bytes) -> int:
        """Initial symbols less merges."""
        n = len(piece)
        symbol = list(map(self._bytes.__getitem__, piece))
        rank, made = self._rank.get, self._made
        bits = n.bit_length()  # a heap entry is the rank and, in the last bits, the position
        heap = [r << bits | i for i, r in enumerate(map(rank, map(_joined, symbol, symbol[1:]))) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, last = 0, (1 << bits) - 1
        while heap:
            top = heappop(heap)
            r, i = top >> bits, top & last
            j = after[i]
            # a pair that has changed since it was pushed has another rank, or none
            if j >= n or symbol[i] < 0 or rank(symbol[i] << 16 | symbol[j]) != r:
                continue
            merges += 1
            here = symbol[i] = made[r]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(here << 16 | symbol[k])
                if r is not None:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0:
                r = rank(symbol[h] << 16 | here)
                if r is not None:
                    heappush(heap, r << bits | h)
        return n - merges

    def __missing__(self, piece: str) -> int:
        count = self._older.get(piece)
        if count is None:
            count = self.tokens(piece.encode())
        if len(piece) <= SHORT_PIECE:
            if len(self) >= REMEMBERED:  # what was met since the last time stays, the rest goes
                self._older = dict(self)
                self.clear()
            self[piece] = count
        return count

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings, by chunks that end at white space."""
        if len(text) <= CHUNK_CHARS:
            return sum(map(self.__getitem__, PIECES.findall(text)))
        count = at = 0
        while at < len(text):
            gap = GAP.search(text, at + CHUNK_CHARS) if at + CHUNK_CHARS < len(text) else None
            to = gap.start() if gap else len(text)
            count += sum(map(self.__getitem__, PIECES.findall(text[at:to])))
            at = to
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        count = at = 0
        for found in self._special.finditer(text):
            count += self._plain(text[at : found.start()]) + 1
            at = found.end()
        return count + self._plain(text[at:])


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, n_bytes, n_tokens, over_limit), one row per input row.

    n_bytes: of the UTF-8 text; n_tokens: of the whole text, as the vocabulary file's own library
    gives them, without begin, end or added tokens; over_limit: n_tokens > limit. Null texts count
    as empty: no bytes, no tokens. Repeated rows and null or repeated ids keep their rows; ids may
    be of any type; ties don't arise. Other columns are not read. An empty table gives an empty
    result. A text is counted in chunks; a worker holds one batch, and for a piece without any
    split its symbols (about 200 bytes for each byte of the piece).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in texthash.slices(batches, "text"):
            text = batch.column("text")
            size = pc.binary_length(text).cast(pa.int64())
            tokens = pa.array([count(t) for t in text.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, tokens], ["id", "n_bytes", "n_tokens"])

    id_type = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(lean(run), f"id {id_type}, n_bytes long, n_tokens long")
    return made.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
