"""Vectorised word and shingle hashing over Arrow string columns (numpy, no per-word Python).

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased. A word's
64-bit hash is a polynomial over random per-byte values modulo 2**64, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20  # bytes hashed at once; bounds memory, never cuts a word

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
LOWER = bytes(_FOLD)
_RANDOM = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RANDOM[_FOLD]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, WINDOW + (WINDOW >> 2))
        _POWERS[:] = [
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, p, dtype=np.uint64)])
            for p in (_P, _P_INV)
        ]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets if len(offsets) else np.zeros(1, np.int64)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text (or one row): bounds what
    hashing a batch takes."""
    for batch in batches:
        _, offsets = buffers(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _window(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of `data`, where texts begin at `starts`; words per text."""
    n = len(data)
    space = _SPACE[data]
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1]
    first = starts[(starts < n) & (starts < ends)]
    begin[first] = word[first]
    end = word.copy()
    end[:-1] &= space[1:]
    last = ends[ends > starts] - 1
    end[last] = word[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashes = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
    return hashes, np.searchsorted(s, ends) - np.searchsorted(s, starts)


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, in order, and the number of words of each text."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    hashes, counts, i = [np.zeros(0, np.uint64)], np.zeros(n, np.int64), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WINDOW, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= WINDOW or j > i + 1:
            got, each = _window(data[lo:hi], offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo)
            hashes.append(got)
            counts[i:j] = each
        else:  # one very long text: windows that end at white space
            at = lo
            while at < hi:
                to = min(hi, at + WINDOW)
                if to < hi:
                    gap = np.flatnonzero(_SPACE[data[at:to]])
                    if len(gap):
                        to = at + int(gap[-1]) + 1
                    else:
                        while to < hi and not _SPACE[data[to]]:
                            more = np.flatnonzero(_SPACE[data[to : min(hi, to + WINDOW)]])
                            to = to + int(more[0]) if len(more) else min(hi, to + WINDOW)
                got, each = _window(data[at:to], np.array([0]), np.array([to - at]))
                hashes.append(got)
                counts[i] += int(each[0])
                at = to
        i = j
    return np.concatenate(hashes), counts


def shingle_sets(column: pa.Array | pa.ChunkedArray, words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct `words`-word shingles as sorted 64-bit hashes, one text after the
    other, and the n + 1 offsets. Fewer words: the whole sequence is the one shingle; no words:
    the set is empty."""
    w, counts = word_hashes(column)
    stop = np.cumsum(counts)
    start = stop - counts
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    out = np.empty(int(offsets[-1]), np.uint64)
    if len(w) >= words:
        total = len(w) - words + 1
        acc = np.zeros(total, np.uint64)
        for k in range(words):
            acc = mix(acc + w[k : k + total], k)
        inside = np.zeros(total, bool)
        full = counts >= words
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, start[full], 1)
        np.add.at(edge, stop[full] - words + 1, -1)
        inside[:] = np.cumsum(edge)[:total] > 0
        place = np.repeat(full, sizes)
        out[place] = acc[inside]
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        h = np.array([counts[i]], np.uint64)
        for k in range(int(counts[i])):
            h = mix(h + w[start[i] + k : start[i] + k + 1], 100 + k)
        out[offsets[i]] = h[0]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out[a:b].sort()
    if len(out):
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        heads = offsets[:-1][sizes > 0]
        keep[heads] = True
        kept = np.r_[0, np.cumsum(keep)]
        offsets = kept[offsets]
        out = out[keep]
    return out, offsets
