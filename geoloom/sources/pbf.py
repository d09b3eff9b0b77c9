"""A data source for map extracts in the block format (.osm.pbf): format("osmpbf").

One partition reads the blobs that begin in one range of bytes of one file, or in several where ranges
are many and small; the driver only lists files and sizes. A range finds its first blob by the mark of a header, held against the next header.
Blocks are decoded where they are read. Files may lie in any store that Arrow's file systems reach. Rows:
(kind, id, lat, lon, tags, refs, members), kind being node, way or relation. Way references are
node ids, members are (id, type, role).
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from geoloom.sources.stores import store_of, write_file

SCHEMA = (
    "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, "
    "members array<struct<id:bigint,type:int,role:string>>"
)
MEMBER = pa.struct([("id", pa.int64()), ("type", pa.int32()), ("role", pa.string())])
ARROW = pa.schema(
    [("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("members", pa.list_(MEMBER))]
)
MAX_HEADER = 65_536
PARTITIONS, SHARE = 64, 8 << 20  # a scan of more partitions gives each SHARE bytes at least
RANGE_BYTES = 32 << 20
MARK = b"\x0a\x07OSMData"  # how a data blob's header begins, after its length


def varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; values are ints or bytes."""
    at, end = 0, len(buf)
    while at < end:
        key, at = (buf[at], at + 1) if buf[at] < 0x80 else varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(buf, at)
        elif kind == 2:
            n, at = (buf[at], at + 1) if buf[at] < 0x80 else varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif kind == 5:
            value, at = buf[at : at + 4], at + 4
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        else:
            raise ValueError(f"field kind {kind}")
        yield key >> 3, value


def unpacked(parts: list[bytes], zigzag: bool = False, delta: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed fields, those of all fields one after the other, and where each field's begin."""
    if any(p and p[-1] > 0x7F for p in parts):
        raise ValueError("a packed field ends inside a number")
    buf = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.flatnonzero(buf < 0x80)
    size = np.diff(ends, prepend=-1)
    value = np.zeros(len(ends), np.uint64)
    for k in range(min(10, int(size.max(initial=0)))):
        longer = np.flatnonzero(size > k)
        value[longer] |= (buf[ends[longer] - size[longer] + 1 + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    one = np.uint64(1)
    out = (value >> one).astype(np.int64) ^ -(value & one).astype(np.int64) if zigzag else value.astype(np.int64)
    starts = np.searchsorted(ends, np.cumsum([0, *map(len, parts)]))
    if delta:
        total = np.cumsum(out)
        out = total - np.repeat(np.r_[0, total][starts[:-1]], np.diff(starts))
    return out, starts


def header_at(f: pafs.FileSystem, at: int, size: int) -> tuple[bytes, int, int] | None:
    """(type, offset of the blob's message, its length) of the header at a place, or None at the end."""
    if at >= size:
        return None
    n = struct.unpack(">I", f.read_at(4, at))[0]
    if n > MAX_HEADER:
        raise ValueError(f"a header of {n} bytes at {at}")
    head = dict(fields(f.read_at(n, at + 4)))
    if head.get(1) not in (b"OSMData", b"OSMHeader"):
        raise ValueError(f"unknown blob {head.get(1)!r} at {at}")
    return head[1], at + 4 + n, int(head[3])


def first_blob(f: pafs.FileSystem, start: int, stop: int, size: int) -> int | None:
    """Where the first data blob that begins in start .. stop begins. The mark may stand in a blob's
    content by chance: a place counts if its header is whole and another, or the end, follows its blob."""
    if start == 0:
        return 0
    window, at = 1 << 20, start
    while at < stop:
        held = f.read_at(min(window, stop - at) + 4 + len(MARK), at)
        found = held.find(MARK, 4)
        while found >= 0 and at + found - 4 < stop:
            try:
                _, offset, length = header_at(f, at + found - 4, size)
                if offset + length <= size:
                    header_at(f, offset + length, size)
                    return at + found - 4
            except (ValueError, IndexError, KeyError, struct.error):
                pass
            found = held.find(MARK, found + 1)
        at += window
    return None


def blob_ranges(f: pafs.FileSystem, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each data blob whose header begins in start .. stop."""
    size = f.size()
    at = first_blob(f, start, stop, size)
    while at is not None and at < stop and (head := header_at(f, at, size)):
        kind, offset, length = head
        if kind == b"OSMData":
            yield offset, length
        at = offset + length


def blob_content(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    return zlib.decompress(parts[3])


#: fixed values: an element's kind by its field in a group (the second is that of dense nodes)
KIND_FIELDS = {1: "node", 2: "node", 3: "way", 4: "relation"}


def block_batches(block: bytes, kinds: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The elements of a decoded block, or those of some kinds; nothing of the others is decoded. The
    packed fields of all elements of a group are decoded at once."""
    texts: list[str] = []
    groups, granularity, lat0, lon0 = [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            texts = [s.decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 19:
            lat0 = v if v < 2**63 else v - 2**64
        elif k == 20:
            lon0 = v if v < 2**63 else v - 2**64
    strings = Strings(texts)
    degrees = lambda v, offset: (granularity * np.asarray(v, np.int64) + offset) * 1e-9
    for group in groups:
        held: dict[int, list[dict]] = {k: [] for k in KIND_FIELDS}
        for kind, message in fields(group):
            if kind in held and (kinds is None or KIND_FIELDS[kind] in kinds):
                held[kind].append(_gathered(message))
        if held[1]:
            lats, lons = ([signed(m[k]) for m in held[1]] for k in (8, 9))
            yield strings.batch("node", [signed(m[1]) for m in held[1]], *strings.tags(held[1]), lat=degrees(lats, lat0), lon=degrees(lons, lon0))
        for m in held[2]:
            ids, lats, lons = (unpacked([m.get(i, b"")], True, True)[0] for i in (1, 8, 9))
            if not len(ids) == len(lats) == len(lons):
                raise ValueError("dense nodes of different lengths")
            yield strings.batch("node", ids, *_runs(unpacked([m.get(10, b"")])[0].tolist(), len(ids)), lat=degrees(lats, lat0), lon=degrees(lons, lon0))
        if held[3]:
            refs, starts = unpacked([m.get(8, b"") for m in held[3]], True, True)
            yield strings.batch("way", [m[1] for m in held[3]], *strings.tags(held[3]), refs=pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(refs)))
        if held[4]:
            (roles, starts), (ids, _), (types, _) = (unpacked([m.get(k, b"") for m in held[4]], k == 9, k == 9) for k in (8, 9, 10))
            members = pa.StructArray.from_arrays([pa.array(ids), pa.array(types, pa.int32()), strings.take(roles)], fields=list(MEMBER))
            yield strings.batch("relation", [m[1] for m in held[4]], *strings.tags(held[4]), members=pa.ListArray.from_arrays(pa.array(starts, pa.int32()), members))


class Strings:
    """A block's strings, and batches of elements that name them by number."""

    def __init__(self, texts: list[str]):
        self.array = pa.array(texts, pa.string())
        first: dict[str, int] = {}
        self.same = np.array([first.setdefault(s, i) for i, s in enumerate(texts)], np.int64)  # equal strings have one number

    def take(self, at: np.ndarray) -> pa.Array:
        return self.array.take(pa.array(at))

    def tags(self, messages: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (keys, starts), (values, ends) = (unpacked([m.get(k, b"") for m in messages]) for k in (2, 3))
        if not np.array_equal(starts, ends):
            raise ValueError("keys and values of different lengths")
        return keys, values, starts

    def batch(self, kind: str, ids, keys: np.ndarray, values: np.ndarray, starts: np.ndarray, **more) -> pa.RecordBatch:  # noqa: ANN001, ANN003
        n = len(ids)
        element = np.repeat(np.arange(n), np.diff(starts))
        _, first = np.unique(element * max(1, len(self.same)) + self.same[keys], return_index=True)
        if len(first) < len(keys):  # of a key that an element has twice the first value counts
            first.sort()
            keys, values, starts = keys[first], values[first], np.searchsorted(element[first], np.arange(n + 1))
        more |= {"kind": pa.array([kind]).take(pa.array(np.zeros(n, np.int64))), "id": pa.array(ids, pa.int64())}
        more["tags"] = pa.MapArray.from_arrays(pa.array(starts, pa.int32()), self.take(keys), self.take(values))
        columns = [more[f.name] if f.name in more else pa.nulls(n, f.type) for f in ARROW]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.float64()) for c in columns], schema=ARROW)


def _runs(numbers: list[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and starts of dense nodes' tags: pairs of numbers, a 0 after each node's."""
    keys, values, starts = [], [], [0]
    runs = iter(numbers)
    for _ in range(n):
        for key in runs:
            if key == 0:
                break
            keys.append(key)
            values.append(next(runs))
        starts.append(len(keys))
    return np.array(keys, np.int64), np.array(values, np.int64), np.array(starts, np.int64)


def _gathered(message: bytes) -> dict[int, int | bytes]:
    out: dict[int, int | bytes] = {}
    for k, v in fields(message):
        out[k] = out[k] + v if isinstance(v, bytes) and k in out else v
    return out


@dataclass
class Blobs(InputPartition):
    ranges: list[tuple[str, int, int]]  # path, start, stop


class PbfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mask = options["path"], options.get("pathglobfilter", "*.pbf").lower()
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        kinds = options.get("kinds")
        self.kinds = None if kinds is None else frozenset(k.strip() for k in kinds.split(","))

    def partitions(self) -> list[Blobs]:
        store, inside = store_of(self.path)
        info = store.get_file_info(inside)
        if info.type == pafs.FileType.Directory:
            held = store.get_file_info(pafs.FileSelector(inside, recursive=True))
            held = [i for i in held if i.is_file and fnmatch.fnmatch(i.base_name.lower(), self.mask)]
        else:
            held = [info]
        prefix = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        ranges = [(prefix + i.path, at, min(at + self.range, i.size)) for i in sorted(held, key=lambda i: i.path) for at in range(0, i.size, self.range)]
        most = max(PARTITIONS, -(-sum(i.size for i in held) // SHARE))
        step = -(-len(ranges) // most) or 1
        return [Blobs(ranges[i : i + step]) for i in range(0, len(ranges), step)]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        for batch in self.batches(partition):
            for *row, tags, refs, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield *row, dict(tags), refs, None if members is None else [tuple(m.values()) for m in members]

    def batches(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        for path, start, stop in partition.ranges:
            store, inside = store_of(path)
            with store.open_input_file(inside) as f:
                for offset, length in blob_ranges(f, start, stop):
                    yield from block_batches(blob_content(f.read_at(length, offset)), self.kinds)


class PushingReader(PbfReader):
    """Takes conditions on kind from Spark's plan."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on kind are met while blocks are read; the others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.kinds = frozenset(wanted if self.kinds is None else self.kinds & wanted)


class BatchReader(PbfReader):
    """Gives Spark a batch a group of elements instead of rows."""

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class PushingBatchReader(PushingReader):
    """The same with conditions on kind."""

    read = BatchReader.read


class PbfSource(DataSource):
    """spark.dataSource.register(PbfSource), then spark.read.format("osmpbf").load(path), a file or a folder
    (option pathGlobFilter, any case). Option rangeBytes: bytes a range. Option kinds: node, way, relation,
    some of them with commas between; nothing of the others is decoded. Option pushFilters=true: the
    same for conditions on kind, in sessions with spark.sql.python.filterPushdown.enabled (Spark
    takes it for an error without)."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:  # noqa: ANN001
        pushing = str(self.options.get("pushfilters", "false")).lower() == "true"
        return (PushingBatchReader if pushing else BatchReader)(self.options)


# ---- writing


def to_varint(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def message(field: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return to_varint(field << 3) + to_varint(value)
    return to_varint(field << 3 | 2) + to_varint(len(value)) + value


def to_packed(values: np.ndarray, starts: np.ndarray, zigzag: bool = False, delta: bool = False) -> list[bytes]:
    """Packed fields of lists of numbers, which follow each other in `values` and begin at `starts`."""
    v = np.asarray(values, np.int64)
    if delta:
        heads = starts[:-1][np.diff(starts) > 0]
        v, whole = np.diff(v, prepend=0), v
        v[heads] = whole[heads]
    u = ((v << 1) ^ (v >> 63) if zigzag else v).astype(np.uint64)
    size = np.searchsorted(np.uint64(1) << np.arange(7, 64, 7, dtype=np.uint64), u, side="right") + 1
    at = np.arange(int(size.max(initial=1)))[None]
    digits = ((u[:, None] >> (7 * at).astype(np.uint64)) & np.uint64(0x7F)).astype(np.uint8)
    digits[at < size[:, None] - 1] |= 0x80
    data, cuts = digits[at < size[:, None]].tobytes(), np.r_[0, np.cumsum(size)][starts].tolist()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def blob(kind: bytes, data: bytes) -> bytes:
    body = message(2, len(data)) + message(3, zlib.compress(data))
    head = message(1, kind) + message(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def _spread(column: pa.Array, *names: str) -> tuple[list[pa.Array], np.ndarray]:
    """The values of an array of lists or maps one after the other, and where each list begins."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    a, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if isinstance(column, pa.MapArray):
        values = [column.keys.slice(a, n), column.items.slice(a, n)]
    else:
        values = column.values.slice(a, n)
        values = [values.field(c) for c in names] if names else [values]
    return values, offsets - a


def block(kind: str, rows: pa.RecordBatch) -> bytes:
    """A block of elements of one kind, in the columns of the schema above."""
    (keys, values), tagged = _spread(rows.column("tags"))
    named, held = [keys, values], np.zeros(1, np.int64)
    if kind == "relation":
        (members, types, roles), held = _spread(rows.column("members"), "id", "type", "role")
        named.append(roles)
    coded = pa.concat_arrays(named).dictionary_encode()
    number = coded.indices.to_numpy() + 1  # 0 is the empty string
    keys, values, roles = np.split(number, np.cumsum([len(keys), len(values)]))
    ids = rows.column("id").to_numpy()
    if kind == "node":
        all_ = np.array([0, len(ids)])
        degrees = lambda c: np.rint(rows.column(c).to_numpy() * 1e7).astype(np.int64)
        runs = np.zeros(2 * len(keys) + len(ids), np.int64)
        at = 2 * np.arange(len(keys)) + np.repeat(np.arange(len(ids)), np.diff(tagged))
        runs[at], runs[at + 1] = keys, values
        one = lambda v: to_packed(v, all_, True, True)[0]
        dense = message(1, one(ids)) + message(8, one(degrees("lat"))) + message(9, one(degrees("lon"))) + message(10, to_packed(runs, np.array([0, len(runs)]))[0])
        group = message(2, dense)
    else:
        parts = [(2, to_packed(keys, tagged)), (3, to_packed(values, tagged))]
        if kind == "way":
            (refs,), starts = _spread(rows.column("refs"))
            parts.append((8, to_packed(refs.to_numpy(), starts, True, True)))
        else:
            parts += [(8, to_packed(roles, held)), (9, to_packed(members.to_numpy(), held, True, True)), (10, to_packed(types.to_numpy(), held))]
        numbers, lists = [n for n, _ in parts], [p for _, p in parts]
        field = 3 if kind == "way" else 4
        group = b"".join(message(field, message(1, i) + b"".join(map(message, numbers, held))) for i, *held in zip(ids.tolist(), *lists, strict=True))
    return message(1, message(1, b"") + b"".join(message(1, s.encode()) for s in coded.dictionary.to_pylist())) + message(2, group)


def write_extract(elements: DataFrame, path: str, per_block: int = 8000) -> None:
    """Elements of the schema above as one file a partition; a task that is run again replaces its file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {"node": [], "way": [], "relation": []}
        out = [blob(b"OSMHeader", message(4, b"OsmSchema-V0.6") + message(4, b"DenseNodes"))]

        def flush(kind: str, least: int) -> None:
            """Blocks of the rows held, while there are `least` of them."""
            for rows in pa.concat_tables(held[kind]).combine_chunks().to_batches() if held[kind] else []:
                whole = rows.num_rows - rows.num_rows % least
                out.extend(blob(b"OSMData", block(kind, rows.slice(a, min(per_block, whole - a)))) for a in range(0, whole, per_block))
                held[kind] = [pa.Table.from_batches([rows.slice(whole)])] if whole < rows.num_rows else []

        for batch in batches:
            for kind in held:
                held[kind].append(pa.Table.from_batches([batch]).filter(pc.equal(batch.column("kind"), kind)))
                if sum(rows.num_rows for rows in held[kind]) >= per_block:
                    flush(kind, per_block)
        for kind in held:
            flush(kind, 1)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.osm.pbf"
        write_file(name, b"".join(out))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    elements.mapInArrow(write, "file string").count()
