"""Shape (.shp) and attribute (.dbf) files as DataFrames.

Spark lists the files; a file is then read in ranges of records, a task each: shapes by the offsets
of the record index (.shx), attributes by the fixed width of their records. Files may lie in any
store that Arrow's file systems reach.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from geoloom.session import in_parts
from geoloom.sources.stores import read_range, write_file

SHAPE_SCHEMA = (
    "file string, rec_no int, type int, parts array<int>, part_types array<int>, x array<double>, y array<double>, z array<double>, m array<double>, "
    "minx double, miny double, maxx double, maxy double"
)

RECORDS = 100_000  # that a task reads of a file
TASKS = 64  # of a scan, or four a core; beyond that its tasks read more records each, up to RECORDS
AT_ONCE = 10_000  # records that a task holds

#: fixed values: type codes; 0 is the null shape
POINTS, ARCS, POLYGONS, MULTIPOINTS, MULTIPATCH = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28), 31


def records(data: bytes, number: int = 0) -> Iterator[tuple]:
    """(rec_no, type, parts, part_types, x, y, z, m) of a run of a .shp file's records from `number` on."""
    at = 0
    while at + 12 <= len(data):
        words = struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        yield number, *_shape(body)
        number += 1


def _shape(b: bytes) -> tuple:
    kind = struct.unpack("<i", b[:4])[0]
    doubles = lambda start, n: np.frombuffer(b, "<f8", n, start).tolist() if start + 8 * n <= len(b) else [0.0] * n
    if kind == 0:
        return kind, [], [], [], [], [], []
    if kind in POINTS:
        v = doubles(4, (len(b) - 4) // 8)
        z = v[2:3] if kind == 11 else []
        m = v[3:4] if kind == 11 else v[2:3] if kind == 21 else []
        return kind, [0], [], v[:1], v[1:2], z, m
    if kind in MULTIPOINTS:
        n, at, parts, part_types = struct.unpack("<i", b[36:40])[0], 40, [0], []
    else:
        n_parts, n = struct.unpack("<ii", b[36:44])
        parts = np.frombuffer(b, "<i4", n_parts, 44).tolist()
        at = 44 + 4 * n_parts
        part_types = []
        if kind == MULTIPATCH:
            part_types = np.frombuffer(b, "<i4", n_parts, at).tolist()
            at += 4 * n_parts
    xy = np.frombuffer(b, "<f8", 2 * n, at)
    at += 16 * n
    z, m = [], []
    if kind in (13, 15, 18, MULTIPATCH):
        z = doubles(at + 16, n)
        at += 16 + 8 * n
    if (kind in (23, 25, 28) or z) and at + 16 < len(b):
        m = doubles(at + 16, n)
    return kind, parts, part_types, xy[0::2].tolist(), xy[1::2].tolist(), z, m


def _ranges(spark: SparkSession, sizes: list[tuple[str, int]], records_per_task: int) -> DataFrame:
    """(path, first, last), about a partition each, of files and their numbers of records; a file whose
    number isn't known (-1) is one range, and last is -1."""
    tasks = max(TASKS, 4 * spark.sparkContext.defaultParallelism)
    step = max(records_per_task, min(RECORDS, -(-sum(max(n, 0) for _, n in sizes) // tasks)))
    rows = [(name, a, min(a + step, n)) for name, n in sizes for a in range(0, n, step)] + [(name, 0, -1) for name, n in sizes if n < 0]
    ranges = spark.createDataFrame(rows, "path string, first bigint, last bigint")
    return ranges.repartition(max(1, len(rows)), "path", "first")


def _runs(first: int, last: int) -> Iterator[tuple[int, int]]:
    """A range in pieces of AT_ONCE records."""
    return ((a, min(a + AT_ONCE, last)) for a in range(first, last, AT_ONCE))


def read_shapes(spark: SparkSession, path: str, mask: str = "*.shp", records_per_task: int = RECORDS) -> DataFrame:
    """A11. One row for each record of the files under `path` that the mask fits. A file without a
    record index (.shx) is walked by one task."""
    held = [r["path"] for r in files(spark, path, mask).select("path").collect()]
    index = {r["path"][:-4].lower(): (r["path"], r["length"]) for r in files(spark, path, "*.shx").select("path", "length").collect()}
    sizes = []
    for name in sorted(held):
        _, size = index.get(name[:-4].lower(), ("", 0))
        sizes.append((name, max(0, (size - 100) // 8) if size else -1))
    indexes = {k: v[0] for k, v in index.items()}

    def run_of(name: str, first: int, last: int) -> bytes:
        at = np.frombuffer(read_range(indexes[name[:-4].lower()], 100 + 8 * first, 100 + 8 * last), ">i4").astype(np.int64) * 2
        return read_range(name, int(at[0]), int(at[-2] + 8 + at[-1]))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, first, last in zip(batch["path"], batch["first"].tolist(), batch["last"].tolist(), strict=True):
                runs = [(0, read_range(name, 100))] if last < 0 else ((a, run_of(name, a, b)) for a, b in _runs(first, last))
                for start, data in runs:
                    rows = []
                    for number, kind, parts, part_types, x, y, z, m in records(data, start):
                        box = (min(x), min(y), max(x), max(y)) if x else (None,) * 4
                        rows.append((name, number, kind, parts, part_types, x, y, z, m, *box))
                    if rows:
                        yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in SHAPE_SCHEMA.split(", ")])

    return _ranges(spark, sizes, records_per_task).mapInPandas(decode, SHAPE_SCHEMA)


def files(spark: SparkSession, path: str, mask: str) -> DataFrame:
    """A13. The files under `path`, at any depth, whose name fits a mask of * and ? in any case."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in mask)
    return spark.read.format("binaryFile").option("pathGlobFilter", either).option("recursiveFileLookup", "true").load(path)


def table_fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, width, decimals) of a .dbf file's fields."""
    head = struct.unpack("<H", data[8:10])[0]
    out = []
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
    return out


def _spark_type(kind: str, width: int, decimals: int):  # noqa: ANN202
    if kind in "NF":
        return DoubleType() if decimals or kind == "F" else IntegerType() if width < 10 else LongType()
    return BooleanType() if kind == "L" else StringType()


def _value(raw: str, kind: str, decimals: int, width: int):  # noqa: ANN202
    """A field's value; each type has its own sign for null: blanks or * in numbers, ? in flags, blank
    texts, and zeros in dates."""
    text = raw.strip(" \0")
    if kind in "NF":
        if not text or text.startswith("*"):
            return None
        try:
            return float(text) if decimals or kind == "F" else int(float(text))
        except ValueError:
            return None
    if kind == "L":
        return None if text in ("", "?") else text in "YyTt"
    if kind == "D":
        return None if not text or text.startswith("00000000") else text
    return text or None


def read_attributes(spark: SparkSession, path: str, mask: str = "*.dbf", records_per_task: int = RECORDS) -> DataFrame:
    """A12. (file, rec_no, deleted, fields...): the schema is that of the first file by name."""
    held = sorted(r["path"] for r in files(spark, path, mask).select("path").collect())
    if not held:
        return spark.createDataFrame([], "file string, rec_no int, deleted boolean")
    schema_fields = table_fields(_table_head(held[0]))
    schema = StructType(
        [StructField("file", StringType()), StructField("rec_no", IntegerType()), StructField("deleted", BooleanType())]
        + [StructField(n, _spark_type(k, w, d)) for n, k, w, d in schema_fields]
    )
    sizes = [(name, struct.unpack("<I", read_range(name, 4, 8))[0]) for name in held]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, first, last in zip(batch["path"], batch["first"].tolist(), batch["last"].tolist(), strict=True):
                front = _table_head(name)
                own = {n: (k, w, d) for n, k, w, d in table_fields(front)}
                head, width = struct.unpack("<HH", front[8:12])
                for start, stop in _runs(first, last):
                    data = read_range(name, head + start * width, head + stop * width)
                    columns: dict[str, list] = {n: [] for n, *_ in schema_fields}
                    deleted = []
                    for i in range(len(data) // width):
                        record = data[i * width : (i + 1) * width].decode("latin-1")
                        deleted.append(record[:1] == "*")
                        at = 1
                        for n, (k, w, d) in own.items():
                            if n in columns:
                                columns[n].append(_value(record[at : at + w], k, d, w))
                            at += w
                    count = len(deleted)
                    if count:
                        out = pd.DataFrame({"file": name, "rec_no": range(start, start + count), "deleted": deleted})
                        for n, k, w, d in schema_fields:
                            kind = "boolean" if k == "L" else None if k in "CD" else "float64" if d or k == "F" else "Int64"
                            out[n] = pd.Series(columns[n] or [None] * count, dtype=kind or object)
                        yield out

    return _ranges(spark, sizes, records_per_task).mapInPandas(decode, schema)


def _table_head(path: str) -> bytes:
    return read_range(path, 0, struct.unpack("<H", read_range(path, 8, 10))[0])


# ---- writing


def _shape_header(words: int, kind: int, box: tuple[float, float, float, float]) -> bytes:
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, kind, *box, 0, 0, 0, 0)


def write_layers(rings: DataFrame, path: str, name: str, fields: list[tuple[str, str, int, int]]) -> DataFrame:
    """Polygons of one closed ring as layers: for each value of the column `name` a .shp, .shx and .dbf
    file, written by one task (the format ends at 2 GB). rings: name, x, y (arrays), order, deleted and
    the fields, (name, type, width, decimals). Returns (layer, n)."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        shapes, index, at = [], [], 50
        lows = [min(v) for c in "xy" for v in [[min(a) for a in pdf[c]]]]
        highs = [max(v) for c in "xy" for v in [[max(a) for a in pdf[c]]]]
        for number, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True), 1):
            points = np.column_stack([x, y]).astype("<f8").tobytes()
            body = struct.pack("<i4d3i", 5, min(x), min(y), max(x), max(y), 1, len(x), 0) + points
            shapes.append(struct.pack(">ii", number, len(body) // 2) + body)
            index.append(struct.pack(">ii", at, len(body) // 2))
            at += 4 + len(body) // 2
        box = (*lows, *highs)
        stem = f"{path}/{key[0]}"
        write_file(f"{stem}.shp", _shape_header(at, 5, box) + b"".join(shapes))
        write_file(f"{stem}.shx", _shape_header(50 + 4 * len(index), 5, box) + b"".join(index))
        heads = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields)
        rows = []
        for row in pdf.to_dict("records"):
            out = "*" if row["deleted"] else " "
            for n, k, w, d in fields:
                v = row[n]
                if k == "L":
                    text = "?" if v is None else "T" if v else "F"
                elif k in "NF":
                    text = "*" * w if v is None or v != v else f"{v:.{d}f}" if d else str(int(v))
                else:
                    text = v or ""
                out += text[:w].rjust(w) if k in "NF" else text[:w].ljust(w)
            rows.append(out)
        width = 1 + sum(f[2] for f in fields)
        front = b"\x03\0\0\0" + struct.pack("<IHH", len(rows), 33 + len(heads), width) + b"\0" * 20
        write_file(f"{stem}.dbf", front + heads + b"\r" + "".join(rows).encode("latin-1", "replace"))
        return pd.DataFrame({"layer": [key[0]], "n": [len(rows)]})

    return in_parts(rings, 100_000, name).groupBy(name).applyInPandas(write, "layer string, n long")
