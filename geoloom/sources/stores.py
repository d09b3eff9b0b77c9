"""Byte ranges of files in any store that Arrow's file systems reach (local, HDFS, S3, GCS), opened where the task runs."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path inside it; file:/x is read like file:///x."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(at.path) if at.scheme else path
    return pafs.FileSystem.from_uri(path)


def read_range(path: str, start: int, stop: int | None = None) -> bytes:
    """Bytes start .. stop of a file, or as many of them as there are."""
    store, inside = store_of(path)
    with store.open_input_file(inside) as f:
        size = f.size()
        stop = size if stop is None else min(stop, size)
        return f.read_at(stop - start, start) if stop > start else b""


def write_file(path: str, content: bytes) -> None:
    """Write a file in one piece, replacing what an earlier attempt of the same task has left."""
    store, inside = store_of(path)
    store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inside) as f:
        f.write(content)
