"""Byte ranges of files as tasks: any place of a file can be opened, and a table of ranges is dealt one to a task.

Files are opened where they are read, on the executors: local and shared folders directly, other file systems through
Arrow's.  A file of a system that neither knows is read as a whole by Spark.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InputError

#: Bytes of a file that are one task, if the caller gives no other number.
SPLIT = 64 << 20
_SYSTEMS = ("s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def seekable(path: str) -> bool:
    return urlparse(path).scheme in ("", "file", *_SYSTEMS)


def open_at(path: str, at: int = 0):
    """A file, open for reading from a place on."""
    scheme = urlparse(path).scheme
    if scheme in _SYSTEMS:
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(path)
        f = system.open_input_file(inside)
    else:
        f = open(unquote(urlparse(path).path) if scheme == "file" else path, "rb")
    f.seek(at)
    return f


def size_of(f) -> int:
    at = f.tell()
    end = f.seek(0, io.SEEK_END)
    end = f.tell() if end is None else end
    f.seek(at)
    return end


def tasks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of ranges, each in a partition of its own."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema, verifySchema=False)


def ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """Pieces data[start : start + size] as an Arrow array of strings or bytes."""
    ends = np.r_[0, np.cumsum(size)].astype(np.int64)
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    wide = pa.large_string() if kind == pa.string() else pa.large_binary()
    return pa.Array.from_buffers(wide, len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at].astype(np.uint8).tobytes())]).cast(kind)


# Block-gzipped files: gzip members of up to 64 KB, each of which tells its own size.

_HEAD = b"\x1f\x8b\x08\x04"


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with head, or 0 if none does."""
    if len(head) < 18 or head[:4] != _HEAD:
        return 0
    extra = int.from_bytes(head[10:12], "little")
    at, end = 12, min(len(head), 12 + extra)
    while at + 4 <= end:
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def is_blocked(f) -> bool:
    f.seek(0)
    found = block_size(f.read(64)) > 0
    f.seek(0)
    return found


def next_block(f, at: int, size: int) -> int:
    """The first block that begins at a byte or behind it; the file's size if none does.

    A block's head can occur by chance within another block, so the one that it would be followed by must begin right too.
    """
    while at < size:
        f.seek(at)
        data = f.read(1 << 17)
        k = data.find(_HEAD)
        while k >= 0:
            n = block_size(data[k : k + 64])
            if n:
                f.seek(at + k + n)
                behind = f.read(64)
                if at + k + n == size or block_size(behind):
                    return at + k
            k = data.find(_HEAD, k + 1)
        if len(data) < 1 << 17:
            return size
        at += len(data) - 64
    return size


def blocks(f, at: int, size: int, ahead: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Places and contents of the blocks from one on; reads go ahead by about a megabyte."""
    data, base = b"", at
    while at < size:
        if len(data) - (at - base) < 1 << 16:
            f.seek(at)
            data, base = f.read(max(ahead, 1 << 16)), at
        n = block_size(data[at - base : at - base + 64])
        if not n or at + n > size:
            raise InputError(f"no block begins at byte {at}, or the file ends within it")
        try:
            text = zlib.decompress(data[at - base : at - base + n], 31)
        except zlib.error as e:
            raise InputError(f"the block at byte {at} is damaged: {e}") from e
        yield at, text
        at += n
