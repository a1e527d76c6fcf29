"""A Structured Streaming source over folders of growing FASTQ files, parsed by the executors.

An offset is a byte of each file, where a record ends.  The driver lists files and looks at the last bytes before each
such place to find it; it parses no record and reads no more of a file than that.  What lies between two offsets is cut
into byte ranges; a task finds the first record that begins in its range and reads those that begin there, the last one to
its end.  A range is a part of a file that no longer changes, so a step that is done again, by a lost task or after a
restart from a checkpoint, gives the same rows.

Records have four lines.  A line that begins with @, with a + at the beginning of the line after the next, begins a
record: a quality line with an @ is followed by a title and a sequence, and no sequence begins with +.

Compressed files are one range each, read when they are first seen, so they have to be moved into the folder whole.
Rows are known by file and row_ix, the byte where the record begins (in the text, for compressed files), from 1.
"""

from __future__ import annotations

import bz2
import gzip
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import ArgumentMismatch, InputError
from ..sources.ranges import SPLIT, open_at, ragged, seekable, size_of

SCHEMA = "file string, row_ix bigint, id string, sread string, qual string"
#: Bytes that are looked at first for the end of a record, and that a task parses at once.
LOOK, PIECE = 1 << 16, 8 << 20
_PACKED = {".gz": gzip.open, ".bz2": bz2.open}
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32
_UPPER[ord(".")] = ord("-")


def _lines(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where whole lines begin, and where they end (their line feed)."""
    ends = np.flatnonzero(b == 10)
    return np.r_[0, ends[:-1] + 1][: len(ends)], ends


def beginnings(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines begin a record of four whole lines."""
    n = max(0, len(start) - 3)
    first = np.append(b, np.uint8(0))[start]
    out = (first[:n] == ord("@")) & (first[2 : n + 2] == ord("+"))
    return np.flatnonzero(out)


def last_end(path: str, begin: int, limit: int) -> int:
    """The last byte from `begin`, where a record begins, to `limit` at which a record ends."""
    look = LOOK
    with open_at(path) as f:
        while limit > begin:
            low = max(begin, limit - look)
            f.seek(low)
            b = np.frombuffer(f.read(limit - low), dtype=np.uint8)
            start, end = _lines(b)
            if low > begin and len(start):
                # The first line may have begun earlier.
                start, end = start[1:], end[1:]
            found = beginnings(b, start, end)
            if len(found):
                return low + int(end[found[-1] + 3]) + 1
            if low == begin:
                break
            look *= 16
    return begin


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    stop: int
    end: int
    first: bool


def range_rows(part: Range) -> Iterator[pa.RecordBatch]:
    """Records that begin in a range; part.end is where the last record of the file's step ends."""
    suffix = os.path.splitext(part.file)[1]
    if suffix in _PACKED:
        with open_at(part.file) as raw, _PACKED[suffix](raw, "rb") as f:
            yield from _records(f, part.file, 0, 1 << 62, 1 << 62, True)
        return
    with open_at(part.file, part.begin) as f:
        yield from _records(f, part.file, part.begin, part.stop, part.end, part.first)


def _records(f, file: str, at: int, stop: int, end: int, first: bool) -> Iterator[pa.RecordBatch]:
    """f stands at `at`; `first` tells that a record begins there, and else the line before is not known to have ended."""
    rest, known = b"", first
    while True:
        more = f.read(min(PIECE, end - at - len(rest)))
        data = rest + more
        over = not more
        if over and data and not data.endswith(b"\n"):
            data += b"\n"
        b = np.frombuffer(data, dtype=np.uint8)
        start, ends = _lines(b)
        if not known:
            # Of the first record that begins behind the first line end.
            found = beginnings(b, start, ends)
            found = found[found > 0]
            if len(found):
                start, ends, known = start[found[0] :], ends[found[0] :], True
            elif over or at + len(data) > stop + (PIECE << 4):
                return
            else:
                rest = data
                continue
        n = len(start) // 4
        own = int(np.searchsorted(start[: 4 * n : 4] + at, stop))
        if own:
            yield from _batches(b, start[: 4 * own].reshape(-1, 4), ends[: 4 * own].reshape(-1, 4), file, at)
        if own < n:
            return
        used = int(ends[4 * n - 1]) + 1 if n else int(start[0]) if len(start) else 0
        if over:
            if used < len(data) and data[used:].strip() and at + used < stop:
                raise InputError(f"'{file}' ends within a record")
            return
        rest, at = data[used:], at + used
        if at >= stop:
            return


def _batches(b: np.ndarray, start: np.ndarray, end: np.ndarray, file: str, at: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(start), 10_000):
        s, e = start[k : k + 10_000], end[k : k + 10_000]
        if not ((b[s[:, 0]] == ord("@")) & (b[s[:, 2]] == ord("+"))).all():
            raise InputError(f"'{file}' has a record that does not begin with '@', or whose third line is not '+'")
        e = e - (b[e - 1] == 13) * (e > s)
        size = e - s
        if (size[:, 1] != size[:, 3]).any():
            raise InputError(f"sequence and quality differ in width in '{file}'")
        texts = [ragged(b, s[:, 0] + 1, size[:, 0] - 1), ragged(_UPPER[b], s[:, 1], size[:, 1]), ragged(b, s[:, 3], size[:, 3])]
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(s)), pa.array(s[:, 0] + at + 1, pa.int64()), *texts], ["file", "row_ix", "id", "sread", "qual"])


def logged_offset(checkpoint: str) -> dict[str, int]:
    """The last offset that a query with this source alone has logged in its checkpoint folder; {} if it has not begun."""
    folder = os.path.join(re.sub(r"^file:(//)?", "", checkpoint), "offsets")
    steps = [int(n) for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    if not steps:
        return {}
    with open(os.path.join(folder, str(max(steps)))) as f:
        return json.loads(f.read().splitlines()[2])


class SplitReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, step: int, split: int, checkpoint: str | None = None):
        self.path, self.pattern, self.step, self.split = path, pattern, step, split
        #: Where the last offset was.  Spark asks for the next one without telling; without a checkpoint to look it up in, the
        #: first step of a run takes all there is.
        self.last: dict[str, int] | None = None if checkpoint is None else logged_offset(checkpoint)

    def files(self) -> dict[str, int]:
        """Files of the folder and their sizes."""
        if not seekable(self.path) or "://" in self.path and not self.path.startswith("file:"):
            from pyarrow import fs

            system, inside = fs.FileSystem.from_uri(self.path)
            root = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else self.path.split("://")[0] + "://"
            found = {root + i.path: i.size for i in system.get_file_info(fs.FileSelector(inside)) if i.is_file}
        else:
            folder = re.sub(r"^file:(//)?", "", self.path)
            found = {e.path: e.stat().st_size for e in os.scandir(folder) if e.is_file()}
        return {f: n for f, n in sorted(found.items()) if re.search(self.pattern, os.path.basename(f))}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        known, left, out = self.last, self.step, {}
        for file, size in self.files().items():
            begin = (known or {}).get(file, 0)
            if os.path.splitext(file)[1] in _PACKED:
                out[file] = size if begin or known is None or left > 0 else 0
                left -= size if not begin else 0
            else:
                limit = size if known is None else min(size, begin + max(0, left))
                # After a restart the start is not known, and the first bytes of the file are as good as any.
                out[file] = last_end(file, begin, limit)
                if out[file] == begin and limit < size and left > 0:
                    # A record that is longer than a step.
                    out[file] = last_end(file, begin, size)
                left -= out[file] - begin
        out = {f: n for f, n in out.items() if n} | {f: n for f, n in (known or {}).items() if f not in out}
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.last = dict(end)
        out = []
        for file, stop in end.items():
            begin = start.get(file, 0)
            if stop <= begin:
                continue
            if os.path.splitext(file)[1] in _PACKED:
                if not begin:
                    out.append(Range(file, 0, stop, stop, True))
                continue
            for at in range(begin, stop, self.split):
                out.append(Range(file, at if at == begin else at - 1, min(stop, at + self.split), stop, at == begin))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return range_rows(partition)

    def commit(self, end: dict) -> None:
        pass


class FastqSplits(DataSource):
    """spark.readStream.format("fastq_splits"): options path (a folder), pattern (of file names), split (bytes of a task), and
    step (bytes in a step) with checkpoint (the query's local or shared checkpoint folder)."""

    @classmethod
    def name(cls) -> str:
        return "fastq_splits"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SplitReader:
        if "path" not in self.options:
            raise ArgumentMismatch("the option 'path' is missing")
        step, split = (int(self.options.get(k, d)) for k, d in (("step", 1 << 40), ("split", SPLIT)))
        if step < 1 or split < 1:
            raise ArgumentMismatch("'step' and 'split' must be positive")
        return SplitReader(self.options["path"], self.options.get("pattern", r"^[^_.]"), step, split, self.options.get("checkpoint"))


def stream_folder(spark: SparkSession, path: str, pattern: str = r"^[^_.]", step: int = 1 << 40, split: int = SPLIT, checkpoint: str | None = None) -> DataFrame:
    """Reads (file, row_ix, id, sread, qual) of a folder's files as they grow and appear, about `step` bytes at a time if the
    query's checkpoint folder is given."""
    spark.dataSource.register(FastqSplits)
    more = {} if checkpoint is None else {"checkpoint": checkpoint}
    return spark.readStream.format("fastq_splits").options(pattern=pattern, step=str(step), split=str(split), **more).load(path)
