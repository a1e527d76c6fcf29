"""Block-gzipped FASTQ, many tasks a file, in the way that alignment maps are read.

A file is cut into byte ranges.  A task begins at the first block of its range, and there at the first line that begins a
record of four lines; a record belongs to the range of the block that it begins in.  The pass that counts records checks
that each range ends where the next begins, and walks again where a line was taken for a title wrongly.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..errors import InputError
from .bam import TEXT, Text, block, numbered_ranges
from .files import data_files
from .ranges import SPLIT, is_blocked, open_at, ragged, size_of, tasks

SCHEMA = "file string, row_ix bigint, id string, sread string, qual string"
_BASES = np.arange(256, dtype=np.uint8)
_BASES[ord("a") : ord("z") + 1] -= 32
_BASES[ord(".")] = ord("-")


def titles(b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which lines begin a record: with @, and the line after the next with +.  A quality line with an @ is followed by a
    title and a sequence, and no sequence begins with +."""
    n = max(0, len(start) - 3)
    first = np.append(b, np.uint8(0))[start]
    return np.flatnonzero((first[:n] == ord("@")) & (first[2 : n + 2] == ord("+")))


def find_title(text: Text, end: int, _: int = 0) -> bool:
    """Move to the first record that begins before a place; whether there is one."""
    for least in (1 << 18, 1 << 22, 1 << 26):
        text.fill(least)
        b, stop = np.frombuffer(text.data, dtype=np.uint8), text.stop(end)
        ends = np.flatnonzero(b[text.at :] == 10) + text.at
        start = np.r_[text.at, ends[:-1] + 1][: len(ends)]
        found = titles(b, start)
        if len(found):
            text.at = int(start[found[0]])
            return text.at < stop
        if text.whole or len(start) > 8 and start[-4] >= stop:
            return False
    return False


def four_lines(text: Text, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps (bytes, places of lines) of the records that begin before a place: begins and ends of four lines a row."""
    least, last = TEXT, end >> 16
    while True:
        text.fill(least, last)
        if text.whole and text.at < len(text.data) and text.data[-1:] != b"\n":
            text.data += b"\n"
        b, at, stop = np.frombuffer(text.data, dtype=np.uint8), text.at, text.stop(end)
        ends = np.flatnonzero(b[at:] == 10) + at
        n = len(ends) // 4
        start = np.r_[at, ends[:-1] + 1][: len(ends)]
        s, e = start[: 4 * n].reshape(-1, 4), ends[: 4 * n].reshape(-1, 4)
        own = int(np.searchsorted(s[:, 0], stop))
        if own:
            yield b, np.c_[s[:own], e[:own]]
        text.at = int(s[own, 0]) if own < n else int(ends[4 * n - 1]) + 1 if n else at
        least, last = (TEXT, end >> 16) if own else (2 * least, None)
        if text.at >= stop:
            return
        if text.whole:
            if text.data[text.at :].strip():
                raise InputError("the file ends within a record")
            text.at = len(text.data)
            return


def batches(b: np.ndarray, lines: np.ndarray, file: str, base: int) -> Iterator[pa.RecordBatch]:
    """Reads from lines, numbered on from base."""
    for k in range(0, len(lines), 10_000):
        s, e = lines[k : k + 10_000, :4], lines[k : k + 10_000, 4:]
        if not ((b[s[:, 0]] == ord("@")) & (b[s[:, 2]] == ord("+"))).all():
            raise InputError(f"'{file}' has a record whose title does not begin with @, or whose third line does not with +")
        e = e - ((b[np.maximum(e - 1, 0)] == 13) & (e > s))
        size = e - s
        if (size[:, 1] != size[:, 3]).any():
            raise InputError(f"sequence and quality differ in width in file {file}, record {base + k + 1 + int(np.argmax(size[:, 1] != size[:, 3]))}")
        texts = [ragged(b, s[:, 0] + 1, size[:, 0] - 1), ragged(_BASES[b], s[:, 1], size[:, 1]), ragged(b, s[:, 3], size[:, 3])]
        number = np.arange(base + k + 1, base + k + 1 + len(s))
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(s)), pa.array(number, pa.int64()), *texts], ["file", "row_ix", "id", "sread", "qual"])


def read_fastq_blocked(spark: SparkSession, path: str | list[str], pattern: str | None = None, split: int = SPLIT) -> DataFrame:
    """Reads as read_fastq() gives them, of block-gzipped files.  split: compressed bytes that are one task, as in read_bam()."""
    files = data_files(path, pattern)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, file in zip(batch.column("k").to_pylist(), batch.column("file").to_pylist()):
                with open_at(file) as f:
                    if size_of(f) and not is_blocked(f):
                        raise InputError(f"'{file}' is not made of blocks; read_fastq() reads it")
                    yield pa.RecordBatch.from_pylist([{"k": k, "size": size_of(f), "blocked": True, "place": 0}], schema=pa.schema([("k", pa.int32()), ("size", pa.int64()), ("blocked", pa.bool_()), ("place", pa.int64())]))

    heads = sorted(tasks(spark, list(enumerate(files)), "k int, file string").mapInArrow(head, "k int, size bigint, blocked boolean, place bigint").collect())
    known = spark.sparkContext.broadcast({files[h.k]: (h.size, True, []) for h in heads})
    rows = numbered_ranges(spark, files, [h for h in heads if h.size], known, split, find_title, four_lines)

    def parse(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for row in batch.to_pylist():
                base = row["base"]
                with open_at(row["file"]) as f:
                    for b, lines in four_lines(Text(f, known.value[row["file"]][0], row["place"], True), row["stop"]):
                        yield from batches(b, lines, row["file"], base)
                        base += len(lines)

    return tasks(spark, rows, "file string, place bigint, stop bigint, base bigint, by_place boolean").mapInArrow(parse, SCHEMA)




def write_fastq_blocked(reads: DataFrame, folder: str) -> int:
    """A local or shared folder of block-gzipped files in the order of row_ix, one a partition, which can be read in ranges;
    the number of records."""
    folder = folder.removeprefix("file://")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        context = TaskContext.get()
        to = os.path.join(folder, f"part-{context.partitionId():05d}.fastq.gz")
        draft, held, n = f"{to}.{context.taskAttemptId()}", b"", 0
        with open(draft, "wb") as f:
            for batch in batches_:
                n += batch.num_rows
                held += "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in zip(*(batch.column(c).to_pylist() for c in ("id", "sread", "qual")))).encode()
                whole = len(held) // 65_280 * 65_280
                for k in range(0, whole, 65_280):
                    f.write(block(held[k : k + 65_280]))
                held = held[whole:]
            f.write(block(held) if held else b"")
            f.write(block(b""))
        os.replace(draft, to)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    sorted_ = reads.repartitionByRange("row_ix").sortWithinPartitions("row_ix")
    return sum(r["n"] for r in sorted_.select("id", "sread", "qual").mapInArrow(run, "n bigint").collect())
