"""FASTQ in steps: a small Structured Streaming source over one growing file whose sequences may span lines (the source for
many and large files is in splits), batches of records, and repeated samples."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..errors import ArgumentMismatch, InputError, ReadsError
from ..operators.tables import batches, exact_sample, record_ranges
from ..sources.files import scratch_folder

SCHEMA = "row_ix bigint, id string, sread string, qual string"


def parse_records(data: bytes, most: int) -> tuple[list[tuple[str, str, str]], int]:
    """Whole records at the start of data, at most so many, and the bytes that they take.

    A sequence may span lines; its quality has as many characters, so '@' there starts no record.
    """
    out, at, n = [], 0, len(data)
    while len(out) < most:
        ends = data.find(b"\n", at)
        if ends < 0:
            break
        if data[at : at + 1] != b"@":
            raise InputError(f"record does not start with '@' at byte {at}")
        name, here, seq = data[at + 1 : ends].rstrip(), ends + 1, b""
        while here < n and data[here : here + 1] != b"+":
            ends = data.find(b"\n", here)
            if ends < 0:
                return out, at
            seq += data[here:ends].strip()
            here = ends + 1
        ends = data.find(b"\n", here)
        if ends < 0:
            break
        here, qual = ends + 1, b""
        while len(qual) < len(seq) or not seq:
            ends = data.find(b"\n", here)
            if ends < 0:
                return out, at
            qual += data[here:ends].strip()
            here = ends + 1
            if not seq:
                break
        if len(qual) != len(seq):
            raise InputError(f"read and quality of '{name.decode()}' differ in width")
        out.append((name.decode(), seq.decode().upper().replace(".", "-"), qual.decode("latin-1")))
        at = here
    return out, at


class FastqStreamReader(SimpleDataSourceStreamReader):
    """Offsets are bytes and records; a record that is not whole yet waits for the next step."""

    def __init__(self, path: str, most: int, block: int):
        self.path, self.most, self.block = path, most, block

    def initialOffset(self) -> dict:
        return {"byte": 0, "record": 0}

    def _from(self, start: dict, most: int) -> tuple[list[tuple], int]:
        with open(self.path, "rb") as f:
            f.seek(start["byte"])
            data = b""
            while True:
                more = f.read(self.block)
                data += more
                found, size = parse_records(data, most)
                if len(found) >= most or not more:
                    return [(start["record"] + i, *r) for i, r in enumerate(found, 1)], start["byte"] + size

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, byte = self._from(start, self.most) if os.path.getsize(self.path) > start["byte"] else ([], start["byte"])
        return iter(rows), {"byte": byte, "record": start["record"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._from(start, end["record"] - start["record"])[0]) if end["record"] > start["record"] else iter([])

    def commit(self, end: dict) -> None:
        pass


class FastqStream(DataSource):
    """spark.readStream.format("fastq_stream"): options path, n (records in a step) and block (bytes read at once)."""

    @classmethod
    def name(cls) -> str:
        return "fastq_stream"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> FastqStreamReader:
        if "path" not in self.options:
            raise ArgumentMismatch("the option 'path' is missing")
        return FastqStreamReader(self.options["path"], int(self.options.get("n", 1_000_000)), int(self.options.get("block", 100_000_000)))


def read_stream(spark: SparkSession, path: str, n: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(FastqStream)
    return spark.readStream.format("fastq_stream").option("path", path).option("n", n).load()


class RecordBatches:
    """Successive batches of a reads table: of n records, or of given ranges; then None."""

    def __init__(self, reads: DataFrame, n: int = 1_000_000, ranges: list[tuple[int, int]] | None = None):
        self.reads = record_ranges(reads, ranges) if ranges else batches(reads, n)
        row = self.reads.agg(F.coalesce(F.max("batch"), F.lit(0)), F.count("*")).first()
        self.last, self.rows = len(ranges) if ranges else int(row[0]), int(row[1])
        self.at, self.added, self.n = 0, 0, n
        self.ranges = ranges

    def take(self) -> DataFrame | None:
        if self.at >= self.last:
            return None
        self.at += 1
        if self.ranges is None:
            self.added = min(self.rows, self.at * self.n)
        else:
            self.added += self.ranges[self.at - 1][1] - self.ranges[self.at - 1][0] + 1
        return self.reads.where(F.col("batch") == self.at).drop("batch")

    def __iter__(self) -> Iterator[DataFrame]:
        while (batch := self.take()) is not None:
            yield batch

    def status(self) -> dict:
        return {"n": self.n, "current": self.at, "total": self.last}

    def progress(self) -> dict:
        """Records given out so far (of ranges, the numbers that they span), and those of all batches."""
        return {"added": min(self.added, self.rows), "records": self.rows, "buffer": self.rows - min(self.added, self.rows)}


class Sampler:
    """Samples of exactly n reads, a new one at each draw; fewer reads are all taken.

    A draw is one pass: each partition keeps the rows of least hash, at most n of them and, where the number of rows is
    known (`total`, or an earlier draw's count), only those below a hash that some more than n rows lie below.  What is
    kept is written, and the exact n are cut out of it.  If it is too little, because `total` was too large, the pass is
    done again with the number that it counted.
    """

    def __init__(self, reads: DataFrame, n: int = 1_000_000, ordered: bool = False, seed: int = 0, total: int | None = None):
        self.reads, self.n, self.ordered, self.seed, self.total = reads, n, ordered, seed, total
        self.draws = self.added = self.buffer = 0

    def draw(self, kept: list[str] | None = None) -> DataFrame:
        """kept: a list that learns the folder of the written rows, for sources.files.discard()."""
        self.seed += 1
        while True:
            rows, added, buffer = bottom_rows(self.reads, self.n, self.seed, self.total, kept)
            enough = buffer >= min(self.n, added)
            self.total = added
            if enough:
                break
        self.draws, self.added, self.buffer = self.draws + 1, self.added + added, min(self.n, added)
        out = exact_sample(rows, self.n, seed=self.seed)
        return out.orderBy("row_ix") if self.ordered else out

    def status(self) -> dict:
        """n, draws so far, rows seen by all of them (added), rows of the input (total) and of the last sample (buffer)."""
        return {"n": self.n, "current": self.draws, "added": self.added, "total": self.total or 0, "buffer": self.buffer}


def bottom_rows(df: DataFrame, n: int, seed: int, total: int | None = None, kept: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """Rows that hold the n of least hash (exact_sample's), written to the shared folder; rows seen, and rows written."""
    spark, seen, written = df.sparkSession, Observation(), Observation()
    slot = F.shiftrightunsigned(F.xxhash64("row_ix", F.lit(seed)), 11)
    rows = df.withColumn("_h", slot).observe(seen, F.count("*").alias("n"))
    if total:
        # Some six deviations more than n rows are expected below.
        rows = rows.where(F.col("_h") < F.lit(min(1.0, (n + 6 * n**0.5 + 40) / total) * (1 << 53)))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > 2 * n + 10_000:
                held = [_least(held, n)]
                size = held[0].num_rows
        if held:
            yield _least(held, n)

    folder = scratch_folder(spark)
    rows = rows.mapInArrow(least, rows.schema).drop("_h").observe(written, F.count("*").alias("n"))
    rows.write.parquet(folder)
    if kept is not None:
        kept.append(folder)
    return spark.read.schema(rows.schema).parquet(folder), seen.get["n"], written.get["n"]


def _least(held: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
    """The n rows of least hash, in their order."""
    table = pa.Table.from_batches(held).combine_chunks()
    if table.num_rows > n:
        h = table.column("_h").to_numpy()
        table = table.take(pa.array(np.sort(np.argpartition(h, n - 1)[:n]))) if n else table.slice(0, 0)
    return table.to_batches()[0] if table.num_rows else held[0].slice(0, 0)


class Handles(list):
    """Batches or samplers of several files, taken in turn; what each gives is known by its path."""

    def __init__(self, spark: SparkSession, paths: list[str], kind: type, n: int = 1_000_000, **options):
        from ..sources.fastq import read_fastq

        super().__init__(kind(read_fastq(spark, p), n, **options) for p in paths)
        self.paths = list(paths)

    def take(self) -> dict[str, DataFrame | None]:
        """The next batch or sample of each file; None where there is none left."""
        return {p: h.take() if hasattr(h, "take") else h.draw() for p, h in zip(self.paths, self)}

    def status(self) -> dict[str, dict]:
        return {p: h.status() for p, h in zip(self.paths, self)}


class Reader:
    """What batches and samplers have in common has nothing to yield itself."""

    def take(self):
        raise ReadsError("this class yields no reads", "InternalError")
