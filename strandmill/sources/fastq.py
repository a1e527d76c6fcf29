"""FASTQ: four lines a record, plain or compressed, read without moving the text.

Spark's text reader splits plain files; the number of lines before each split, counted first, tells where in a record
the split begins.  Records within a split are assembled from strided columns of lines; the few lines at its edges are
brought together by record number.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, raised, warn
from ..functions.quality import infer_encoding
from ..schema import DNA
from .files import Places, data_files, file_names, located_lines, renumbered
from .ranges import open_at, tasks

_FIELDS = "file string, row_ix bigint, part int, id string, sread string, plus string, qual string"


def read_fastq(spark: SparkSession, path: str | list[str], pattern: str | None = None, with_ids: bool = True, keep=None, names: bool = True, counted: list[int] | None = None) -> DataFrame:
    """Reads (file, row_ix, id, sread, qual) of all matching files; row_ix counts from 1 over all of them, in
    the order of the paths given.  counted: a list that learns the number of records, which are counted now in any case.

    The third line is ignored; dots in sequences become dashes, letters are raised.  A file whose last record is not
    whole, an empty id line, or a sequence and qualities of different widths are errors.  keep: a filter that is applied to
    the reads.
    """
    reads = _records(spark, file_names(path, pattern) if names else path, True, counted)
    title = F.when(F.length(F.rtrim("id")) == 0, raised(InputError, "unexpected empty line in file ", F.col("file"))).otherwise(F.substring(F.rtrim("id"), 2, 1 << 30))
    wide = raised(InputError, "sequence and quality differ in width in file ", F.col("file"), ", record ", F.col("row_ix").cast("string"))
    qual = F.when(F.length(_tidy("qual")) != F.length(_tidy("sread")), wide).otherwise(_tidy("qual"))
    out = reads.select("file", "row_ix", (title if with_ids else F.lit("")).alias("id"), _bases().alias("sread"), qual.alias("qual"))
    return keep(out) if keep else out


def read_fastq_aside(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads as read_fastq() gives them but for malformed records, and these: (file, record in the file, row_ix, reason, lines).

    A lost or added line moves all records behind it in its file, which then are malformed too.
    """
    rows = _records(spark, file_names(path, pattern), False)
    reason = (
        F.when(F.col("id").isNull() | F.col("sread").isNull() | F.col("plus").isNull() | F.col("qual").isNull(), "record is not whole")
        .when(F.length(F.rtrim("id")) == 0, "empty id line").when(~F.col("id").startswith("@"), "id line does not begin with @").when(~F.col("plus").startswith("+"), "third line does not begin with +")
        .when(F.length(_tidy("sread")) != F.length(_tidy("qual")), "sequence and quality differ in width").when(~F.upper(_tidy("sread")).rlike(f"^[{re.escape(DNA)}]*$"), "letter of no nucleotide")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select("file", "row_ix", F.substring(F.rtrim("id"), 2, 1 << 30).alias("id"), _bases().alias("sread"), _tidy("qual").alias("qual"))
    lines = F.concat_ws("\n", "id", "sread", "plus", "qual")
    bad = rows.where("reason is not null").select("file", "row_ix", "reason", lines.alias("lines"))
    firsts = rows.groupBy("file").agg(F.min("row_ix").alias("_first"))
    return good, bad.join(F.broadcast(firsts), "file").select("file", (F.col("row_ix") - F.col("_first") + 1).alias("record"), "row_ix", "reason", "lines")


def _tidy(c: str) -> Column:
    return F.regexp_replace(c, "[\\r\\s]+$", "")


def _bases() -> Column:
    return F.translate(F.upper(_tidy("sread")), ".", "-")


def _records(spark: SparkSession, files: str | list[str], whole: bool, counted: list[int] | None = None) -> DataFrame:
    """The four lines of each record (file, row_ix, id, sread, plus, qual) as they are.  whole: a file that ends within one is
    an error; else that record has nulls."""
    lines = located_lines(spark, files)
    places = Places(lines, files, 4)
    for file, n in places.totals().items():
        if n % 4 and whole:
            raise InputError(f"unexpected number of lines in file '{file}'")
    if counted is not None:
        counted.append(sum(n // 4 for n in places.totals().values()))
    before = spark.sparkContext.broadcast(places)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, rest = None, 0, pa.array([], pa.string())
        for file, block, begin, part in before.value.walk(batches):
            if (file, block) != key:
                if len(rest):
                    yield from _edges(key, at, rest)
                key, at, rest = (file, block), begin, rest[:0]
            values = pa.concat_arrays([rest, part.column("value")]) if len(rest) else part.column("value")
            head = min(-at % 4, len(values))
            if head:
                yield from _edges(key, at, values[:head])
            full = (len(values) - head) // 4
            if full:
                take = lambda k: values.take(pa.array(head + k + 4 * np.arange(full)))
                ix = pa.array((at + head) // 4 + 1 + np.arange(full), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * full), ix, pa.nulls(full, pa.int32()), *(take(k) for k in range(4))], _names())
            at += head + 4 * full
            rest = values[head + 4 * full :]
        if len(rest):
            yield from _edges(key, at, rest)

    pieces = lines.mapInArrow(assemble, _FIELDS)
    cols = ["file", "row_ix", "id", "sread", "plus", "qual"]
    edges = pieces.where("part is not null").groupBy("file", "row_ix").agg(*[F.max(c).alias(c) for c in cols[2:]])
    return pieces.where("part is null").select(*cols).unionByName(edges.select(*cols))


def _names() -> list[str]:
    return ["file", "row_ix", "part", "id", "sread", "plus", "qual"]


def _edges(key: tuple, at: int, values: pa.Array) -> Iterator[pa.RecordBatch]:
    """Lines of records that another split completes, each in its own row."""
    n = len(values)
    part = [(at + i) % 4 for i in range(n)]
    text = values.to_pylist()
    cols = [pa.array([x if p == k else None for p, x in zip(part, text)], pa.string()) for k in range(4)]
    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([(at + i) // 4 + 1 for i in range(n)], pa.int64()), pa.array(part, pa.int32()), *cols], _names())


def read_with_encoding(spark: SparkSession, path: str | list[str], pattern: str | None = None, encoding: str = "auto", **options) -> tuple[DataFrame, str]:
    """Reads, and the encoding of their qualities: given, or inferred from the first of them."""
    reads = read_fastq(spark, path, pattern, **options)
    return reads, infer_encoding(reads) if encoding == "auto" else encoding


def count_fastq(spark: SparkSession, path: str | list[str], pattern: str | None = None, spanning: bool = False) -> DataFrame:
    """Records, nucleotides and scores of each file.  spanning: sequences may span lines."""
    from ..operators.summaries import count_reads

    return count_reads(read_fastq_spanning(spark, path, pattern) if spanning else read_fastq(spark, path, pattern, with_ids=False))


def read_fastq_spanning(spark: SparkSession, path: str | list[str], pattern: str | None = None, block: int = 8 << 20) -> DataFrame:
    """Reads of files whose sequences and qualities may span lines; row_ix as read_fastq() has it.

    Only from its beginning can such a file be told apart into records, so each file is one task, which streams over it.
    """
    from ..streaming.fastq import parse_records

    files = data_files(path, pattern)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, file in zip(batch.column("k").to_pylist(), batch.column("file").to_pylist()):
                row, data = 0, b""
                with open_at(file) as raw:
                    zipped = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    f = gzip.GzipFile(fileobj=raw) if zipped else raw
                    while True:
                        more = f.read(block)
                        data += more
                        if not more and data and not data.endswith(b"\n"):
                            data += b"\n"
                        found, size = parse_records(data, 1 << 60)
                        data = data[size:]
                        for at in range(0, len(found), 10_000):
                            some = found[at : at + 10_000]
                            number = pa.array(range(row + 1, row + 1 + len(some)), pa.int64())
                            row += len(some)
                            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array([file] * len(some)), number, *(pa.array(c, pa.string()) for c in zip(*some))], ["file_no", "file", "row_ix", "id", "sread", "qual"])
                        if not more:
                            break
                if data.strip():
                    raise InputError(f"'{file}' ends within a record")

    rows = tasks(spark, list(enumerate(files)), "k int, file string").mapInArrow(parse, "file_no int, file string, row_ix bigint, id string, sread string, qual string")
    return renumbered(rows, "file_no").drop("file_no")


class FastqFile:
    """A path to read from, count or write to."""

    def __init__(self, path: str):
        self.path = path

    def read(self, spark: SparkSession, pattern: str | None = None, **options) -> DataFrame:
        if pattern is not None:
            warn("'pattern' is ignored when a file is given", "ArgumentWarning")
        return read_fastq(spark, self.path, **options)

    def count(self, spark: SparkSession) -> DataFrame:
        return count_fastq(spark, self.path)

    def write(self, reads: DataFrame, **options) -> int:
        from .sinks import write_fastq

        return write_fastq(reads, self.path, **options)


class FastqFileList(list):
    """Several files as one input."""

    def __init__(self, *paths: str):
        super().__init__(FastqFile(p) for p in paths)

    def read(self, spark: SparkSession, **options) -> DataFrame:
        return read_fastq(spark, [f.path for f in self], **options)
