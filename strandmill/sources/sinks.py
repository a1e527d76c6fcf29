"""Writers: FASTQ and FASTA as distributed text, or as one file of a given name; and file-to-file filters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, InputError, one_of, warn
from .fastq import read_fastq
from .files import discard, is_local, scratch_folder


def fastq_record(full: bool = False) -> Column:
    """The four lines of a record, without the last line's end."""
    again = F.col("id") if full else F.lit("")
    return F.concat(F.lit("@"), "id", F.lit("\n"), "sread", F.lit("\n+"), again, F.lit("\n"), "qual")


def fasta_record() -> Column:
    return F.concat(F.lit(">"), "id", F.lit("\n"), "sread")


#: Records of a file that is written, where their number is known.
RECORDS = 1_000_000


def _dealt(reads: DataFrame, total: int | None) -> DataFrame:
    """Reads in the order of row_ix over partitions.  Where row_ix is known to end at `total`, a row's number tells its
    partition; else Spark samples the ranges, which computes the reads twice."""
    if total is None:
        return reads.repartitionByRange("row_ix").sortWithinPartitions("row_ix")
    parts = max(1, -(-total // RECORDS))
    return reads.repartitionById(parts, F.floor((F.col("row_ix") - 1) * parts / F.lit(max(1, total))).cast("int")).sortWithinPartitions("row_ix")


def write_records(reads: DataFrame, folder: str, record: Column, compress: bool = True, total: int | None = None) -> tuple[int, int]:
    """A folder of text files in the order of row_ix, in parallel; the numbers of records and of nucleotides, taken as they
    are written."""
    seen = Observation()
    out = _dealt(reads, total).observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.length("sread")), F.lit(0)).cast("bigint").alias("letters"))
    out.select(record.alias("value")).write.option("compression", "gzip" if compress else "none").text(folder)
    return seen.get["n"], seen.get["letters"]


def _one_file(reads: DataFrame, path: str, record: Column, mode: str, compress: bool, total: int | None = None) -> tuple[int, int]:
    """Tasks write parts to the folder that they share with the driver, which joins their bytes in order, as text or as
    members of a gzip file.  Parts that the driver does not find are an error."""
    one_of(mode, ("w", "a"), "mode")
    if not is_local(path):
        raise InputError(f"one file can be written to a local path only; use write_records() for '{path}'")
    if mode == "w" and os.path.exists(path):
        raise InputError(f"file '{path}' exists; use mode 'a' to append")
    spark, parts = reads.sparkSession, scratch_folder(reads.sparkSession)
    size = Observation()
    counts = Observation()
    rows = _dealt(reads, total).observe(counts, F.count("*").alias("n"), F.coalesce(F.sum(F.length("sread")), F.lit(0)).cast("bigint").alias("letters"))
    out = rows.select(record.alias("value")).observe(size, F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
    try:
        out.write.option("compression", "gzip" if compress else "none").text(parts)
        hadoop = spark._jvm.org.apache.hadoop
        where, conf = hadoop.fs.Path(parts), spark._jsc.hadoopConfiguration()
        system = where.getFileSystem(conf)
        names = sorted((f.getPath().getName(), f.getLen()) for f in system.listStatus(where) if f.getPath().getName().startswith("part-"))
        if not compress and sum(n for _, n in names) != size.get["bytes"]:
            raise InputError(f"parts of '{path}' are missing from '{parts}'; do driver and executors share it?")
        sink = spark._jvm.java.io.FileOutputStream(os.path.abspath(path), mode == "a")
        try:
            for name, _ in names:
                source = system.open(hadoop.fs.Path(where, name))
                hadoop.io.IOUtils.copyBytes(source, sink, 1 << 20, False)
                source.close()
        finally:
            sink.close()
    finally:
        discard(spark, [parts])
    return counts.get["n"], counts.get["letters"]


def write_fastq(reads: DataFrame, path: str, mode: str = "w", full: bool = False, compress: bool = True) -> int:
    """One FASTQ file, in order; the number of records.  No reads give an empty file."""
    return _one_file(reads, path, fastq_record(full), mode, compress)[0]


def write_fasta(reads: DataFrame, path: str, mode: str = "w", compress: bool = False) -> int:
    return _one_file(reads, path, fasta_record(), mode, compress)[0]


def filter_fastq(spark, files: list[str], destinations: list[str], keep: Callable[[DataFrame], DataFrame] | list | None = None, compress: bool = True) -> DataFrame:
    """Filter or trim files into others, which must not exist; several files may share a destination.

    Gives file, destination, reads, kept_reads, nucleotides and kept_nucleotides.
    """
    if keep is None:
        warn("without 'keep', files are copied", "ArgumentWarning")
    if len(files) % len(destinations):
        raise ArgumentMismatch("'destinations' must divide the files evenly")
    for d in set(destinations):
        if os.path.exists(d):
            raise InputError(f"destination '{d}' exists")
    rules = keep if isinstance(keep, list) else [keep] if keep else []
    rows = []
    for i, file in enumerate(files):
        to, counted = destinations[i % len(destinations)], []
        reads = kept = read_fastq(spark, file, counted=counted)
        for rule in rules:
            kept = rule(kept)
        stays = _one_file(kept, to, fastq_record(), "a" if os.path.exists(to) else "w", compress, counted[0])
        rows.append((file, to, counted[0], stays[0], _letters(reads) if rules else stays[1], stays[1]))
    return spark.createDataFrame(rows, "file string, destination string, reads bigint, kept_reads bigint, nucleotides bigint, kept_nucleotides bigint")


def _letters(reads: DataFrame) -> int:
    return reads.agg(F.coalesce(F.sum(F.length("sread")), F.lit(0))).first()[0]


def filter_folder(spark, source: str | list[str], destination: str, *rules: Callable[[DataFrame], DataFrame], compress: bool = True) -> DataFrame:
    """Filter or trim files of any number and size into a new folder of files, in parallel and in order: the form for a
    cluster.  Gives reads, kept_reads, nucleotides and kept_nucleotides."""
    counted: list[int] = []
    reads = kept = read_fastq(spark, source, counted=counted)
    for rule in rules:
        kept = rule(kept)
    stays = write_records(kept, destination, fastq_record(), compress, counted[0])
    return spark.createDataFrame([(counted[0], stays[0], _letters(reads) if rules else stays[1], stays[1])], "reads bigint, kept_reads bigint, nucleotides bigint, kept_nucleotides bigint")


def trim_files(spark, files: list[str], destinations: list[str], trim: Callable[..., DataFrame], compress: bool = True, **options) -> DataFrame:
    """A trim function applied file to file."""
    return filter_fastq(spark, files, destinations, lambda df: trim(df, **options), compress)
