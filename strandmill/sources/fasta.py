"""FASTA sequences and numeric quality files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ValidityError
from .files import file_names, located_lines, numbered


def _records(spark: SparkSession, files: list[str], join: str) -> DataFrame:
    """Records (file, file_no, line_no of the title as record, id, value) of '>' titles and the lines below them.

    Lines are numbered in place; each learns its title's number from the titles of its own file by a running maximum in
    blocks of lines, first over blocks and then within one.
    """
    lines = numbered(located_lines(spark, files), files).where("value <> '' and not value like ';%'")
    span = 10_000
    title = F.when(F.col("value").startswith(">"), F.col("line_no"))
    marked = lines.withColumn("title", title).withColumn("span", F.floor(F.col("line_no") / span))
    spans = marked.groupBy("file", "span").agg(F.max("title").alias("latest"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("file", "span", F.max("latest").over(before).alias("before"))
    upto = Window.partitionBy("file", "span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = marked.join(spans, ["file", "span"]).withColumn("record", F.coalesce(F.max("title").over(upto), "before"))
    body = F.when(F.col("title").isNull(), F.struct("line_no", "value"))
    parts = F.array_sort(F.collect_list(body))
    grouped = owned.where("record is not null").groupBy("file", "file_no", "record").agg(F.max(F.when(F.col("title").isNotNull(), F.substring("value", 2, 1 << 30))).alias("id"), parts.alias("parts"))
    return grouped.select("file", "file_no", "record", "id", F.array_join(F.transform("parts", lambda p: p["value"]), join).alias("value"))


def _placed(records: DataFrame, skip: int, limit: int) -> DataFrame:
    """row_ix from 1 over all files, and from 1 in each as `nth`, by counts of stretches and files; `skip` records of each
    file are left out and at most `limit` kept."""
    span = 100_000
    marked = records.withColumn("span", F.floor(F.col("record") / span))
    counts = marked.groupBy("file", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.greatest(F.col("n") - skip, F.lit(0))
    totals = marked.groupBy("file", "file_no").agg(F.count("*").alias("n")).withColumn("kept", F.least(kept, F.lit(limit)) if limit >= 0 else kept)
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("kept").over(earlier), F.lit(0)).alias("ahead"))
    counts = counts.select("file", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(F.broadcast(totals), "file")
    place = F.col("before") + F.row_number().over(Window.partitionBy("file", "span").orderBy("record"))
    out = marked.join(counts, ["file", "span"]).withColumn("nth", place.cast("bigint") - skip).where("nth > 0")
    out = out.where(F.col("nth") <= limit) if limit >= 0 else out
    return out.withColumn("row_ix", F.col("ahead") + F.col("nth"))


def read_fasta(spark: SparkSession, path: str | list[str], pattern: str | None = None, limit: int = -1, skip: int = 0) -> DataFrame:
    """Sequences (file, row_ix, id, sread); limit and skip hold for each file."""
    records = _placed(_records(spark, file_names(path, pattern), ""), skip, limit)
    return records.select("file", "row_ix", "id", F.translate(F.upper(F.regexp_replace("value", "\\s", "")), ".", "-").alias("sread"))


def read_quality(spark: SparkSession, path: str | list[str], pattern: str | None = None, limit: int = -1, skip: int = 0) -> DataFrame:
    """Qualities (file, row_ix, id, qual) from files of numbers, as characters from 33 on."""
    records = _placed(_records(spark, file_names(path, pattern), " "), skip, limit)
    codes = F.transform(F.filter(F.split("value", "\\s+"), lambda x: x != ""), lambda x: F.char(x.cast("int") + 33))
    return records.select("file", "row_ix", "id", F.array_join(codes, "").alias("qual"))


def read_fasta_quality(spark: SparkSession, sequences: str | list[str], qualities: str | list[str], sequence_pattern: str | None = None, quality_pattern: str | None = None) -> DataFrame:
    """Reads from sequence and quality files; an error if widths or ids differ.

    The k-th sequence of a name gets the k-th quality of that name, so files in the same order are joined by place.
    """
    a, b = read_fasta(spark, sequences, sequence_pattern), read_quality(spark, qualities, quality_pattern)
    name = F.regexp_extract("id", r"^(\S+)", 1)
    turn = F.row_number().over(Window.partitionBy("name").orderBy("row_ix"))
    a, b = (df.withColumn("name", name).withColumn("turn", turn) for df in (a, b))
    joined = a.join(b.select("name", "turn", "qual"), ["name", "turn"], "full")
    bad = joined.where("sread is null or qual is null or length(sread) <> length(qual)").limit(1)
    if bad.count():
        raise ValidityError("sequences and qualities do not agree")
    return joined.select("file", "row_ix", "id", "sread", "qual")
