"""Column text formats: typed columns of any delimited file, base calls with probabilities, and quality matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, ValidityError, one_of
from .files import file_names, located_lines, numbered

_DNA = "dna"


def dna(c) -> Column:
    return F.translate(F.upper(c), ".", "-")


def fields(spark: SparkSession, files: list[str] | DataFrame, sep: str, n: int | None = None, comment: str = "#") -> DataFrame:
    """Lines (file, file_no, line_no, row_ix, f) split at any character of `sep` ('' is any white space); comments are left
    out.  row_ix is a line's number over all files, line_no that in its own.

    n: the last of n fields takes what is left.  files may be such a table of lines already.
    """
    if isinstance(files, DataFrame):
        return files
    lines = numbered(located_lines(spark, files), files).where(F.trim("value") != "")
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    value = F.regexp_replace("value", "\r$", "")
    pattern = "\\s+" if sep == "" else "[" + "".join(f"\\x{ord(x):02x}" for x in sep) + "]"
    value = F.trim(value) if sep == "" else value
    return lines.select("file", "file_no", "line_no", F.col("place").alias("row_ix"), F.split(value, pattern, -1 if n is None else n).alias("f"))


def field(k: int, kind: str = "string") -> Column:
    """The k-th field from 1; empty ones are null in all but string columns."""
    c = F.get("f", F.lit(k - 1))
    if kind == "string":
        return c
    if kind == _DNA:
        return dna(c)
    return F.try_cast(F.nullif(F.trim(c), F.lit("")), kind) if hasattr(F, "try_cast") else F.nullif(F.trim(c), F.lit("")).try_cast(kind)


def read_columns(spark: SparkSession, path: str | list[str], columns: dict[str, str | None], pattern: str | None = None, limit: int = -1, skip: int = 0, sep: str = "\t", header: bool = False, comment: str = "#") -> DataFrame:
    """Typed columns by name; a type of None skips one.  skip and header hold for each file, limit for all together."""
    first = skip + (1 if header else 0)
    rows = fields(spark, file_names(path, pattern), sep, None, comment)
    if first:
        rows = rows.where(F.col("line_no") > first)
    picked = [field(k, t).alias(c) for k, (c, t) in enumerate(columns.items(), 1) if t is not None]
    out = rows.select("file", "row_ix", *picked)
    return out.orderBy("row_ix").limit(limit) if limit >= 0 else out


def read_qseq(spark: SparkSession, path: str | list[str], pattern: str | None = None, filtered: bool = False, as_reads: bool = True) -> DataFrame:
    """Eleven tab-separated columns; `filtered` keeps reads that passed.  Qualities are phred64."""
    names = {"machine": "string", "run": "int", "lane": "int", "tile": "int", "x": "int", "y": "int", "index": "string", "read_number": "int", "sread": _DNA, "qual": "string", "filter": "int"}
    rows = read_columns(spark, path, names, pattern, comment="")
    if filtered:
        rows = rows.where("filter = 1")
    if as_reads:
        name = F.concat_ws(":", "machine", "run", "lane", "tile", "x", "y")
        return rows.select("file", "row_ix", name.alias("id"), "sread", "qual")
    return rows.drop("filter") if filtered else rows.withColumn("filter", F.when(F.col("filter") == 1, "Y").otherwise("N"))


def read_prb(spark: SparkSession, path: str | list[str], pattern: str | None = None, kind: str = "phred64") -> DataFrame:
    """Four scores for each cycle: the largest as characters (phred64, phred33) or numbers (integer), or all (array)."""
    return _scores(spark, path, pattern, kind).drop("line_no")


def _scores(spark: SparkSession, path: str | list[str], pattern: str | None, kind: str) -> DataFrame:
    one_of(kind, ("phred64", "phred33", "integer", "array"), "kind")
    rows = fields(spark, file_names(path, pattern), "\t")
    cycles = F.transform("f", lambda c: F.transform(F.split(F.trim(c), "\\s+"), lambda x: x.cast("int")))
    if kind == "array":
        return rows.select("file", "row_ix", "line_no", cycles.alias("scores"))
    best = F.transform(cycles, lambda c: F.array_max(c))
    if kind == "integer":
        least, most = rows.agg(F.min(F.size("f")), F.max(F.size("f"))).first()
        if least != most:
            raise InputError(f"records have from {least} to {most} cycles, but numbers need one width")
        return rows.select("file", "row_ix", "line_no", best.alias("scores"))
    return rows.select("file", "row_ix", "line_no", F.array_join(F.transform(best, lambda s: F.char(s + (64 if kind == "phred64" else 33))), "").alias("qual"))


def read_base_quality(spark: SparkSession, folder: str, sequence_pattern: str = "_seq.txt", prb_pattern: str = "_prb.txt", kind: str = "phred64") -> DataFrame:
    """Sequences in the fifth column of one kind of file, with the qualities of another, by place."""
    seqs, prbs = file_names(folder, sequence_pattern), file_names(folder, prb_pattern)
    if len(seqs) != len(prbs):
        raise InputError(f"{len(seqs)} sequence files, but {len(prbs)} files of scores")
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), f"({sequence_pattern}|{prb_pattern}).*$", "")
    a = fields(spark, seqs, "\t").select(stem("file").alias("stem"), "file", "line_no", "row_ix", dna(F.get("f", F.lit(4))).alias("sread"))
    b = _scores(spark, prbs, None, kind).select(stem("file").alias("stem"), "line_no", "qual")
    out = a.join(b, ["stem", "line_no"], "full")
    if out.where("sread is null or qual is null").limit(1).count():
        raise ValidityError("sequences and scores differ in their rows")
    return out.select("file", "row_ix", F.col("line_no").cast("string").alias("id"), "sread", "qual")


def read_intensity_text(spark: SparkSession, intensities: str | list[str], errors: str | list[str] | None = None, pattern: str | None = None, error_pattern: str | None = None) -> DataFrame:
    """lane, tile, x, y and four values for each cycle, tab-separated; errors of the same shape are joined by file and line."""

    def read(path, pattern, name) -> DataFrame:
        rows = fields(spark, file_names(path, pattern), "\t")
        cycles = F.transform(F.filter(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), lambda c: F.trim(c) != ""), lambda c: F.transform(F.split(F.trim(c), "\\s+"), lambda x: x.cast("double")))
        return rows.select("file_no", "line_no", "row_ix", *[field(k, "int").alias(c) for k, c in enumerate(("lane", "tile", "x", "y"), 1)], cycles.alias(name))

    a = read(intensities, pattern, "intensity")
    if errors is None:
        return a.drop("file_no", "line_no")
    keys = ["lane", "tile", "x", "y", "file_no", "line_no"]
    out = a.join(read(errors, error_pattern, "error").drop("row_ix"), keys, "full")
    if out.where("intensity is null or error is null or size(intensity) <> size(error)").limit(1).count():
        raise ValidityError("intensities and errors differ in their rows or cycles")
    return out.drop("file_no", "line_no")
