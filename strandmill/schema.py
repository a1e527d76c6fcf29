"""Schemas of reads and alignments, and checks that rows agree with them.

Rows have no order of their own in Spark, so tables carry row_ix, the row's place in its file.  Qualities are strings
of characters at an offset: 33 (phred33) or 64 (phred64).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import IncompatibleTypes, ValidityError

READS = T.StructType([T.StructField(n, T.LongType() if n == "row_ix" else T.StringType()) for n in ("file", "row_ix", "id", "sread", "qual")])
ALIGNMENTS = T.StructType([*READS, T.StructField("chromosome", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("strand", T.StringType()), T.StructField("align_quality", T.DoubleType())])
#: The letters of nucleotide sequences, and the strands in their order.
DNA = "ACGTMRWSYKVHDBN-+."
STRANDS = ("+", "-", "*")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise IncompatibleTypes(f"the table has no column {', '.join(missing)}")
    return df


def invalid_rows(df: DataFrame) -> DataFrame:
    """Rows whose read and quality differ in width, or whose read has letters that no nucleotide alphabet knows."""
    bad = ~F.col("sread").rlike("^[ACGTMRWSYKVHDBN.+-]*$")
    if "qual" in df.columns:
        bad = bad | (F.length("sread") != F.length("qual"))
    if "strand" in df.columns:
        bad = bad | ~F.col("strand").isin(*STRANDS)
    return df.where(F.coalesce(bad, F.lit(False)))


def validated(df: DataFrame) -> DataFrame:
    """The table, if all rows are valid; a check that reads it once."""
    found = invalid_rows(df).limit(3).collect()
    if found:
        raise ValidityError(f"invalid rows, such as {[r.asDict() for r in found]}")
    return df


def as_reads(df: DataFrame) -> DataFrame:
    """Lower-case letters raised; without ids or a file, empty ones."""
    require(df, "row_ix", "sread")
    extra = {"sread": F.upper("sread")}
    for c in ("file", "id"):
        if c not in df.columns:
            extra[c] = F.lit("")
    return df.withColumns(extra)


def labelled(df: DataFrame, **labels: str) -> DataFrame:
    """Describe columns in their metadata."""
    return df.select(*[F.col(c).alias(c, metadata={"labelDescription": labels[c]}) if c in labels else F.col(c) for c in df.columns])


def labels_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["labelDescription"] for f in df.schema if "labelDescription" in f.metadata}


def renew(df: DataFrame, **columns) -> DataFrame:
    """The table with columns replaced; they must exist, and rows must stay valid."""
    require(df, *columns)
    return validated(df.withColumns({k: v if hasattr(v, "alias") else F.lit(v) for k, v in columns.items()}))


def renewable(df: DataFrame) -> dict[str, str]:
    """Columns that renew() can replace, with their types."""
    return dict(df.dtypes)


def detail(df: DataFrame) -> dict:
    """Rows and range of widths."""
    row = df.agg(F.count("*").alias("length"), F.min(F.length("sread")).alias("least"), F.max(F.length("sread")).alias("most")).first()
    return {"columns": df.columns, "length": row["length"], "width": (row["least"], row["most"])}


def reads_of(spark: SparkSession, sread: list[str], qual: list[str] | None = None, id: list[str] | None = None, encoding: str = "auto", keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, str | None]:
    """A reads table from columns, and the encoding of its qualities: given, or inferred from them.  keep: a filter that is
    applied to the table; columns of different lengths, and rows of different widths, are errors."""
    from .functions.quality import infer_encoding, offset

    n = len(sread)
    if any(c is not None and len(c) != n for c in (qual, id)):
        raise IncompatibleTypes("columns differ in their lengths")
    columns = {"row_ix": pa.array(range(1, n + 1), pa.int64()), "id": pa.array(id or [""] * n, pa.string()), "sread": pa.array(sread, pa.string())}
    if qual is not None:
        columns["qual"] = pa.array(qual, pa.string())
    reads = validated(as_reads(spark.createDataFrame(pa.table(columns))))
    if qual is None:
        encoding = None
    elif encoding == "auto":
        encoding = infer_encoding(reads)
    else:
        offset(encoding)
    return keep(reads) if keep else reads, encoding


def show(df: DataFrame) -> str:
    """A table in a few lines: kind, rows, range of widths, columns."""
    found = detail(df)
    least, most = found["width"]
    width = "none" if least is None else f"{least} cycles" if least == most else f"{least}..{most} cycles"
    kind = "alignments" if "position" in df.columns else "reads with qualities" if "qual" in df.columns else "reads"
    lines = [f"{kind}: {found['length']} rows; width: {width}"]
    if kind == "alignments":
        strands = {r[0]: r[1] for r in df.groupBy("strand").agg(F.count("*")).collect()}
        chromosomes = df.select("chromosome").distinct().orderBy("chromosome").limit(4).collect()
        named = [str(r[0]) for r in chromosomes if r[0] is not None]
        lines += ["chromosomes: " + " ".join(named[:3]) + (" ..." if len(named) > 3 else ""), "strands: " + " ".join(f"{k or 'none'} {strands[k]}" for k in sorted(strands, key=lambda k: k or "~"))]
    return "\n".join([*lines, "columns: " + " ".join(df.columns)])
