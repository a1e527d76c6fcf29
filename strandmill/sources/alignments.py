"""Text formats of alignments, each to one schema: reads with chromosome, position (from 1), strand, align_quality, and
the format's own columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, one_of, raised
from ..functions.sequence import reverse_complement
from .delimited import dna, field, fields
from .files import file_names

FORMATS: dict[str, Callable] = {}


def register(*names: str):
    def add(f: Callable) -> Callable:
        FORMATS.update({n: f for n in names})
        return f

    return add


def forward(c: Column) -> Column:
    """F and R as + and -; anything else is unknown."""
    return F.when(c == "F", "+").when(c == "R", "-")


def signed(c: Column) -> Column:
    """+ and - as they are, nothing as unknown; anything else is an error."""
    return F.when(c.isin("+", "-"), c).when(c.isNull() | (c == ""), F.lit(None)).otherwise(raised(InputError, "unknown strand: ", c))


def _checked(rows: DataFrame, n: int) -> DataFrame:
    wrong = raised(InputError, "wrong number of fields in ", F.col("file"), ", line ", F.col("line_no").cast("string"))
    return rows.withColumn("f", F.when(F.size("f") == n, F.col("f")).otherwise(wrong))


def _turned(df: DataFrame) -> DataFrame:
    """Minus-strand reads as they were sequenced."""
    minus = F.col("strand") == "-"
    return df.withColumns({"sread": F.when(minus, reverse_complement("sread")).otherwise(F.col("sread")), "qual": F.when(minus, F.reverse("qual")).otherwise(F.col("qual"))})


@register("export")
def _export(spark, files, with_id=False, with_index=False, with_pair=False, with_all=False, comment="#") -> DataFrame:
    with_id, with_index, with_pair = with_id or with_all, with_index or with_all, with_pair or with_all
    rows = _checked(fields(spark, files, "\t", comment=comment), 22)
    place = F.concat_ws(":", F.concat_ws("_", field(1), field(2)), *[field(k) for k in (3, 4, 5, 6)])
    index = F.when(field(7) != "", F.concat(F.lit("#"), field(7))).otherwise(F.lit(""))
    pair = F.when(field(8) != "", F.concat(F.lit("/"), field(8))).otherwise(F.lit(""))
    name = F.concat(place, index if with_index else F.lit(""), pair if with_pair else F.lit(""))
    extra = [field(7).alias("multiplex_index")] * with_index + [field(8, "int").alias("paired_read_number")] * with_pair
    return rows.select(
        "file", "row_ix", (name if with_id else F.lit("")).alias("id"), field(9, "dna").alias("sread"), field(10).alias("qual"), F.nullif(field(11), F.lit("")).alias("chromosome"),
        field(13, "int").alias("position"), forward(field(14)).alias("strand"), field(16, "double").alias("align_quality"),
        field(2).alias("run"), field(3, "int").alias("lane"), field(4, "int").alias("tile"), field(5, "int").alias("x"), field(6, "int").alias("y"), field(22).alias("filtering"), F.nullif(field(12), F.lit("")).alias("contig"), *extra,
    )


@register("align", "prealign", "realign")
def _realign(spark, files) -> DataFrame:
    rows = fields(spark, files, "")
    colon = F.instr(field(4), ":")
    return rows.select(
        "file", "row_ix", F.lit("").alias("id"), field(1, "dna").alias("sread"), F.repeat(F.lit(" "), F.length(field(1))).alias("qual"),
        F.when(colon > 0, F.substring_index(field(4), ":", 1)).alias("chromosome"), F.when(colon > 0, F.substring(field(4), colon + 1, F.length(field(4)))).otherwise(field(4)).try_cast("int").alias("position"),
        forward(field(5)).alias("strand"), field(2, "double").alias("align_quality"), field(3, "int").alias("n_match"), field(7, "int").alias("next_best_align_quality"),
    )


@register("result")
def _result(spark, files) -> DataFrame:
    rows = fields(spark, files, "\t")
    own = {"match_code": (3, "string"), "n_exact_match": (4, "int"), "n_one_mismatch": (5, "int"), "n_two_mismatch": (6, "int"), "n_treatment": (10, "string"), "mismatch_one": (11, "string"), "mismatch_two": (12, "string")}
    return rows.select(
        "file", "row_ix", F.lit("").alias("id"), field(2, "dna").alias("sread"), F.repeat(F.lit(" "), F.length(field(2))).alias("qual"), F.nullif(field(7), F.lit("")).alias("chromosome"),
        field(8, "int").alias("position"), forward(field(9)).alias("strand"), F.lit(None).cast("double").alias("align_quality"), *[field(k, t).alias(c) for c, (k, t) in own.items()],
    )


@register("mapview")
def _mapview(spark, files) -> DataFrame:
    rows = _checked(fields(spark, files, "\t", comment=""), 16)
    own = {"n_mismatch_best": 10, "mismatch_quality": 11, "n_exact_match_24": 12, "n_one_mismatch_24": 13}
    return rows.select(
        "file", "row_ix", field(1).alias("id"), field(15, "dna").alias("sread"), field(16).alias("qual"), field(2).alias("chromosome"), field(3, "int").alias("position"),
        signed(field(4)).alias("strand"), field(7, "double").alias("align_quality"), *[field(k, "int").alias(c) for c, k in own.items()],
    )


@register("bowtie")
def _bowtie(spark, files) -> DataFrame:
    rows = fields(spark, files, "\t", comment="")
    return _turned(rows.select(
        "file", "row_ix", field(1).alias("id"), field(5, "dna").alias("sread"), field(6).alias("qual"), field(3).alias("chromosome"), (field(4, "int") + 1).alias("position"),
        signed(field(2)).alias("strand"), F.lit(None).cast("double").alias("align_quality"), field(7, "int").alias("similar"), F.coalesce(field(8), F.lit("")).alias("mismatch"),
    ))


@register("soap")
def _soap(spark, files) -> DataFrame:
    rows = fields(spark, files, "\t", 11, comment="")
    return _turned(rows.select(
        "file", "row_ix", field(1).alias("id"), field(2, "dna").alias("sread"), field(3).alias("qual"), field(8).alias("chromosome"), field(9, "int").alias("position"), signed(field(7)).alias("strand"),
        F.lit(None).cast("double").alias("align_quality"), field(4, "int").alias("n_equally_best"), field(5).alias("paired_end"), field(6, "int").alias("aligned_length"), field(10, "int").alias("type_of_hit"), F.coalesce(field(11), F.lit("")).alias("hit_detail"),
    ))


@register("maq", "maq_short")
def _maq(spark, files, limit=-1, short=False) -> DataFrame:
    from .binary import read_maq

    return read_maq(spark, files, limit, short)


#: Encoding of the qualities in each format.
ENCODINGS = {"export": "phred64", "align": "phred64", "prealign": "phred64", "realign": "phred64", "result": "phred64", "mapview": "phred33", "bowtie": "phred33", "soap": "phred64", "maq": "phred33", "maq_short": "phred33"}


def read_aligned(spark: SparkSession, path: str | list[str], pattern: str | None = None, kind: str = "export", keep=None, **options) -> DataFrame:
    """Alignments of a format; a filter is part of the plan, so Spark can push it down."""
    one_of(kind, FORMATS, "kind")
    if kind == "maq_short":
        options["short"] = True
    out = FORMATS[kind](spark, file_names(path, pattern), **options)
    return keep(out) if keep else out


#: Of each text format: how lines are split, how many fields they have, and which of them is the position and the strand.
LINES = {
    "export": ("\t", None, "#", (22, 22), 13, None), "align": ("", None, "#", (3, 7), None, None), "prealign": ("", None, "#", (3, 7), None, None), "realign": ("", None, "#", (3, 7), None, None),
    "result": ("\t", None, "#", (9, 12), 8, None), "mapview": ("\t", None, "", (16, 16), 3, 4), "bowtie": ("\t", None, "", (7, 8), 4, 2), "soap": ("\t", 11, "", (10, 11), 9, 7),
}


def read_aligned_aside(spark: SparkSession, path: str | list[str], pattern: str | None = None, kind: str = "export", **options) -> tuple[DataFrame, DataFrame]:
    """Alignments as read_aligned() gives them but for malformed lines, and these: (file, line, row_ix, reason, value)."""
    one_of(kind, LINES, "kind")
    sep, n, comment, (least, most), position, strand = LINES[kind]
    rows = fields(spark, file_names(path, pattern), sep, n, comment)
    reason = F.when(~F.size("f").between(least, most), "wrong number of fields")
    if position is not None:
        reason = reason.when((F.trim(field(position)) != "") & field(position, "int").isNull(), "position is no number")
    if strand is not None:
        reason = reason.when(~field(strand).isin("+", "-", ""), "unknown strand")
    rows = rows.withColumn("reason", reason)
    bad = rows.where("reason is not null").select("file", F.col("line_no").alias("line"), "row_ix", "reason", F.array_join("f", sep or " ").alias("value"))
    return FORMATS[kind](spark, rows.where("reason is null").drop("reason"), **options), bad


def mismatch_scores(alignments: DataFrame, encoding: str = "phred33") -> DataFrame:
    """Mismatches listed as place:change or place, with `n_mismatch` and the sum of the qualities there (null if none)."""
    from ..functions.quality import offset

    places = F.transform(F.filter(F.split("mismatch", ","), lambda x: x != ""), lambda x: F.substring_index(x, ":", 1).cast("int"))
    score = F.aggregate(F.transform(places, lambda p: F.ascii(F.substring(F.col("qual"), p + 1, F.lit(1))) - offset(encoding)), F.lit(0), lambda a, x: a + x)
    return alignments.withColumn("n_mismatch", F.size(places)).withColumn("mismatch_score", F.when(F.size(places) > 0, score))
