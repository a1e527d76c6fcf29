"""Reads and alignments derived from the orders table, in Spark and in SQL: the same rows for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, BASES, QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGN", "#&)+-/1357:<>@BF"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_ix, id, sread, qual, lane, tile, chromosome, strand, position, align_quality."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    key, width = F.col("o_orderkey"), (20 + F.col("o_custkey") % 13).cast("int")
    text = lambda c, to: F.substring(F.translate(F.md5(c), HEX, to), F.lit(1), width)
    return o.select(
        key.alias("row_ix"),
        F.concat(F.lit("r"), key.cast("string")).alias("id"),
        text((F.col("o_custkey") % 400).cast("string"), BASES).alias("sread"),
        text(F.concat(F.lit("q"), key.cast("string")), QUALITIES).alias("qual"),
        F.concat(F.lit("lane"), (F.col("o_custkey") % 4).cast("string")).alias("lane"),
        (F.col("o_custkey") % 8 + 1).cast("int").alias("tile"),
        F.when(key % 17 != 0, F.col("o_orderpriority")).alias("chromosome"),
        F.when(key % 2 == 0, "+").otherwise("-").alias("strand"),
        F.when(key % 19 != 0, (key % 500 + 1).cast("int")).alias("position"),
        (key % 40).cast("double").alias("align_quality"),
    )


READS = """reads AS (SELECT o_orderkey AS row_ix, concat('r', CAST(o_orderkey AS varchar)) AS id,
    substring(translate(md5(CAST(o_custkey % 400 AS varchar)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, CAST(20 + o_custkey % 13 AS int)) AS sread,
    substring(translate(md5(concat('q', CAST(o_orderkey AS varchar))), '0123456789abcdef', '#&)+-/1357:<>@BF'), 1, CAST(20 + o_custkey % 13 AS int)) AS qual,
    concat('lane', CAST(o_custkey % 4 AS varchar)) AS lane, CAST(o_custkey % 8 + 1 AS int) AS tile,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS chromosome, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey % 500 AS int) + 1 END AS position, CAST(o_orderkey % 40 AS double) AS align_quality FROM orders)"""
#: Each read's letters and qualities by cycle.
CYCLES = READS + """, cycles AS (SELECT row_ix, lane, i AS cycle, substring(sread, i, 1) AS base, substring(qual, i, 1) AS quality
    FROM reads, (SELECT CAST(unnest(range(1, 33)) AS int) AS i) WHERE i <= length(sread))"""


def ranges(spark: SparkSession) -> DataFrame:
    """Every tenth stretch of five bases on each chromosome."""
    names = spark.createDataFrame([(c,) for c in CHROMOSOMES], "chromosome string")
    starts = F.sequence(F.lit(40), F.lit(480), F.lit(88))
    return names.select("chromosome", F.posexplode(starts).alias("n", "start")).select("chromosome", "n", F.col("start").cast("int").alias("start"), (F.col("start") + 4).cast("int").alias("end"))


CHROMOSOMES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
RANGES = """spans AS (SELECT chromosome, CAST(n AS int) AS n, CAST(40 + 88 * n AS int) AS start, CAST(44 + 88 * n AS int) AS "end"
    FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) AS c(chromosome), (SELECT unnest(range(0, 6)) AS n))"""
