"""From raw documents to token ids in five stages; counted as a part of the subpackage for training text.

Each stage is written as Parquet to the shared folder and read again as the next one's documents.  All but the last
return the columns of documents.  Stages keep every row that they do not decide against: nulls in doc_id, source
or lang, ids that repeat with other texts, repeated rows and very long texts pass through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.bpe import bpe_round_trip
from strandmill.llm.credentials import find_secrets
from strandmill.llm.jaccard import jaccard_components
from strandmill.llm.langid import fit_language_model, identify_languages
from strandmill.llm.mixing import mix_sources
from strandmill.llm.registry import tokenizer_path, tokenizer_pattern
from strandmill.llm.shared import discard, durable, plain_files, table, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with `row`, a number of each row: ids can be null or repeat, so decisions come back by it.

    Rows of Parquet files are known by file and place, so they are read again without a copy; others are written first.
    """
    try:
        # Other plans may repeat a file's rows.
        found = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), *COLUMNS) if plain_files(docs) else None
    except AnalysisException:
        found = None
    if found is None:
        return durable(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS))
    files = sorted(r.file for r in found.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "number bigint, file string")
    return found.join(F.broadcast(numbers), "file").select((F.shiftleft("number", 40) + F.col("place")).alias("row"), *COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (`und`) go; all others stay.  lang is set where it was null."""
    found = identify_languages(docs, fit_language_model(docs), keep=("text", "lang", "source", "n_chars")).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays (null is the last), of rows that repeat this id one.
    Rows that share an id but have other texts are documents of their own."""
    docs = _numbered(docs)
    found = jaccard_components(docs, width=5, percent=80, id_col="row").select("row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = docs.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    return docs.join(kept, "row").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts and leave a mark; every document stays."""
    found = find_secrets(docs, reach=None, redact=True, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("spans") != "", F.length("redacted").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).withColumnRenamed("redacted", "text").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none to three times."""
    docs = _numbered(docs)
    mixed = mix_sources(docs, keep=("row",)).where("taken > 0").select("row", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return docs.join(mixed, "row").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes that they give again."""
    return bpe_round_trip(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
#: SQL cannot express the fitted language model, the byte merges and components; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's table is deleted when the next one's is written, and what it wrote on the way
    when its own is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        written: list[str] = []
        with temporary() as inner:
            docs = durable(stage(spark, docs, sf_dir), written)
        discard(spark, inner)
        discard(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
