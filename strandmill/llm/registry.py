"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .filter_audit import ORACLE as AUDIT_ORACLE
from .filter_audit import audit_filters
from .jaccard import jaccard_components
from .langid import fit_language_model, identify_languages
from .main_text import extract_main_text
from .media import read_payloads, store_payloads
from .middle import ORACLE as MIDDLE_ORACLE
from .middle import fill_in_middle
from .mixing import ORACLE as MIX_ORACLE
from .mixing import mix_sources
from .near_vectors import near_duplicate_vectors
from .credentials import find_secrets
from .shared import table
from .substrings import ORACLE as REPEATS_ORACLE
from .substrings import remove_repeats
from .token_counts import prefix_token_counts
from .url_rules import ORACLE as URL_ORACLE
from .url_rules import judge_urls


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_payloads(store_payloads(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), reach=None)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_language_model(docs))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    hashes = (F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_media_payloads, op2_secret_scan, op3_near_vectors, op4_main_text, op5_token_counts, op6_url_rules, op7_mix_sources, op8_jaccard_join, op9_byte_bpe, op10_language_id, op11_substring_dedup, op12_filter_audit, op13_fill_in_middle)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_rules": URL_ORACLE, "op7_mix_sources": MIX_ORACLE, "op11_substring_dedup": REPEATS_ORACLE, "op12_filter_audit": AUDIT_ORACLE, "op13_fill_in_middle": MIDDLE_ORACLE}
