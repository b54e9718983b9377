"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_text, jaccard_join, merkle, near_duplicates, passages, quality, sharding, spelling, substring_parse, token_counts, token_files
from .common import new_path, read_table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_report(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_parse.repeated_bytes_report(read_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text_report(read_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(read_table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_report(read_table(spark, sf_dir, "documents"), percent=85)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_report(read_table(spark, sf_dir, "documents"), new_path(spark, "store"))


def op9_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages_report(read_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_ids")
    token_files.write_token_ids(read_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.token_file_report(token_files.read_token_ids(spark, path))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(read_table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"), percent=85)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_repeated_substrings": op3_repeated_substrings,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_html_text": op5_html_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_sharding": op8_sharding,
    "op9_near_passages": op9_near_passages,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_spelling_variants": op13_spelling_variants,
}

__all__ = ["ORACLES", "QUERIES"]
