"""The opN_<name> queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .voronoi_knn import top_k_search

    return top_k_search(_table(spark, sf_dir, "embeddings"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from .piece_codec import piece_codec

    return piece_codec(_table(spark, sf_dir, "documents"), model or _tokenizer("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer or _tokenizer("byte_bpe_50k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent_lm import maxent_scores

    return maxent_scores(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_crf import identify_language

    return identify_language(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
