"""A corpus pipeline of five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.decontaminate import decontaminate
from barlight.llm.jaccard_join import ngram_jaccard_join
from barlight.llm.language_crf import identify_language
from barlight.llm.line_dedup import line_dedup
from barlight.llm.piece_codec import piece_codec
from barlight.llm.store import free_name, materialise, return_memory

#: Mean probability that the likeliest language of each word must have; texts that mix languages reach it too.
LEAST_SURE = 0.5


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids; null ids are matched too."""
    key = free_name(docs, "kept_id")
    return docs.join(ids.select(F.col("doc_id").alias(key)), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: those without letters go, and those of whose words the model is not sure.

    Null and empty texts go; repeated rows of an id stay or go together. An
    empty table gives an empty one, as in every stage.
    """
    found = identify_language(docs).where((F.col("lang_pred") != "und") & (F.col("sure") >= LEAST_SURE))
    return _only(docs, found)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; n_chars follows the text.

    Rows with a null id or text stay as they are; repeated rows of an id lose
    the same lines.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id, once; texts without words are alone.

    An id names one text, so of repeated rows of an id one stays; rows with a
    null id all stay.
    """
    first = materialise(ngram_jaccard_join(docs, links=False).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("rows")), "first")
    once = _only(docs, first.where("rows = 1 or doc_id is null"))
    return once.union(_only(docs, first.where("rows > 1 and doc_id is not null")).dropDuplicates(["doc_id"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item; rows with a null id or text, and without words, stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, with their ids and the count and digests of these: a text that decodes otherwise shows.

    Null texts have the end id alone; every row gives one.
    """
    import public_tokenizers

    return piece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True, decoded=False, keep=docs.columns)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _afresh(stage: Stage) -> Stage:
    """stage, begun after the driver has given back what the plans before it left unused."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return_memory(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language ID", _afresh(language_id)),
    ("line dedup", _afresh(dedup_lines)),
    ("n-gram Jaccard join", _afresh(near_duplicates)),
    ("benchmark decontamination", _afresh(benchmark_decontamination)),
    ("SentencePiece encoding and decoding", _afresh(sentencepiece_codec)),
]

#: Language ID learns a model, which SQL does not express; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
