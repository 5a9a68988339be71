"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, line_dedup, mixing, stream_dedup


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import poisson_mix

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return poisson_mix(docs).select("doc_id", "source", "copy_no", "mix_key")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op5_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .stream_dedup import stream_dedup

    return stream_dedup(spark, f"{sf_dir}/documents.parquet")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "longest_run", "runs", "text")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_sample

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_sample(docs, labels)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import repeated_paragraphs

    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .role_repair import damaged, repair_conversations

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damaged(conversations), conversations)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


def op13_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .id_store import encoded_documents

    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_stream_dedup": op5_stream_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_media": op7_media,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_paragraph_dedup": op10_paragraph_dedup,
    "op11_role_repair": op11_role_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_id_store": op13_id_store,
}

ORACLES: dict[str, str] = {
    "op2_poisson_mix": mixing.SQL,
    "op5_stream_dedup": stream_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
