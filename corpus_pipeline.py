"""The corpus pipeline: STAGES over documents, each stage reading what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barstrata.llm.common import materialize
from barstrata.llm.line_dedup import line_dedup
from barstrata.llm.mixing import poisson_mix
from barstrata.llm.ngram_join import keep_one_per_component
from barstrata.llm.packing import pack
from barstrata.llm.queries import tokenizer_path
from barstrata.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that a stage reads, and a way back to all of them.

    The others travel in one column, so that no name of theirs can clash with one
    that the stage adds.
    """
    rest = [c for c in docs.columns if c not in used]
    packed = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest])
    narrow = docs.select(*used, packed.alias("__rest"))

    def whole(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(c) if c in used else F.col("__rest").getField(c).alias(c) for c in docs.columns])

    return narrow, whole


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are.

    Null and empty texts are scored as texts without words. Null and repeated ids and
    columns of any name stay. An empty table gives no rows.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; documents that lose every line go.

    Null and empty texts stay. Rows that repeat id and text are cut alike; a null id
    comes before all others. ``n_chars`` is counted anew, all other columns stay, of
    any name. An empty table gives no rows.
    """
    narrow, whole = _apart(docs, "doc_id", "text")
    cut = whole(line_dedup(narrow).where("n_removed = 0 or n_removed < n_lines"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard 0.8.

    It is the one of the least id. Texts without words and rows with a null id stay; of
    rows that repeat an id one stays. Columns of any name stay. An empty table gives
    no rows.
    """
    narrow, whole = _apart(docs, "doc_id", "text")
    return whole(keep_one_per_component(narrow, width=5, percent=80))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet the sources' target weights.

    A null source is a source; rows with a null id count as one id, rows that repeat
    an id get the same count each. Null and empty texts have size 0 and their source's
    rate. Columns of any name stay. An empty table gives no rows.
    """
    narrow, whole = _apart(docs, "doc_id", "text", "source")
    return whole(poisson_mix(narrow))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids; a document repeated by the mixture is packed as often.

    Null and empty texts are their end token alone; very long texts are cut into pieces.
    Null and repeated ids are kept; other columns are not read. An empty table gives
    no rows.
    """
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard", near_copies),
    ("poisson_mix", mixture),
    ("packing", packing),
]

#: Learned scores and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of documents; the rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
