"""The append-only table of facts: content hashes, idempotent appends, reads as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a fact; ``fact_hash`` is its key.
COLUMNS = ("symbol", "tf", "kind", "market_time", "confirmed_at", "algo_version", "payload", "fact_hash")


def canonical_payload(fields: Sequence[str]) -> Column:
    """JSON of the fields in the order of their names, without blanks; null fields are left out."""
    return F.to_json(F.struct(*sorted(fields)))


def as_facts(frame: DataFrame, kind: str, algo_version: str, fields: Sequence[str]) -> DataFrame:
    """Facts of (symbol, tf, market_time, confirmed_at, *fields) rows."""
    told = frame.select(
        "symbol",
        "tf",
        F.lit(kind).alias("kind"),
        "market_time",
        "confirmed_at",
        F.lit(algo_version).alias("algo_version"),
        canonical_payload(fields).alias("payload"),
    )
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in COLUMNS[:-1]])
    return told.withColumn("fact_hash", F.sha2(key, 256))


def append(held: DataFrame, new: DataFrame) -> DataFrame:
    """The facts of ``new`` that ``held`` lacks, each once: what an append adds."""
    return new.dropDuplicates(["fact_hash"]).join(held.select("fact_hash"), "fact_hash", "left_anti").select(*new.columns)


def as_of(facts: DataFrame, known_by: Column | int, kind: str | None = None) -> DataFrame:
    """Facts that were knowable by then; the filter reaches the scan."""
    found = facts.where(F.col("confirmed_at") <= known_by)
    return found if kind is None else found.where(F.col("kind") == kind)


def superseded(facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Facts of a key for which a later algorithm version exists: what pruning may remove."""
    newest = facts.groupBy(*key).agg(F.max("algo_version").alias("__newest"))
    return facts.join(newest, list(key)).where("algo_version < __newest").drop("__newest")


def audit_series(bars: DataFrame, sound: Column, step: int) -> DataFrame:
    """One row per (symbol, tf): bars, first and last bar, missing, misaligned and unsound bars, status.

    ``bars`` may repeat a bar; the span's missing ones are counted from distinct times.
    One partial aggregation, whatever a series' length.
    """
    counted = bars.groupBy("symbol", "tf").agg(
        F.count("*").alias("bars"),
        F.min("open_ts").alias("first_ts"),
        F.max("open_ts").alias("last_ts"),
        F.count_distinct("open_ts").alias("__n"),
        F.count_if(F.col("open_ts") % step != 0).alias("misaligned"),
        F.count_if(~sound).alias("unsound"),
    )
    missing = ((F.col("last_ts") - F.col("first_ts")) / step).cast("long") + 1 - F.col("__n")
    status = F.when((F.col("misaligned") > 0) | (F.col("unsound") > 0), "ERROR").when(F.col("missing") > 0, "WARN").otherwise("OK")
    return counted.withColumn("missing", missing).withColumn("status", status).drop("__n")
