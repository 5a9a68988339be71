"""A setup's life from plan to exit, in tables that lie together by setup."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.bars import shared_folder

#: Buckets of a table; a bucket of the largest table should fit a task's memory.
BUCKETS = 64


def colocated(frames: dict[str, DataFrame], key: str = "setup_id", buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Each frame as a table bucketed and sorted by ``key`` in the shared folder.

    The tables are shuffled once, when they are written; every join of them by the key reads
    bucket by bucket and shuffles nothing.
    """
    out = {}
    for label, frame in frames.items():
        spark = frame.sparkSession
        name = f"{label}_{uuid.uuid4().hex}"
        # One task a bucket, so that a bucket is one file.
        frame.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark, label)).saveAsTable(name)
        out[label] = spark.table(name)
    return out


def trace(plans: DataFrame, risk: DataFrame, orders: DataFrame, execs: DataFrame, key: str = "setup_id") -> DataFrame:
    """Each plan with what sizing, the order and the exit made of it, and how far it came.

    Each of the four holds a setup at most once. Three left joins by the key.
    """
    whole = plans.join(risk, key, "left").join(orders, key, "left").join(execs, key, "left")
    stage = (
        F.when(F.col("outcome").isNotNull(), "CLOSED").when(F.col("status") == "FILLED", "OPEN").when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("decision") == "REJECTED", "REFUSED").otherwise("PLANNED")
    )
    return whole.withColumn("stage", stage)


def funnel(traced: DataFrame, by: list[str]) -> DataFrame:
    """How many setups came how far, and what the closed ones earned."""
    n = lambda c: F.count_if(c)
    stage = F.col("stage")
    return traced.groupBy(*by).agg(
        F.count("*").alias("planned"), n(F.coalesce(F.col("decision") != "REJECTED", F.lit(False))).alias("sized"), n(stage.isin("OPEN", "CLOSED")).alias("filled"),
        n(stage == "CLOSED").alias("closed"), n(F.coalesce(F.col("r_multiple") > 0, F.lit(False))).alias("winners"), F.coalesce(F.round(F.sum("r_multiple"), 6), F.lit(0.0)).alias("net_r"),
    )
