"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (a, b) rows with a > b: neighbours move to the least one."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.where("b > a") if large else both
    out = near.join(least, "a").select(F.col("b").alias("x"), "m")
    if not large:
        out = out.unionByName(least.select(F.col("a").alias("x"), "m"))
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected (a, b) edges.

    The component is its least node. Loops and repeated edges are allowed; no
    edges give no rows. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc",
    )
    seal = None
    while True:
        after = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if after["n"] == 0 or after == seal:
            break
        seal = after
        large = _star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        new = materialize(_star(large, False), "cc")
        release(spark, now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
