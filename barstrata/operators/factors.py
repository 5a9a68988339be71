"""Grades of factors: how often they fire, how far they spread, what echoes what, what pays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.bars import written

# Share of candidates below which a factor is rare, spread in its own range,
# correlation of an echo, trades before an edge is told.
RARE_SHARE, FLAT_RATIO, ECHO_R, LEAST_TRADES = 0.10, 0.10, 0.70, 30


def _corr(x: str, y: str) -> Column:
    """Pearson's correlation over the rows that have both; null without spread on either side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-12, F.covar_pop(a, b) / spread)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, group) with the least node that each of ``nodes`` (a) reaches by ``edges`` (a, b).

    Labels are passed on until none changes, each round written to the shared folder: for
    graphs of few nodes, such as those of factors.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct(), "factor-links")
    label = written(nodes.select("a", F.col("a").alias("group")), "factor-groups")
    while True:
        near = links.join(label.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("group").alias("new"))
        told = written(label.join(near, "a"), "factor-groups")
        label = told.select("a", F.col("new").alias("group"))
        if told.where("new <> group").isEmpty():
            return label


def grades(candidates: DataFrame, factors: Sequence[str], outcome: str) -> DataFrame:
    """One row a factor: its fire rate, dispersion, correlation with the outcome, cluster and verdict.

    All statistics and correlations of pairs come from one aggregation of the candidates.
    Factors that echo each other, directly or through others, are a cluster: the one that
    follows the outcome most, then the widest, then the first by name, speaks for it.
    Without candidates there is nothing to grade: no rows.
    """
    n = F.count("*").cast("double")
    sums = []
    for f in factors:
        x = F.col(f)
        sums.append(F.struct(
            F.lit(f).alias("a"), F.count(x).alias("n_observed"), F.count_if(x != 0).alias("n_present"), F.try_divide(F.count_if(x != 0), n).alias("fire_rate"),
            F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"), (F.max(x) - F.min(x)).alias("span"),
            F.count(F.when(x.isNotNull() & F.col(outcome).isNotNull(), 1)).alias("n_outcome"), _corr(f, outcome).alias("r"),
        ))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _corr(a, b).alias("r")) for k, a in enumerate(factors) for b in factors[k + 1 :]]
    one = written(candidates.agg(F.array(*sums).alias("stats"), F.array(*pairs).cast("array<struct<a:string,b:string,r:double>>").alias("pairs"), n.alias("n"), F.count(outcome).alias("trades")).where("n > 0"), "factor-sums")
    stats = one.select("trades", F.explode("stats").alias("s")).select("trades", "s.*")
    stats = stats.withColumn("dispersion", F.coalesce(F.try_divide(F.col("std"), F.col("span")), F.lit(0.0)))
    stats = stats.withColumn("r", F.when((F.col("trades") >= LEAST_TRADES) & (F.col("n_outcome") >= LEAST_TRADES), F.col("r")))
    structural = (
        F.when((F.col("n_observed") == 0) | (F.col("n_present") == 0), "ABSENT").when(F.col("fire_rate") < RARE_SHARE, "RARE")
        .when(F.col("std") <= 1e-12, "ZERO_DISPERSION").when(F.col("dispersion") < FLAT_RATIO, "FLAT")
    )
    stats = written(stats.withColumn("structural", structural), "factor-stats")
    live = stats.where("structural is null").select("a")
    edges = one.select(F.explode("pairs").alias("p")).select("p.a", "p.b", "p.r").where(F.abs("r") >= ECHO_R)
    edges = edges.join(live, "a").join(live.withColumnRenamed("a", "b"), "b")
    told = stats.join(components(edges, live), "a", "left")
    place = Window.partitionBy("group").orderBy(F.desc(F.coalesce(F.abs("r"), F.lit(-1.0))), F.desc("dispersion"), "a")
    told = told.withColumn("place", F.when(F.col("group").isNotNull(), F.row_number().over(place)))
    verdict = (
        F.when(F.col("structural").isNotNull(), F.col("structural")).when(F.col("place") > 1, "REDUNDANT")
        .when((F.col("trades") < LEAST_TRADES) | F.col("r").isNull(), "UNPROVEN").when(F.abs("r") < 1.96 / F.sqrt("n_outcome"), "NOISE")
        .when(F.col("r") < 0, "ANTI").otherwise("EDGE")
    )
    return told.select(F.col("a").alias("factor"), "n_observed", "n_present", "fire_rate", "dispersion", "r", "group", verdict.alias("verdict"))
