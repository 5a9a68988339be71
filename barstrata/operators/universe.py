"""Universe snapshots: ranked, floored and warmed members a day, and membership as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof

# Ranks that can be admitted, least daily volume, least daily bars.
TOP_N, MIN_VOLUME, MIN_DAILY = 20, 3_000_000.0, 200
DAY = 86400


def snapshots(days: DataFrame, seeds: Sequence[str], top_n: int = TOP_N, min_volume: float = MIN_VOLUME, min_daily: int = MIN_DAILY) -> DataFrame:
    """Every symbol's state at the close of every day of ``days`` (symbol, day, volume).

    A day without volume counts as 0 and as no daily bar. Seeds are always members:
    past the ranks as anchors without a rank. Others past the ranks are OUTSIDE.
    """
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    # One row of two numbers.
    grid = days.select("symbol").distinct().join(F.broadcast(span)).select("symbol", F.explode(F.sequence("a", "b", F.lit(DAY).cast("long"))).alias("day"))
    so_far = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    known = grid.join(days, ["symbol", "day"], "left").withColumn("n_daily", F.count("volume").over(so_far)).na.fill(0.0, ["volume"])
    # A day's candidates are the listed symbols.
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("volume"), "symbol"))
    seed, past, warm = F.col("symbol").isin(*seeds), F.col("place") > top_n, F.col("n_daily") >= min_daily
    poor = (F.col("volume") < min_volume) & ~seed & ~past
    state = F.when(past & ~seed, "OUTSIDE").when(poor, "REJECTED").when(~warm, "WARMING").otherwise("ADMITTED")
    reason = (
        F.when(past & ~seed, "beyond_ranks").when(past, "seed_anchor").when(poor, "below_liquidity_floor")
        .when(~warm, "insufficient_history").otherwise("liquid_and_warm")
    )
    told = known.withColumn("place", place).withColumns({"state": state, "reason": reason})
    rank = F.when(~past, F.col("place").cast("long"))
    return told.select("symbol", "day", (F.col("day") + DAY).alias("confirmed_at"), rank.alias("rank"), "volume", "n_daily", "state", "reason")


def admitted_at(facts: DataFrame, members: DataFrame, time: str, seeds: Sequence[str]) -> DataFrame:
    """``facts`` with ``admitted``: by the last snapshot known then; before the first, seeds alone."""
    told = asof(facts, members, ["symbol"], time, "confirmed_at", ["state"])
    return told.withColumn("admitted", F.coalesce(F.col("state") == "ADMITTED", F.col("symbol").isin(*seeds))).drop("state")
