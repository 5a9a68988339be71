"""Factors on trial: each trade's cohort by the last fact of each factor that was known when it was decided."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof_many, nearest_active

# Trades from which a cohort's mean is told, bars that a reading stays good, the audition's windows.
MIN_COHORT, WINDOW_BARS = 30, 10
WINDOWS = (5, 10, 20, 40)


@dataclass(frozen=True)
class Factor:
    """Readings (symbol, tf, known, state) of one factor, and how they make a cohort.

    ``supports`` maps a state to the side that it argues for: a trade AGREES or OPPOSES, and
    a state that is not there argues for none. ``buckets`` are (edge, name) in rising order
    of the size of a numeric state, the last without an edge. With neither the state is the cohort.
    """

    name: str
    readings: DataFrame
    supports: dict[str, str] | None = None
    buckets: tuple[tuple[float | None, str], ...] | None = None

    def cohort(self, state: Column) -> Column:
        if self.buckets:
            told = F.lit(None).cast("string")
            for edge, label in reversed(self.buckets):
                told = F.lit(label) if edge is None else F.when(F.abs(state.cast("double")) < edge, label).otherwise(told)
            return F.when(state.isNotNull(), told)
        if self.supports is None:
            return state
        side = F.lit(None).cast("string")
        for value, way in self.supports.items():
            side = F.when(state == value, way).otherwise(side)
        return F.when(side == F.col("direction"), "AGREES").when(side.isNotNull(), "OPPOSES")


def annotated(trades: DataFrame, factors: Sequence[Factor], tf_seconds: int, window: int = WINDOW_BARS) -> DataFrame:
    """``trades`` (symbol, tf, direction, confirmed_at) with a column of its cohort for each factor.

    Readings of all factors and the trades are dealt and sorted once. A reading older than
    ``window`` bars, one that argues for no side and none at all are the cohort NONE.
    """
    facts = {f.name: (f.readings, "known", ["state"]) for f in factors}
    told = asof_many(trades, facts, ["symbol", "tf"], "confirmed_at")
    fresh = lambda f: F.col("confirmed_at") - F.col(f"{f.name}.at") <= window * tf_seconds
    cohorts = {f.name: F.coalesce(F.when(fresh(f), f.cohort(F.col(f"{f.name}.state"))), F.lit("NONE")) for f in factors}
    return told.select(*trades.columns, *[c.alias(name) for name, c in cohorts.items()])


def graded(trades: DataFrame, factors: Sequence[Factor], tf_seconds: int, window: int = WINDOW_BARS, least: int = MIN_COHORT) -> DataFrame:
    """(factor, cohort, n, total_r, mean_r): every cohort's trades; the mean of ``least`` trades or more."""
    told = annotated(trades, factors, tf_seconds, window).unpivot(["r_multiple"], [f.name for f in factors], "factor", "cohort")
    return _figures(told.groupBy("factor", "cohort"), least)


def audition(trades: DataFrame, factor: Factor, tf_seconds: int, windows: Sequence[int] = WINDOWS, least: int = MIN_COHORT) -> DataFrame:
    """(window_bars, cohort, n, total_r, mean_r): one factor at several windows, from one as-of join:
    the last reading's age says in which windows it counts."""
    told = asof_many(trades, {"x": (factor.readings, "known", ["state"])}, ["symbol", "tf"], "confirmed_at")
    told = told.withColumn("window_bars", F.explode(F.array(*[F.lit(w) for w in windows])))
    fresh = F.col("confirmed_at") - F.col("x.at") <= F.col("window_bars") * tf_seconds
    told = told.withColumn("cohort", F.coalesce(F.when(fresh, factor.cohort(F.col("x.state"))), F.lit("NONE")))
    return _figures(told.groupBy("window_bars", "cohort"), least)


def _figures(groups, least: int) -> DataFrame:
    return groups.agg(
        F.count("*").alias("n"), F.round(F.sum("r_multiple"), 6).alias("total_r"), F.when(F.count("*") >= least, F.round(F.avg("r_multiple"), 6)).alias("mean_r")
    )


def newest_open(gaps: DataFrame, step: int) -> DataFrame:
    """(symbol, tf, known, state): at each birth and end of a gap the direction of the youngest one open.

    ``gaps`` are (symbol, tf, direction, born, gone), at most one born a bar. The youngest
    open gap is the nearest active level below now, with births as levels.
    """
    key = ["symbol", "tf"]
    levels = gaps.select(*key, F.lit("LOW").alias("kind"), F.col("born").cast("double").alias("level"), F.col("born").alias("known"), "gone")
    times = gaps.select(*key, F.explode(F.array_compact(F.array("born", "gone"))).alias("as_of")).distinct()
    asked = times.select(*key, "as_of", F.lit(False).alias("long"), (F.col("as_of") + 1).cast("double").alias("price"))
    born = nearest_active(asked, levels, F.lit(step), "youngest").where("youngest is not null")
    ways = gaps.select(*key, F.col("born").cast("double").alias("youngest"), F.col("direction").alias("state"))
    return born.join(ways, [*key, "youngest"]).select(*key, F.col("as_of").alias("known"), "state")
