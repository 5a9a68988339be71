"""Trend continuation: stretch, pullback and resumption as an ordered pattern of bars.

Bars fall into legs: runs with the ribbon stacked one way and no close lost on the other
side. In a leg a pattern starts at its first bar, and the next one after the last has been
used up. For every bar as a start, the third stretched bar, the first bar of the pullback
and the bar that ends it come from windows and joins by ordinal; which starts are taken is
a walk along the ends, by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.bars import written
from .joins import held_window
from .paths import reachable
from .series import sma
from .setups import STOP_ATR, gated

# Deadband and nearness in ATR, bars of a stretch, of a pullback, to resume, of a series.
DEADBAND_ATR, NEAR_ATR, STRETCH, PULLBACK_BARS, RESUME_BARS, LEAST_BARS = 0.25, 0.60, 3, 10, 6, 210
LIMIT = PULLBACK_BARS + RESUME_BARS

_KEY = ["symbol", "tf"]


def ribbon_legs(bars: DataFrame) -> DataFrame:
    """Bars of a leg with ``leg``, ``long``, and whether they are stretched, near or resuming."""
    order = Window.partitionBy(*_KEY).orderBy("open_ts")
    n = F.count("*").over(Window.partitionBy(*_KEY))
    told = bars.withColumns({"sma200": sma("close", 200), "n": n, "next_open": F.lead("open").over(order)})
    fast, mid, slow = F.col("ema20"), F.col("ema50"), F.col("sma200")
    tol = DEADBAND_ATR * F.col("atr")
    ready = fast.isNotNull() & mid.isNotNull() & slow.isNotNull() & (F.col("atr") > 0) & (F.col("n") >= LEAST_BARS)
    side = F.when(ready & (fast > mid + tol) & (mid > slow + tol), "LONG").when(ready & (fast < mid - tol) & (mid < slow - tol), "SHORT")
    top, bottom = F.greatest(fast, mid, slow), F.least(fast, mid, slow)
    above, below = F.col("close") > top + tol, F.col("close") < bottom - tol
    told = told.withColumns({"side": side, "above": above, "below": below})
    long = F.col("side") == "LONG"
    span = F.col("high") - F.col("low")
    rejected = F.when(long, F.col("close") >= F.col("low") + 0.66 * span).otherwise(F.col("close") <= F.col("high") - 0.66 * span)
    told = told.withColumns(
        {
            "long": long, "inside": F.col("side").isNotNull() & ~F.when(long, F.col("below")).otherwise(F.col("above")),
            "stretched": F.when(long, F.col("above")).otherwise(F.col("below")),
            "near": F.abs(F.col("close") - fast) <= NEAR_ATR * F.col("atr"),
        }
    ).withColumn("resumes", F.col("stretched") & ((span <= 0) | rejected))
    starts = F.col("inside") & ~(F.coalesce(F.lag("inside").over(order), F.lit(False)) & F.coalesce(F.lag("side").over(order) == F.col("side"), F.lit(False)))
    leg = F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("leg", leg).where("inside").select(*_KEY, "leg", "i", "open_ts", "long", "stretched", "near", "resumes")


def patterns(bars: DataFrame) -> DataFrame:
    """(key, long, pull_i, end_i, resumed) of every pattern that is taken, in order and each bar once."""
    legs = written(ribbon_legs(bars), "ribbon-legs")
    line = Window.partitionBy(*_KEY, "leg").orderBy("i")
    ahead, after = line.rowsBetween(0, Window.unboundedFollowing), line.rowsBetween(1, Window.unboundedFollowing)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    told = legs.withColumns(
        {
            "ordinal": F.count_if("stretched").over(so_far),
            "pull_i": F.min(F.when(~F.col("stretched") | F.col("near"), F.col("i"))).over(ahead),
            "resume_i": F.min(F.when(F.col("resumes"), F.col("i"))).over(after),
            "leg_end": F.max("i").over(Window.partitionBy(*_KEY, "leg")),
        }
    )
    # The bar that completes the stretch of a start: the third stretched one from there.
    third = told.where("stretched").select(*_KEY, "leg", F.col("ordinal").alias("wanted"), F.col("pull_i").alias("pull"))
    wanted = F.col("ordinal") - F.when(F.col("stretched"), 1).otherwise(0) + STRETCH
    pulls = told.withColumn("wanted", wanted).join(third, [*_KEY, "leg", "wanted"]).where("pull is not null").select(*_KEY, "leg", "long", F.col("i").alias("at"), "pull")
    ends = told.select(*_KEY, F.col("i").alias("pull"), "resume_i", "leg_end")
    resumed = F.col("resume_i").isNotNull() & (F.col("resume_i") - F.col("pull") <= LIMIT)
    end = F.when(resumed, F.col("resume_i")).when(F.col("pull") + LIMIT + 1 <= F.col("leg_end"), F.col("pull") + LIMIT + 1)
    steps = written(pulls.join(ends, [*_KEY, "pull"]).withColumns({"resumed": resumed, "end": end}), "trend-steps")
    links = steps.where("end < leg_end").select(*_KEY, "at", (F.col("end") + 1).alias("to"))
    starts = legs.groupBy(*_KEY, "leg").agg(F.min("i").alias("at"))
    return steps.join(reachable(links, starts), [*_KEY, "at"], "left_semi").select(*_KEY, "long", F.col("pull").alias("pull_i"), F.col("end").alias("end_i"), "resumed")


def continuations(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """Resumed patterns as trades at the next open that pass every gate, with the reason of the others.

    The stop lies beyond the pullback, the target is the nearest known swing.
    """
    taken = patterns(bars).where("resumed")
    order = Window.partitionBy(*_KEY).orderBy("open_ts")
    told = bars.withColumn("next_open", F.lead("open").over(order))
    held = held_window(taken, told, "pull_i", LIMIT + 1, ["low", "high"]).where("i <= end_i")
    extreme = held.groupBy(*_KEY, "pull_i").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"))
    at = told.select(*_KEY, F.col("i").alias("end_i"), "open_ts", "high", "low", "atr", "tick", "next_open")
    base = taken.join(extreme, [*_KEY, "pull_i"]).join(at, [*_KEY, "end_i"]).where("next_open is not null")
    long: Column = F.col("long")
    sl = F.when(long, F.col("lowest") - STOP_ATR * F.col("atr")).otherwise(F.col("highest") + STOP_ATR * F.col("atr"))
    aimed = gated(base.withColumns({"entry": F.col("next_open"), "sl": sl}), swings)
    return aimed.withColumn("pullback_bars", F.col("end_i") - F.col("pull_i")).select(
        *_KEY, F.when(long, "LONG").otherwise("SHORT").alias("direction"), F.col("open_ts").alias("market_time"), F.col("as_of").alias("confirmed_at"),
        "entry", "sl", "tp", "rr", "maker_limit", "pullback_bars", "reason", (F.col("end_i") + 1).alias("fill_i"),
    )
