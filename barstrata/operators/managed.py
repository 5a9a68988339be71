"""Managed exits: a partial at a first target, a stop that trails, a stop in time; each rule apart and all together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .execution import MAX_BARS, settle
from .joins import held_window

# The first target and its share, the stop at entry, the trail's start and distance
# (all in R), the loss from which the time stop leaves a trade to its stop, and each timeframe's bars to hold.
PARTIAL_R, PARTIAL_SHARE = 1.5, 0.5
EVEN_R, TRAIL_R, TRAIL_DISTANCE = 1.0, 1.5, 0.5
STAGNATION = -0.7
HOLD_BARS = {"5m": 24, "15m": 20, "1H": 14, "4H": 12, "1D": 10, "1W": 8}
OTHER_HOLD_BARS = 12


@dataclass(frozen=True)
class Rules:
    """Which rules manage the trades of one cell."""

    cell: str
    partial: bool = False
    trail: bool = False
    time_stop: bool = False


CELLS = (
    Rules("HOLD"),
    Rules("PARTIAL", partial=True),
    Rules("TRAIL", trail=True),
    Rules("TIME_STOP", time_stop=True),
    Rules("MANAGED", True, True, True),
)


def _exit(rules: Rules, horizon: int):
    """The columns that a cell adds to the held bars, stage by stage, and the aggregate of its end."""
    c = rules.cell
    so_far = Window.partitionBy("symbol", "tf", "setup_id").orderBy("i")
    run = so_far.rowsBetween(Window.unboundedPreceding, 0)
    best, stop, part = F.col("best"), F.col(f"{c}_stop"), F.col(f"{c}_part")
    # The stop in R from the best price so far, this bar's included.
    trail = F.greatest(F.lit(-1.0), F.when(best >= EVEN_R, 0.0), F.when(best >= TRAIL_R, best - TRAIL_DISTANCE)) if rules.trail else F.lit(-1.0)
    # A bar that reaches the first target and the stop, or falls behind the entry, books no partial.
    books = (F.col("up") >= PARTIAL_R) & (F.col("down") > F.lag(stop, 1, -1.0).over(so_far)) & (F.col("down") >= 0) & F.lit(rules.partial)
    hold = F.coalesce(F.create_map(*[x for tf, n in HOLD_BARS.items() for x in (F.lit(tf), F.lit(n))])[F.col("tf")], F.lit(OTHER_HOLD_BARS))
    now = F.when(part.isNull(), stop).otherwise(F.greatest(stop, F.lit(0.0)))
    hit_sl, hit_tp = F.col("down") <= now, F.col("up") >= F.col("tp_r")
    late = F.lit(rules.time_stop) & (F.col("held") >= hold) & (F.col("end") > STAGNATION)
    outcome = F.when(hit_sl, "SL").when(hit_tp, "TP").when(late, "TIME")
    exit_r = F.when(hit_sl, now).when(hit_tp, F.col("tp_r")).otherwise(F.col("end"))
    done = F.struct("i", outcome.alias("outcome"), exit_r.alias("exit_r"), "held", "atr", part.alias("part"))
    cut = F.lit(not rules.time_stop) & (F.col("held") == horizon - 1)
    last = F.struct("i", F.lit("TIMEOUT").alias("outcome"), F.col("end").alias("exit_r"), "held", "atr", part.alias("part"))
    ended = F.coalesce(F.min(F.when(hit_sl | hit_tp | late, done)), F.max(F.when(cut, last))).alias(c)
    return {f"{c}_stop": trail}, {f"{c}_part": F.min(F.when(books, F.col("held"))).over(run)}, ended


def managed_exits(trades: DataFrame, bars: DataFrame, tf_seconds: int, cells: Sequence[Rules] = CELLS, horizon: int = MAX_BARS) -> DataFrame:
    """(symbol, tf, setup_id, cell, outcome, bars_held, partial, r): each trade under the rules of each cell.

    ``trades`` have setup_id, direction, fill_i, entry, sl and tp. A bar that reaches the stop
    and the target is the stop, and a bar's own extreme moves the stop before it is met. The
    stop is a function of the best price so far, so each cell is a running window over a
    trade's bars and not a walk; all cells share one join and one sort. Legs are settled like
    any exit, weighted and summed. A trade that is still open in a cell has no row there.
    """
    long, risk = F.col("direction") == "LONG", F.abs(F.col("entry") - F.col("sl"))
    sign = F.when(long, 1.0).otherwise(-1.0)
    in_r = lambda price: sign * (price - F.col("entry")) / risk
    own = ["symbol", "tf", "setup_id", "direction", "entry", "sl", "tp"]
    held = held_window(trades.select(*own, "fill_i"), bars, "fill_i", horizon, ["high", "low", "close", "atr"])
    seen = held.select(
        *own, "i", "atr",
        in_r(F.when(long, F.col("high")).otherwise(F.col("low"))).alias("up"),
        in_r(F.when(long, F.col("low")).otherwise(F.col("high"))).alias("down"),
        in_r(F.col("close")).alias("end"), in_r(F.col("tp")).alias("tp_r"), (F.col("i") - F.col("fill_i")).alias("held"),
    )
    run = Window.partitionBy("symbol", "tf", "setup_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("best", F.greatest(F.max("up").over(run), F.lit(0.0)))
    stops, parts, ends = zip(*[_exit(rules, horizon) for rules in cells], strict=True)
    for added in (stops, parts):
        seen = seen.withColumns({name: column for one in added for name, column in one.items()})
    closed = seen.groupBy(*own).agg(*ends).unpivot(own, [r.cell for r in cells], "cell", "x").where("x is not null")
    # What is left of the trade, and the partial, if one was booked, as a resting order at its target.
    rest = F.struct(
        F.when(F.col("x.part").isNull(), 1.0).otherwise(1 - PARTIAL_SHARE).alias("share"),
        F.when(F.col("x.outcome") == "TIME", "TIMEOUT").otherwise(F.col("x.outcome")).alias("outcome"),
        F.col("x.exit_r").alias("exit_r"), F.col("x.held").alias("bars_held"),
    )
    first = F.when(
        F.col("x.part").isNotNull(),
        F.struct(F.lit(PARTIAL_SHARE).alias("share"), F.lit("TP").alias("outcome"), F.lit(PARTIAL_R).alias("exit_r"), F.col("x.part").alias("bars_held")),
    )
    told = closed.withColumn("leg", F.explode(F.array_compact(F.array(rest, first))))
    legs = told.select(*own, "cell", F.col("x.outcome").alias("ended"), F.col("x.held").alias("held"), F.col("x.part").alias("part"), F.col("x.atr").alias("atr_exit"), "leg.*")
    legs = legs.withColumn("exit_price", F.col("entry") + sign * F.col("exit_r") * risk)
    return (
        settle(legs, tf_seconds)
        .groupBy("symbol", "tf", "setup_id", "cell")
        .agg(
            F.first("ended").alias("outcome"),
            F.first("held").alias("bars_held"),
            F.first("part").isNotNull().alias("partial"),
            F.round(F.sum(F.col("share") * F.col("r_multiple")), 4).alias("r"),
        )
    )


def compared(exits: DataFrame, base: str = "HOLD") -> DataFrame:
    """One row per cell: trades, mean R, win rate, profit factor, and over the trades that
    ``base`` has closed as well the mean gain on it and how many did better and worse.

    The base's R meets its trade's other cells in one window over the trade.
    """
    own = Window.partitionBy("symbol", "tf", "setup_id")
    gain = F.col("r") - F.max(F.when(F.col("cell") == base, F.col("r"))).over(own)
    won, lost = F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))
    return (
        exits.withColumn("gain", gain)
        .groupBy("cell")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("r"), 6).alias("mean_r"),
            F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("win_rate"),
            F.when(lost > 0, F.round(won / lost, 6)).alias("profit_factor"),
            F.round(F.avg("gain"), 6).alias("mean_gain"),
            F.count_if(F.round("gain", 6) > 0).alias("better"),
            F.count_if(F.round("gain", 6) < 0).alias("worse"),
        )
    )
