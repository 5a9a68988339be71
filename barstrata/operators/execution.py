"""Fills, exits, settlement, cooldowns and the portfolio replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trading import SLIP_ATR, Gates, cooldown_hours, funding_rate, venue_value
from .joins import held_window

MAX_BARS, ENTRY_BARS, MAKER_WAIT = 100, 4, 2


def limit_fills(plans: DataFrame, bars: DataFrame, wait: int = ENTRY_BARS) -> DataFrame:
    """Plans (setup_id, order_i, limit_price) with ``fill_i`` and FILLED, MISSED or PENDING."""
    hits = (
        held_window(plans.select("symbol", "tf", "setup_id", "order_i", "limit_price"), bars, "order_i", wait, ["low", "high"])
        .where(F.col("limit_price").between(F.col("low"), F.col("high")))
        .groupBy("setup_id")
        .agg(F.min("i").alias("fill_i"))
    )
    last = bars.groupBy("symbol", "tf").agg(F.max("i").alias("last_i"))
    status = F.when(F.col("fill_i").isNotNull(), "FILLED").when(F.col("order_i") + wait > F.col("last_i") + 1, "PENDING").otherwise("MISSED")
    return plans.join(hits, "setup_id", "left").join(last, ["symbol", "tf"]).withColumn("status", status).drop("last_i")


def simulate_entries(plans: DataFrame, bars: DataFrame, cross: bool = True, wait: int = MAKER_WAIT) -> DataFrame:
    """Plans (setup_id, order_i, entry, sl, maker_limit, direction) with the fill they got.

    A passive order rests at ``maker_limit`` for ``wait`` bars. One that is not met crosses
    at the next bar's open, slipped against it, as a taker; without ``cross`` it is MISSED.
    The entry is the price paid and the risk follows from it. A plan that the data's end
    leaves undecided, or whose fill lies beyond its stop, is PENDING.
    """
    long = F.col("direction") == "LONG"
    asked = plans.select("symbol", "tf", "setup_id", "order_i", "maker_limit")
    rested = (
        held_window(asked, bars, "order_i", wait, ["low", "high"]).where(F.col("maker_limit").between(F.col("low"), F.col("high")))
        .groupBy("setup_id").agg(F.min("i").alias("rest_i"))
    )
    last = bars.groupBy("symbol", "tf").agg(F.max("i").alias("last_i"))
    opened = bars.select("symbol", "tf", F.col("i").alias("cross_i"), F.col("open").alias("cross_open"), F.col("atr").alias("cross_atr"))
    told = plans.join(rested, "setup_id", "left").join(last, ["symbol", "tf"]).withColumn("cross_i", F.col("order_i") + wait)
    told = told.join(opened, ["symbol", "tf", "cross_i"], "left")
    slip = SLIP_ATR * F.coalesce("cross_atr", F.lit(0.0))
    crossed = F.lit(cross) & F.col("rest_i").isNull() & F.col("cross_open").isNotNull()
    fill = F.when(F.col("rest_i").isNotNull(), F.col("maker_limit")).when(crossed, F.when(long, F.col("cross_open") + slip).otherwise(F.col("cross_open") - slip))
    fine = fill.isNotNull() & F.when(long, fill > F.col("sl")).otherwise(fill < F.col("sl"))
    missed = F.lit(not cross) & fill.isNull() & (F.col("order_i") + wait <= F.col("last_i") + 1)
    status = F.when(fine, "FILLED").when(missed, "MISSED").otherwise("PENDING")
    told = told.withColumns({"fill": fill, "status": status})
    filled = F.col("status") == "FILLED"
    return told.withColumns(
        {
            "entry": F.when(filled, F.col("fill")).otherwise(F.col("entry")), "entry_role": F.when(filled & F.col("rest_i").isNull(), "TAKER").otherwise("MAKER"),
            "fill_i": F.when(filled, F.coalesce("rest_i", "cross_i")),
        }
    ).drop("rest_i", "last_i", "cross_i", "cross_open", "cross_atr", "fill")


def walk_exits(trades: DataFrame, bars: DataFrame, horizon: int = MAX_BARS) -> DataFrame:
    """Trades (setup_id, fill_i, entry, sl, tp, direction) with their exit and excursions.

    The first bar of [fill_i, fill_i + horizon) that reaches a level decides; a bar
    that reaches both is the stop. Trades whose window is cut by the end of the data
    are open and give no row.
    """
    long = F.col("direction") == "LONG"
    held = held_window(trades, bars, "fill_i", horizon, ["high", "low", "close", "atr"])
    hit_sl = F.when(long, F.col("low") <= F.col("sl")).otherwise(F.col("high") >= F.col("sl"))
    hit_tp = F.when(long, F.col("high") >= F.col("tp")).otherwise(F.col("low") <= F.col("tp"))
    seen = held.withColumns({"hit_sl": hit_sl, "hit_tp": hit_tp})
    ends = seen.groupBy("setup_id").agg(
        F.min(F.when(F.col("hit_sl") | F.col("hit_tp"), F.struct("i", "hit_sl", "hit_tp", "atr"))).alias("first"),
        F.max(F.struct("i", "close", "atr")).alias("last"),
    )
    exit_i = F.coalesce("first.i", F.when(F.col("last.i") == F.col("fill_i") + horizon - 1, F.col("last.i")))
    done = (
        trades.join(ends, "setup_id")
        .withColumn("exit_i", exit_i)
        .where("exit_i is not null")
        .withColumns(
            {
                "outcome": F.when(F.col("first.hit_sl"), "SL").when(F.col("first.hit_tp"), "TP").otherwise("TIMEOUT"),
                "ambiguous": F.coalesce(F.col("first.hit_sl") & F.col("first.hit_tp"), F.lit(False)),
                "atr_exit": F.coalesce("first.atr", "last.atr"),
            }
        )
        .withColumn("exit_price", F.when(F.col("outcome") == "SL", F.col("sl")).when(F.col("outcome") == "TP", F.col("tp")).otherwise(F.col("last.close")))
        .withColumn("bars_held", F.col("exit_i") - F.col("fill_i"))
        .drop("first", "last")
    )
    span = held.select("setup_id", "i", "high", "low").join(done.select("setup_id", "exit_i", "entry", "direction"), "setup_id").where("i <= exit_i")
    best = F.when(long, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low"))
    worst = F.when(long, F.col("entry") - F.col("low")).otherwise(F.col("high") - F.col("entry"))
    moves = span.groupBy("setup_id").agg(F.max(best).alias("mfe"), F.max(worst).alias("mae"))
    return done.join(moves, "setup_id")


def settle(exits: DataFrame, tf_seconds: int, entry_role: str = "TAKER") -> DataFrame:
    """Adds slip, fees, funding, r_gross and r_multiple.

    Stops and timeouts leave at market: slippage, and the taker fee on the slipped
    price. Targets rest and pay the maker fee. Funding accrues over the hold. A column
    ``entry_role`` says by whose fee each entry was made; without one all had the same.
    """
    long = F.col("direction") == "LONG"
    market = F.col("outcome").isin("SL", "TIMEOUT")
    slip = F.when(market, SLIP_ATR * F.coalesce("atr_exit", F.lit(0.0))).otherwise(0.0)
    eff = F.when(long, F.col("exit_price") - F.col("slip")).otherwise(F.col("exit_price") + F.col("slip"))
    hours = F.col("bars_held") * tf_seconds / 3600
    out_rate = F.when(market, venue_value(F.col("symbol"), "taker")).otherwise(venue_value(F.col("symbol"), "maker"))
    role = F.col("entry_role") if "entry_role" in exits.columns else F.lit(entry_role)
    in_rate = F.when(role == "TAKER", venue_value(F.col("symbol"), "taker")).otherwise(venue_value(F.col("symbol"), "maker"))
    gross = F.when(long, F.col("exit_price") - F.col("entry")).otherwise(F.col("entry") - F.col("exit_price"))
    net = F.when(long, F.col("eff_exit") - F.col("entry")).otherwise(F.col("entry") - F.col("eff_exit"))
    risk = F.abs(F.col("entry") - F.col("sl"))
    return (
        exits.withColumn("slip", slip)
        .withColumn("eff_exit", eff)
        .withColumn("fees", in_rate * F.col("entry") + out_rate * F.col("eff_exit"))
        .withColumn("funding", funding_rate(F.col("symbol"), hours) * F.col("entry"))
        .withColumn("r_gross", F.bround(gross / risk, 2))
        .withColumn("r_multiple", F.bround((net - F.col("fees") - F.col("funding")) / risk, 2))
    )


def cooldowns(execs: DataFrame) -> DataFrame:
    """One interval per closed trade: key, starts_at, expires_at, outcome."""
    hours = cooldown_hours(F.col("outcome"), F.col("tf"))
    return execs.where("outcome <> 'MISSED'").select(
        "setup_id", "symbol", "direction", F.col("exit_ts").alias("starts_at"), (F.col("exit_ts") + hours * 3600).cast("long").alias("expires_at"), "outcome", "tf"
    )


def blocked(intents: DataFrame, intervals: DataFrame) -> DataFrame:
    """Intents inside a cooldown of their symbol and direction, with its latest expiry."""
    # Intervals last a day at most, so that each stands in two days' bins or fewer.
    day = lambda c: F.floor(F.col(c) / 86400)
    span = intervals.select("symbol", "direction", "starts_at", "expires_at", F.col("outcome").alias("cause")).withColumn(
        "day", F.explode(F.sequence(day("starts_at"), day("expires_at")))
    )
    return (
        intents.withColumn("day", day("confirmed_at")).join(span, ["symbol", "direction", "day"])
        .where((F.col("starts_at") <= F.col("confirmed_at")) & (F.col("confirmed_at") < F.col("expires_at")))
        .groupBy("setup_id")
        .agg(F.max("expires_at").alias("expires_at"), F.max_by("cause", "expires_at").alias("cause"))
    )


def replay(intents: DataFrame, gates: Gates = Gates(), start: float = 10_000.0) -> DataFrame:
    """The account's decisions in order of knowledge, one account per ``account``.

    Every decision depends on the equity that all earlier ones left, so an account
    is one fold; accounts are independent of each other.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["confirmed_at", "market_time", "setup_id"])
        equity = peak = start
        live: list[list] = []
        day_pnl: dict[int, float] = {}
        day_open: dict[int, float] = {}
        halted: set[int] = set()
        stopped = False
        out = []
        for x in frame.itertuples(index=False):
            for p in sorted((p for p in live if p[1] <= x.confirmed_at), key=lambda p: p[1]):
                live.remove(p)
                day = p[1] // 86400
                day_open.setdefault(day, equity)
                pnl = round(p[2] * p[3], 2)
                equity = round(equity + pnl, 2)
                day_pnl[day] = day_pnl.get(day, 0.0) + pnl
                peak = max(peak, equity)
                stopped |= (peak - equity) / peak >= gates.max_drawdown
                if day_pnl[day] <= -gates.daily_loss_r * gates.risk_pct * day_open[day]:
                    halted.add(day)
            intended = round(equity * gates.risk_pct, 2)
            budget = round(gates.open_risk_r * gates.risk_pct * equity - sum(p[2] for p in live), 2)
            risk = min(intended, budget)
            reason = (
                "DRAWDOWN_HALT" if stopped
                else "COOLDOWN" if x.cooling
                else "DAILY_LOSS_HALT" if x.confirmed_at // 86400 in halted
                else "INVALID_STOP_DISTANCE" if x.entry == x.sl
                else "CONCURRENT_LIMIT" if len(live) >= gates.concurrent
                else "EXPOSURE_LIMIT" if budget < intended * gates.min_reduced
                else None
            )
            if reason is None:
                live.append([x.setup_id, x.exit_ts, risk, x.r_multiple])
            decision = "REJECTED" if reason else "REDUCED" if budget < intended else "APPROVED"
            out.append((x.account, x.setup_id, decision, reason or ("EXPOSURE_LIMIT" if budget < intended else "WITHIN_LIMITS"), 0.0 if reason else risk, equity))
        return pd.DataFrame(out, columns=["account", "setup_id", "decision", "reason", "risk_usd", "equity_at"])

    schema = "account string, setup_id string, decision string, reason string, risk_usd double, equity_at double"
    return intents.groupBy("account").applyInPandas(run, schema)


def drawdown(trades: DataFrame, key: list[str], order: list[str], r: str = "r_multiple") -> DataFrame:
    """Largest fall of the running sum from its peak, and longest run of losses."""
    run = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy(*key).orderBy(*order)
    told = trades.withColumn("equity", F.sum(r).over(run)).withColumn("streak", F.sum(F.when(F.col(r) >= 0, 1).otherwise(0)).over(run))
    falls = told.withColumn("fall", F.greatest(F.max("equity").over(run), F.lit(0.0)) - F.col("equity")).withColumn("n", F.row_number().over(line))
    streaks = falls.groupBy(*key, "streak").agg(F.count_if(F.col(r) < 0).alias("losses"), F.max("fall").alias("fall"))
    return streaks.groupBy(*key).agg(F.max("fall").alias("max_drawdown"), F.max("losses").alias("loss_streak"))
