"""Adds to a running trade: structure that breaks its way once it is a risk ahead, with the stop at the parent's entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trading import SLIP_ATR, venue_value
from .execution import ENTRY_BARS, MAX_BARS, limit_fills
from .joins import held_window

# R that the parent must be ahead, the add's least reward to risk, its least risk in costs, adds a parent.
AHEAD_R, MIN_RR, RISK_IN_COSTS, MAX_ADDS = 1.0, 1.0, 2.0, 2


def scale_ins(parents: DataFrame, bars: DataFrame, breaks: DataFrame, horizon: int = MAX_BARS) -> DataFrame:
    """(symbol, tf, setup_id, parent_id, direction, order_i, entry, sl, tp, rr, fill_i, status) of the adds.

    ``parents`` have setup_id, direction, fill_i, entry, sl, tp and exit_i, null while open;
    no trade lives longer than ``horizon`` bars, so breaks meet it by bins of bars. A break
    counts from the parent's first bar to the one before its exit. The first ``MAX_ADDS``
    that pass every gate are adds: a resting order at the break's close, stopped at the
    parent's entry, with the parent's target. Costs are fees and slippage, without funding.
    """
    key = ["symbol", "tf"]
    closes = bars.select(*key, F.col("open_ts").alias("market_time"), "i", F.col("close").alias("price"), "atr")
    found = breaks.select(*key, "market_time", F.col("direction").alias("way")).join(closes, [*key, "market_time"])
    long = F.col("direction") == "LONG"
    sign = F.when(long, 1.0).otherwise(-1.0)
    seen = held_window(parents.select(*key, "setup_id", "direction", "fill_i", "entry", "sl", "tp", "exit_i"), found, "fill_i", horizon, ["way", "price", "atr"])
    ahead, risk, reward = sign * (F.col("price") - F.col("entry")), F.abs(F.col("price") - F.col("entry")), sign * (F.col("tp") - F.col("price"))
    fees = (venue_value(F.col("symbol"), "maker") + venue_value(F.col("symbol"), "taker")) * F.col("price")
    gates = (
        ((F.col("way") == "BULL") == long) & (F.col("exit_i").isNull() | (F.col("i") < F.col("exit_i")))
        & (ahead >= AHEAD_R * F.abs(F.col("entry") - F.col("sl"))) & F.col("atr").isNotNull() & (risk > 0)
        & (risk >= RISK_IN_COSTS * (fees + SLIP_ATR * F.col("atr"))) & (reward > 0) & (F.bround(reward / risk, 2) >= MIN_RR)
    )
    place = F.row_number().over(Window.partitionBy(*key, "setup_id").orderBy("i"))
    adds = seen.where(gates).withColumns({"rr": F.bround(reward / risk, 2), "n": place}).where(F.col("n") <= MAX_ADDS)
    told = adds.select(
        *key, F.concat("setup_id", F.lit("|ADD"), F.col("n").cast("string")).alias("setup_id"), F.col("setup_id").alias("parent_id"), "direction",
        (F.col("i") + 1).alias("order_i"), F.col("price").alias("entry"), F.col("entry").alias("sl"), "tp", "rr", F.col("price").alias("limit_price"),
    )
    return limit_fills(told, bars, ENTRY_BARS).drop("limit_price")
