"""Pure trading arithmetic as column expressions: venues, costs, sizing, labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Maker and taker rates, settlements a day, shorts, leverage cap.
VENUES = {
    "coinbase-spot": (0.0040, 0.0060, 0, False, 1.0),
    "phemex-perp": (0.0001, 0.0006, 3, True, 10.0),
    "kraken-perp": (0.0002, 0.0005, 24, True, 10.0),
}
SLIP_ATR = 0.05
FUNDING_RATE = 1e-4
# Hours of a cooldown by horizon, after a stop and after any other end,
# the horizon of a timeframe, and the side of a regime.
COOLDOWN_HOURS = {"scalp": (4.0, 0.25), "intraday": (12.0, 0.5), "swing": (24.0, 1.0)}
HORIZONS = {"5m": "scalp", "15m": "scalp", "1H": "intraday", "4H": "intraday", "1D": "swing", "1W": "swing"}
REGIME_SIDES = {
    "BULL_TREND": "UP",
    "WEAKENING_BULL": "UP",
    "BEAR_TREND": "DOWN",
    "WEAKENING_BEAR": "DOWN",
    "RANGE": "FLAT",
    "TRANSITION": "FLAT",
}


def _pick(key: Column, table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def sig8(x: Column) -> Column:
    """Rounded half-even to eight significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), 7 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.bround(x * scale, 0) / scale)


def venue_for(symbol: Column) -> Column:
    return (
        F.when(symbol.rlike(r"^PF_.*USD$"), "kraken-perp")
        .when(symbol.endswith("-USD"), "coinbase-spot")
        .when(symbol.endswith("USDT"), "phemex-perp")
    )


def base_asset(symbol: Column) -> Column:
    """The underlying, with the aliases XBT and XDG resolved."""
    base = F.regexp_replace(symbol, r"^PF_|-USD$|USDT$|USD$", "")
    return F.when(base == "XBT", "BTC").when(base == "XDG", "DOGE").otherwise(base)


def venue_value(symbol: Column, what: str) -> Column:
    at = ("maker", "taker", "settlements", "shorts", "leverage").index(what)
    return _pick(venue_for(symbol), {k: v[at] for k, v in VENUES.items()})


def liquidation_price(entry: Column, leverage: Column, long: Column, maintenance: float = 0.005) -> Column:
    """Isolated margin; null at no leverage."""
    edge = 1 / leverage - maintenance
    price = F.when(edge <= 0, entry).otherwise(F.when(long, entry * (1 - edge)).otherwise(entry * (1 + edge)))
    return F.when(leverage > 1, price)


def stop_survives(entry: Column, stop: Column, leverage: Column, long: Column) -> Column:
    at = liquidation_price(entry, leverage, long)
    return F.when(at.isNull(), True).otherwise(F.when(long, stop > at).otherwise(stop < at))


def funding_rate(symbol: Column, hours: Column, rate: float = FUNDING_RATE) -> Column:
    per_day = venue_value(symbol, "settlements")
    return F.when(per_day > 0, rate * hours / (24 / per_day)).otherwise(F.lit(0.0))


def round_trip_cost(symbol: Column, entry: Column, atr: Column, tf_seconds: int | Column) -> Column:
    """Estimate of fees, slippage and ten bars' funding."""
    fees = (venue_value(symbol, "maker") + venue_value(symbol, "taker")) * entry
    return fees + SLIP_ATR * atr + funding_rate(symbol, F.lit(10 * tf_seconds / 3600)) * entry


def cooldown_hours(outcome: Column, tf: Column) -> Column:
    horizon = _pick(tf, HORIZONS)
    stop = _pick(horizon, {k: v[0] for k, v in COOLDOWN_HOURS.items()})
    return F.when(outcome == "SL", stop).otherwise(_pick(horizon, {k: v[1] for k, v in COOLDOWN_HOURS.items()}))


def composite(sides: Column) -> Column:
    """One side of several rungs: MIXED if both, UNKNOWN if none is measured."""
    known = F.filter(sides, lambda s: s.isNotNull())
    up, down = F.array_contains(known, "UP"), F.array_contains(known, "DOWN")
    return (
        F.when(F.size(known) == 0, "UNKNOWN").when(up & down, "MIXED").when(up, "UP").when(down, "DOWN").otherwise("FLAT")
    )


def alignment(side: Column, direction: Column) -> Column:
    ahead = F.when(direction == "LONG", "UP").otherwise("DOWN")
    return F.when(side.isin("MIXED", "FLAT", "UNKNOWN"), side).when(side == ahead, "WITH").otherwise("AGAINST")


def regime_side(regime: Column) -> Column:
    return _pick(regime, REGIME_SIDES)


def playbook(zone_type: Column, regime: Column, evidence: Column) -> Column:
    """struct(strategy, direction, rank) of a touched zone, or null."""
    play = lambda s, d, r: F.struct(F.lit(s).alias("strategy"), F.lit(d).alias("direction"), F.lit(r).alias("rank"))
    demand, supply = zone_type == "DEMAND", zone_type == "SUPPLY"
    return (
        F.when(demand & regime.isin("BULL_TREND", "WEAKENING_BULL"), play("PULLBACK", "LONG", 50))
        .when(demand & (regime == "TRANSITION") & evidence, play("REVERSAL", "LONG", 40))
        .when(supply & regime.isin("BEAR_TREND", "WEAKENING_BEAR"), play("PULLBACK", "SHORT", 50))
        .when(supply & (regime == "TRANSITION") & evidence, play("REVERSAL", "SHORT", 40))
    )


def confirms(long: Column, top: Column, bottom: Column, open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """The bar engages the zone, closes out of it and closes in its own outer third."""
    h, l, c = F.col(high), F.col(low), F.col(close)
    span = h - l
    up = (l <= top) & (c > top) & ((span <= 0) | (c >= l + 0.66 * span))
    down = (h >= bottom) & (c < bottom) & ((span <= 0) | (c <= h - 0.66 * span))
    return F.when(long, up).otherwise(down)


@dataclass(frozen=True)
class Gates:
    """The account's limits of one mode; fixed values."""

    risk_pct: float = 0.02
    open_risk_r: float = 2.0
    daily_loss_r: float = 4.0
    concurrent: int = 1
    min_reduced: float = 0.25
    min_notional: float = 1.0
    participation: float = 0.005
    max_drawdown: float = 0.2


def size_order(equity: Column, entry: Column, stop: Column, symbol: Column, long: Column, open_risk: Column, gates: Gates = Gates()) -> Column:
    """struct(decision, reason, risk_usd, units, leverage) of one order."""
    intended = F.bround(equity * gates.risk_pct, 2)
    budget = F.bround(gates.open_risk_r * gates.risk_pct * equity - open_risk, 2)
    distance = F.abs(entry - stop)
    reduced = F.least(intended, budget)
    raw = reduced / distance * entry / equity
    cap = venue_value(symbol, "leverage")
    risk = F.when(raw > cap, F.bround(reduced * cap / raw, 2)).otherwise(reduced)
    leverage = F.least(raw, cap)
    units = risk / distance
    reason = (
        F.when(distance <= 0, "INVALID_STOP_DISTANCE")
        .when(budget < intended * gates.min_reduced, "EXPOSURE_LIMIT")
        .when(~stop_survives(entry, stop, leverage, long), "STOP_BEYOND_LIQUIDATION")
        .when(units * entry < gates.min_notional, "BELOW_MIN_NOTIONAL")
    )
    changed = F.when(raw > cap, "LEVERAGE_CAP").when(budget < intended, "EXPOSURE_LIMIT")
    return F.struct(
        F.when(reason.isNotNull(), "REJECTED").when(changed.isNotNull(), "REDUCED").otherwise("APPROVED").alias("decision"),
        F.coalesce(reason, changed, F.lit("WITHIN_LIMITS")).alias("reason"),
        F.when(reason.isNull(), risk).otherwise(0.0).alias("risk_usd"),
        F.when(reason.isNull(), units).otherwise(0.0).alias("units"),
        F.when(reason.isNull(), leverage).otherwise(0.0).alias("leverage"),
    )


_A, _C, _SEED = 6364136223846793005, 1442695040888963407, 0x2545F4914F6CDD1D


def lcg_indices(n: int, draws: int) -> np.ndarray:
    """``draws`` numbers below n of the fixed linear congruential sequence.

    State k + m follows from state k by one multiplication and addition, so a block
    of states is made at once from the block before.
    """
    mask, block = (1 << 64) - 1, 1 << 14
    mult, add, first, s = 1, 0, [], _SEED
    for _ in range(min(block, draws)):
        s = (s * _A + _C) & mask
        first.append(s)
        mult, add = mult * _A & mask, (add * _A + _C) & mask
    states = np.empty(draws, np.uint64)
    now = np.array(first, np.uint64)
    for at in range(0, draws, block):
        part = now[: draws - at]
        states[at : at + len(part)] = part
        now = now * np.uint64(mult) + np.uint64(add)
    return ((states >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def bootstrap_mean(values: np.ndarray, resamples: int) -> tuple[float, float, float]:
    """(low, high, share above 0) of the means of fixed resamples; 95 percent interval."""
    picked = values[lcg_indices(len(values), len(values) * resamples)].reshape(resamples, len(values))
    means = np.sort(picked.cumsum(axis=1)[:, -1] / len(values))
    return float(means[int(0.025 * resamples)]), float(means[int(0.975 * resamples)]), float((means > 0).mean())
