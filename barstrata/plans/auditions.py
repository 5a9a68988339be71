"""Queries that put factors on trial against the book's trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts as H
from ..operators import structure as X
from ..streaming.bars import written
from .catalog import ORACLES, query
from .decisions import _bars, _on_book, settled
from .evidence import ribbon_changes
from .market import atr_changes, divergences, rvol_changes, squeeze_changes, vwap_changes

STEP = 3600
# Which side a reading argues for, and the depths below or above the fast average in ATR.
PLACE, STACK, GAP = {"ABOVE": "LONG", "BELOW": "SHORT"}, {"BULL": "LONG", "BEAR": "SHORT"}, {"BULL": "LONG", "BEAR": "SHORT"}
DIVERGENCE = {"BULLISH": "LONG", "BEARISH": "SHORT"}
DEPTHS = ((0.5, "shallow<0.5"), (1.5, "medium0.5-1.5"), (None, "deep>=1.5"))

_OPEN_GAPS = f"""
, gx AS (
  SELECT x.symbol, x.direction, b.i, x.market_time + {STEP} AS born, z.open_ts + {STEP} AS gone
  FROM ({ORACLES['fvg']}) x JOIN ba b ON b.symbol = x.symbol AND b.open_ts = x.market_time LEFT JOIN ba z ON z.symbol = x.symbol AND z.i = b.i + x.fill_lag),
gt AS (SELECT DISTINCT symbol, unnest([born, gone]) AS known FROM gx),
go AS (
  SELECT * FROM (SELECT symbol, known, (SELECT max((g.born, g.direction)) FROM gx g WHERE g.symbol = gt.symbol AND g.born <= known AND (g.gone IS NULL OR g.gone > known))[2] AS state FROM gt WHERE known IS NOT NULL)
  WHERE state IS NOT NULL)"""
_EVENTS = {"ma_ribbon_events": (("ma_position", "x.position"), ("ma_stack", "x.stack")), "vwap_cross": (("vwap_side", "x.side"),),
           "squeeze_events": (("squeeze", "x.state"),), "atr_regime_events": (("atr_regime", "x.state"),), "rvol_events": (("rvol", "x.state"),)}
_READINGS = _OPEN_GAPS + """,
fx AS (
  """ + "\n  UNION ALL ".join(
    f"SELECT x.symbol, '{name}' AS factor, ba.open_ts + {STEP} AS known, {state} AS state FROM ({ORACLES[table]}) x JOIN ba USING (symbol, i)"
    for table, readings in _EVENTS.items() for name, state in readings
) + f"""
  UNION ALL SELECT x.symbol, 'ma_depth', ba.open_ts + {STEP}, ((ba.close - e.ema20) / ba.atr)::VARCHAR FROM ({ORACLES['ma_ribbon_events']}) x JOIN ba USING (symbol, i) JOIN ({ORACLES['ema20']}) e USING (symbol, i)
  UNION ALL SELECT symbol, 'open_gap', known, state FROM go),
fn AS (SELECT unnest(['ma_position', 'ma_stack', 'vwap_side', 'squeeze', 'atr_regime', 'rvol', 'ma_depth', 'open_gap']) AS factor),
ra AS (
  SELECT bk.setup_id, bk.direction, bk.r_multiple, fn.factor,
    (SELECT max((f.known, f.state)) FROM fx f WHERE f.symbol = bk.s AND f.factor = fn.factor AND f.known <= bk.market_time + {STEP} AND f.known >= bk.market_time + {STEP} - {H.WINDOW_BARS * STEP})[2] AS state
  FROM book bk, fn),
co AS (
  SELECT *, coalesce(CASE
    WHEN factor = 'ma_depth' THEN CASE WHEN abs(state::DOUBLE) < 0.5 THEN 'shallow<0.5' WHEN abs(state::DOUBLE) < 1.5 THEN 'medium0.5-1.5' WHEN state IS NOT NULL THEN 'deep>=1.5' END
    WHEN factor IN ('squeeze', 'atr_regime', 'rvol') THEN state
    WHEN state IN ('ABOVE', 'BULL') THEN CASE direction WHEN 'LONG' THEN 'AGREES' ELSE 'OPPOSES' END
    WHEN state IN ('BELOW', 'BEAR') THEN CASE direction WHEN 'SHORT' THEN 'AGREES' ELSE 'OPPOSES' END END, 'NONE') AS cohort
  FROM ra)"""
_FIGURES = f"count(*) AS n, round(sum(r_multiple), 6) AS total_r, CASE WHEN count(*) >= {H.MIN_COHORT} THEN round(avg(r_multiple), 6) END AS mean_r"


def _open_gaps(bars: DataFrame) -> DataFrame:
    times = bars.select("symbol", "tf", F.col("i").alias("filled_i"), (F.col("open_ts") + STEP).alias("gone"))
    gaps = X.gaps(bars).join(times, ["symbol", "tf", "filled_i"], "left")
    return written(gaps.select("symbol", "tf", "direction", (F.col("market_time") + STEP).alias("born"), "gone"), "open-gaps")


def _factors(bars: DataFrame) -> list[H.Factor]:
    at = (F.col("open_ts") + STEP).alias("known")
    ribbon = written(ribbon_changes(bars).withColumn("depth", ((F.col("close") - F.col("ema20")) / F.col("atr")).cast("string")), "ribbon")
    read = lambda frame, state: frame.select("symbol", "tf", at, F.col(state).alias("state"))
    return [
        H.Factor("ma_position", read(ribbon, "position"), PLACE),
        H.Factor("ma_stack", read(ribbon, "stack"), STACK),
        H.Factor("vwap_side", read(vwap_changes(bars), "side"), PLACE),
        H.Factor("squeeze", read(squeeze_changes(bars), "state")),
        H.Factor("atr_regime", read(atr_changes(bars), "state")),
        H.Factor("rvol", read(rvol_changes(bars), "state")),
        H.Factor("ma_depth", read(ribbon, "depth"), buckets=DEPTHS),
        H.Factor("open_gap", H.newest_open(_open_gaps(bars), STEP), GAP),
    ]


def _trades(bars: DataFrame) -> DataFrame:
    return settled(bars).select("symbol", "tf", "setup_id", "direction", "confirmed_at", "r_multiple")


@query("open_gap_side", _on_book(_OPEN_GAPS + " SELECT symbol || 'USDT' AS symbol, known, state FROM go"))
def open_gap_side(spark, d):
    """The direction of the youngest unfilled gap at each gap's birth and end."""
    return H.newest_open(_open_gaps(_bars(spark, d)), STEP).drop("tf")


@query("factor_cohorts", _on_book(_READINGS + f" SELECT factor, cohort, {_FIGURES} FROM co GROUP BY factor, cohort"))
def factor_cohorts(spark, d):
    """The book's trades by eight factors' cohorts, whose readings are ten bars old or less."""
    bars = _bars(spark, d)
    return H.graded(_trades(bars), _factors(bars), STEP)


@query("divergence_audition", _on_book(f"""
, dv AS (
  SELECT bk.setup_id, bk.direction, bk.r_multiple, bk.market_time + {STEP} AS at_ts,
    (SELECT max((v.confirmed_at, v.direction)) FROM ({ORACLES['divergence']}) v WHERE v.symbol = bk.s AND v.confirmed_at <= bk.market_time + {STEP}) AS v
  FROM book bk),
aw AS (
  SELECT dv.*, w AS window_bars, CASE WHEN at_ts - v[1] <= w * {STEP} THEN CASE WHEN (v[2] = 'BULLISH') = (direction = 'LONG') THEN 'AGREES' ELSE 'OPPOSES' END ELSE 'NONE' END AS cohort
  FROM dv, (SELECT unnest([5, 10, 20, 40]) AS w))
SELECT window_bars, cohort, {_FIGURES} FROM aw GROUP BY window_bars, cohort"""))
def divergence_audition(spark, d):
    bars = _bars(spark, d)
    found = divergences(bars).select("symbol", "tf", F.col("confirmed_at").alias("known"), F.col("direction").alias("state"))
    return H.audition(_trades(bars), H.Factor("divergence", found, DIVERGENCE), STEP)
