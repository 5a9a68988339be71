"""Per-series primitives: indexed bars, rolling indicators, recurrences, state changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: The house tolerance of a close through a level: a tick, or this share of ATR.
TOLERANCE_ATR = 0.05


def by_time():
    """The window over one series in time order."""
    return Window.partitionBy("symbol", "tf").orderBy("open_ts")


def rows(a: int, b: int):
    return by_time().rowsBetween(a, b)


def quote_tick(*texts: str) -> Column:
    """Running tick size: 10 ** -d for the most fractional digits d quoted so far."""
    digits = F.greatest(*[F.length(F.regexp_extract(F.col(t), r"\.(\d*)$", 1)) for t in texts], F.lit(0))
    return F.pow(F.lit(10.0), -F.max(digits).over(rows(Window.unboundedPreceding, 0)))


def indexed(bars: DataFrame) -> DataFrame:
    """Adds i (bar number), true range tr and tick."""
    pc = F.lag("close").over(by_time())
    text = {f"__{c}": F.format_string("%.2f", c) for c in ("open", "high", "low", "close")}
    return (
        bars.withColumn("i", (F.row_number().over(by_time()) - 1).cast("long"))
        .withColumn("tr", F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))))
        .withColumns(text)
        .withColumn("tick", quote_tick(*text))
        .drop(*text)
    )


def _ema(values: np.ndarray, period: int) -> np.ndarray:
    """Seeded with the mean of the first ``period`` values; NaN before."""
    out, k = np.full(len(values), np.nan), 2 / (period + 1)
    first = int(np.argmax(~np.isnan(values))) if len(values) and not np.isnan(values).all() else len(values)
    at = first + period - 1
    if at >= len(values):
        return out
    last = out[at] = values[first : at + 1].sum() / period
    for j in range(at + 1, len(values)):
        last = out[j] = last + k * (values[j] - last)
    return out


def _wilder(tr: np.ndarray, period: int = 14) -> np.ndarray:
    out = np.full(len(tr), np.nan)
    if len(tr) <= period:
        return out
    last = out[period] = tr[1 : period + 1].sum() / period
    for j in range(period + 1, len(tr)):
        last = out[j] = (last * (period - 1) + tr[j]) / period
    return out


def _rsi(close: np.ndarray, period: int = 14) -> np.ndarray:
    """Wilder's; NaN where nothing moved, 100 without losses."""
    out = np.full(len(close), np.nan)
    if len(close) <= period:
        return out
    move = np.diff(close)
    gain, loss = np.maximum(move, 0), np.maximum(-move, 0)
    g, l = gain[:period].sum() / period, loss[:period].sum() / period
    for j in range(period, len(close)):
        if j > period:
            g, l = (g * (period - 1) + gain[j - 1]) / period, (l * (period - 1) + loss[j - 1]) / period
        out[j] = np.nan if g == 0 and l == 0 else 100.0 if l == 0 else 100 - 100 / (1 + g / l)
    return out


def _recur(frame: pd.DataFrame) -> pd.DataFrame:
    close = frame["close"].to_numpy(float)
    macd = _ema(close, 12) - _ema(close, 26)
    return frame.assign(
        atr=_wilder(frame["tr"].to_numpy(float)),
        ema20=_ema(close, 20),
        ema50=_ema(close, 50),
        rsi=_rsi(close),
        macd=macd,
        signal=_ema(macd, 9),
    )


RECURRENCES = ("atr", "ema20", "ema50", "rsi", "macd", "signal")
#: Bars of a slice, and bars before it that it reads as well.
SLICE, HALO = 16384, 2048


def with_recurrences(bars: DataFrame, size: int = SLICE, halo: int = HALO) -> DataFrame:
    """Adds atr, ema20, ema50, rsi, macd and signal to indexed bars, null while warming up.

    Each depends on its own last value and forgets it: over ``halo`` bars the longest,
    ema50, by (49 / 51) ** 2048 < 1e-35, far below a double's last digit. So a series is
    cut into slices of ``size`` bars that start ``halo`` bars early, and one long series
    is many tasks, with an eighth of its bars read twice. Only a series that has not moved
    at all for ``halo`` bars tells the difference: its rsi is null again, as at its start.
    """
    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        told = _recur(frame.sort_values("i"))
        return told[told["i"] // size == key[2]].drop(columns="__slice")

    slices = F.sequence(F.floor(F.col("i") / size), F.floor((F.col("i") + halo) / size))
    schema = StructType([*bars.schema.fields, *(StructField(name, DoubleType()) for name in RECURRENCES)])
    out = bars.withColumn("__slice", F.explode(slices)).groupBy("symbol", "tf", "__slice").applyInPandas(fold, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in RECURRENCES})


def analysed(bars: DataFrame) -> DataFrame:
    """Indexed bars with recurrences and ``tol``, the break tolerance."""
    return with_recurrences(indexed(bars)).withColumn("tol", F.greatest(F.col("tick"), TOLERANCE_ATR * F.col("atr")))


def warm(value: Column, period: int) -> Column:
    return F.when(F.col("i") >= period - 1, value)


def sma(column: str, period: int) -> Column:
    return warm(F.avg(column).over(rows(1 - period, 0)), period)


def bollinger(period: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid = F.avg("close").over(rows(1 - period, 0))
    spread = width * F.stddev_pop("close").over(rows(1 - period, 0))
    return {"bb_mid": warm(mid, period), "bb_upper": warm(mid + spread, period), "bb_lower": warm(mid - spread, period)}


def keltner(width: float = 1.5) -> dict[str, Column]:
    return {"kc_upper": F.col("ema20") + width * F.col("atr"), "kc_lower": F.col("ema20") - width * F.col("atr")}


def midrank(column: str, period: int = 100) -> Column:
    """Midrank percentile of a value among the last ``period``, itself included."""
    seen = F.collect_list(column).over(rows(1 - period, 0))
    below = F.size(F.filter(seen, lambda x: x < F.col(column)))
    upto = F.size(F.filter(seen, lambda x: x <= F.col(column)))
    return F.when((F.size(seen) == period) & F.col(column).isNotNull(), 100.0 * (below + upto) / (2 * period))


def relative_volume(period: int = 20) -> Column:
    """Volume over the mean of the ``period`` bars before it."""
    base = F.avg("volume").over(rows(-period, -1))
    return F.when((F.col("i") >= period) & (base > 0), F.col("volume") / base)


def schmitt(value: Column, arms: dict[str, tuple[Column, Column]], rest: str) -> Column:
    """The state of a two-sided trigger: ``arms`` maps a state to (enter, hold).

    In a hold band the state is the arm's iff the last bar outside the band entered
    it; so the fold is a last non-null value over the rows so far.
    """
    state = F.when(value.isNotNull(), F.lit(rest))
    for name, (enter, hold) in arms.items():
        armed = F.last(F.when(enter, True).when(~hold, False), ignorenulls=True).over(rows(Window.unboundedPreceding, 0))
        state = F.when(value.isNotNull() & (enter | (hold & F.coalesce(armed, F.lit(False)))), F.lit(name)).otherwise(state)
    return state


def latch(sign: Column, window=None) -> Column:
    """The last non-null sign so far."""
    return F.last(sign, ignorenulls=True).over((window or by_time()).rowsBetween(Window.unboundedPreceding, 0))


def changes(frame: DataFrame, state: str) -> DataFrame:
    """The rows where ``state`` differs from the last known one, with ``from`` and
    ``bars_in_prev``; rows whose state is unknown are passed over. The first known
    state is not a change of one."""
    known = frame.where(F.col(state).isNotNull())
    prev = F.lag(state).over(by_time())
    moved = known.withColumn("from", prev).where(F.col("from").isNull() | (F.col("from") != F.col(state)))
    return moved.withColumn("bars_in_prev", F.col("i") - F.lag("i").over(by_time()))


def session_start(tf: str) -> Column:
    """UTC day for intraday bars; the Monday week for 4H and 1D."""
    from ..sources.candles import bucket_start

    return bucket_start(F.col("open_ts"), "1W" if tf in ("4H", "1D") else "1D")


def session_vwap(bars: DataFrame, tf: str) -> DataFrame:
    """Adds session, session_bars and vwap, which is known from the third bar on."""
    run = Window.partitionBy("symbol", "tf", "session").orderBy("open_ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumn("session", session_start(tf)).withColumn("typical", typical)
    return out.withColumn("session_bars", F.count("*").over(run)).withColumn(
        "vwap", F.when(F.col("session_bars") >= 3, F.sum(F.col("typical") * F.col("volume")).over(run) / F.sum("volume").over(run))
    )


def price_bin(p: Column) -> Column:
    """Integer bin of the four leading digits: 9000 a decade."""
    power = F.floor(F.log10(p) + F.lit(1e-12))
    return (power * 9000 + F.floor(p * F.pow(F.lit(10.0), 3 - power) + F.lit(1e-9)) - 1000).cast("long")


def rolling_poc(bars: DataFrame, period: int = 100) -> DataFrame:
    """(symbol, tf, i, open_ts, poc_bin, share): the bin with the most volume of the
    last ``period`` bars; of equal ones the higher."""
    base = bars.select("symbol", "tf", "i", price_bin((F.col("high") + F.col("low") + F.col("close")) / 3).alias("bin"), "volume")
    # Every bar gives its volume to the windows of itself and the next period - 1 bars.
    spread = base.select("symbol", "tf", "bin", "volume", F.explode(F.sequence(F.col("i"), F.col("i") + period - 1)).alias("i"))
    sums = spread.groupBy("symbol", "tf", "i", "bin").agg(F.sum("volume").alias("v"))
    best = sums.groupBy("symbol", "tf", "i").agg(F.max(F.struct("v", "bin")).alias("top"), F.sum("v").alias("all"))
    return (
        bars.where(F.col("i") >= period - 1)
        .select("symbol", "tf", "i", "open_ts")
        .join(best, ["symbol", "tf", "i"])
        .select("symbol", "tf", "i", "open_ts", F.col("top.bin").alias("poc_bin"), (F.col("top.v") / F.col("all")).alias("share"))
    )
