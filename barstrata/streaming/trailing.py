"""Trailing figures of a stream of bars that come late and are revised.

State of a series is a ring of its last bars. A bar that is new, late or revised is put in
its place; the bars whose figures change are told again under the next revision, so that the
latest revision of each bar is what a batch over the final bars gives. A bar that turns out
to be none is withdrawn: it comes without prices, and its last revision has none. A timer
tells that a series has stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.joins import latest
from ..sources.candles import TF_SECONDS
from .bars import run_to_end

#: Bars of the trailing mean and of the mean volume before a bar; bars beside a pivot.
WINDOW, PIVOT = 20, 2
#: Bars held before the first that may still change: those that its neighbours' figures reach.
BEFORE = WINDOW + PIVOT
#: Times of a bar's length after which a series without a new one is stale.
STALE_BARS = 2

_RING = "open_ts long, high double, low double, close double, volume double, sma double, rvol double, pivot string, stale boolean, revision long"
_OUT = f"symbol string, {_RING}"
_NAMES = [c.split()[0] for c in _RING.split(", ")]
_FIGURES = ("sma", "rvol", "pivot", "stale")
_PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _same(a, b) -> bool:
    return a == b or (a is None and b is None) or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0))


def _live(ring: list[dict]) -> list[dict]:
    """The bars that are not withdrawn."""
    return [x for x in ring if x["close"] is not None]


def figures(ring: list[dict], step: int) -> list[dict]:
    """The figures of each bar of the ring; None where the ring holds too few bars before."""
    close, volume = np.array([x["close"] for x in ring]), np.array([x["volume"] for x in ring])
    high, low = np.array([x["high"] for x in ring]), np.array([x["low"] for x in ring])
    out = []
    for k, x in enumerate(ring):
        sma = float(close[k - WINDOW + 1 : k + 1].mean()) if k >= WINDOW - 1 else None
        base = volume[k - WINDOW : k].mean() if k >= WINDOW else 0.0
        pivot = None
        if PIVOT <= k < len(ring) - PIVOT:
            near = [k + o for o in range(-PIVOT, PIVOT + 1) if o]
            top, bottom = all(high[k] > high[near]), all(low[k] < low[near])
            pivot = "BOTH" if top and bottom else "HIGH" if top else "LOW" if bottom else None
        # A series that has stopped is told by the timer; a gap by the bar after it.
        stale = ring[k + 1]["open_ts"] > x["open_ts"] + STALE_BARS * step if k + 1 < len(ring) else bool(x["stale"])
        out.append({"sma": sma, "rvol": float(volume[k] / base) if base > 0 else None, "pivot": pivot, "stale": stale})
    return out


class Trailing(StatefulProcessor):
    """Ring of the last ``late`` bars of a series, withdrawn ones too, and ``BEFORE`` bars before them.

    Bars before the last ``late`` ones are too late and are not taken.
    """

    def __init__(self, tf: str, late: int):
        self.step, self.late = TF_SECONDS[tf], late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", _RING)
        self.cut = handle.getValueState("cut", "since long, timer long")

    def _load(self) -> tuple[list[dict], int | None, int | None]:
        """The ring, the first time that is still taken (None: any) and the timer's."""
        ring = [dict(zip(_NAMES, x, strict=True)) for x in self.ring.get()] if self.ring.exists() else []
        since, timer = self.cut.get() if self.cut.exists() else (None, None)
        return ring, since, timer

    def _tell(self, symbol: str, ring: list[dict], since: int | None, changed: set[int]) -> pd.DataFrame:
        """The bars whose figures are new or differ, and those withdrawn; the ring keeps what was told."""
        gone = [x for x in ring if x["close"] is None and x["open_ts"] in changed]
        for x in gone:
            x.update(dict.fromkeys(_FIGURES), revision=x["revision"] + 1)
        out = [{"symbol": symbol, **x} for x in gone]
        # Bars at the ring's cut end are context only: they were told before, and what comes
        # later changes no figure but the pivots of the last of them and their gaps.
        live = _live(ring)
        first = 0 if since is None else max(0, sum(x["open_ts"] < since for x in live) - PIVOT)
        for k, (x, now) in enumerate(zip(live, figures(live, self.step), strict=True)):
            if k < first:
                continue
            if x["open_ts"] in changed or not all(_same(x[f], now[f]) for f in _FIGURES):
                x.update(now, revision=x["revision"] + 1)
                out.append({"symbol": symbol, **x})
        return pd.DataFrame(out, columns=["symbol", *_NAMES])

    def _keep(self, ring: list[dict], since: int | None, timer: int | None) -> None:
        self.ring.put([tuple(x[n] for n in _NAMES) for x in ring])
        self.cut.update((since, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (symbol,) = key
        ring, since, timer = self._load()
        held = {x["open_ts"]: x for x in ring}
        came = pd.concat(rows).sort_values(["open_ts", "version"])
        changed = set()
        for x in came.itertuples(index=False):
            ts = int(x.open_ts)
            if since is not None and ts < since:
                continue
            if pd.isna(x.close):
                bar = dict.fromkeys(("high", "low", "close", "volume"))
            else:
                bar = {"high": float(x.high), "low": float(x.low), "close": float(x.close), "volume": float(x.volume)}
            old = held.get(ts)
            if old is None:
                if bar["close"] is None:
                    continue
                held[ts] = {"open_ts": ts, **bar, "sma": None, "rvol": None, "pivot": None, "stale": False, "revision": 0}
                changed.add(ts)
            elif any(old[n] != v for n, v in bar.items()):
                old.update(bar)
                changed.add(ts)
        # A bar that came and was withdrawn at once was never told.
        ring = [held[ts] for ts in sorted(held) if held[ts]["revision"] or held[ts]["close"] is not None]
        out = self._tell(symbol, ring, since, changed)
        if len(ring) > self.late + BEFORE:
            since = ring[-self.late]["open_ts"]
            ring = _live(ring[: -self.late])[-BEFORE:] + ring[-self.late :]
        live = _live(ring)
        due = (live[-1]["open_ts"] + (1 + STALE_BARS) * self.step) * 1000 + 1 if live else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self._keep(ring, since, due)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (symbol,) = key
        ring, since, _ = self._load()
        out, live = pd.DataFrame([], columns=["symbol", *_NAMES]), _live(ring)
        if live and not live[-1]["stale"]:
            live[-1].update(stale=True, revision=live[-1]["revision"] + 1)
            out = pd.DataFrame([{"symbol": symbol, **live[-1]}], columns=["symbol", *_NAMES])
        self._keep(ring, since, None)
        yield out

    def close(self) -> None:
        pass


def trailing(bars: DataFrame, tf: str, late: int = 200) -> DataFrame:
    """The revisions of a stream of bars (symbol, open_ts, high, low, close, volume, version, imported_at).

    Of rows of one bar in a micro-batch the highest version counts, between micro-batches the
    later one. A null close withdraws the bar. Bars more than ``late`` bars behind their series'
    last are not taken. State is bounded by ``late`` plus the window, whatever the stream's
    length. The watermark is that of ``imported_at``, in seconds, as a bar that comes late is
    not imported late.
    """
    timed = bars.withColumn("imported", F.timestamp_seconds("imported_at")).withWatermark("imported", "0 seconds")
    return timed.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Trailing(tf, late), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )


def run_trailing(bars: DataFrame, tf: str, folder: str, late: int = 200) -> DataFrame:
    """Run the stream over all files there are now; the latest revision of each bar so far that is not withdrawn.

    A later run goes on from the state in ``folder``.
    """
    spark = bars.sparkSession
    before = {key: spark.conf.get(key, None) for key in _PROVIDER}
    for key, value in _PROVIDER.items():
        spark.conf.set(key, value)
    try:
        told = run_to_end(trailing(bars, tf, late), folder)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return latest(told, ["symbol", "open_ts"], ["revision"]).where("close is not null")
