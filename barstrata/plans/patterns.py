"""Range, cycle and trend queries: choices that each depend on the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cycles as Y
from ..operators import ranges as R
from ..operators import series as S
from ..operators import swings as W
from ..operators import trend as G
from ..sources import candles as C
from ..streaming.bars import written
from .catalog import query
from .evidence import _NAMES, _named
from .market import _shared
from .setups import structure_facts
from .sql import ema_cte, with_tables
from .store import kept

_RANGES = """
, rc0 AS (
  SELECT symbol, row_number() OVER s AS k, market_time, confirmed_at, i, atr, count(*) OVER w AS n, min(market_time) OVER w AS first_ts, min(i) OVER w AS first_i,
    max(CASE WHEN kind = 'HIGH' THEN price END) OVER w AS top, min(CASE WHEN kind = 'LOW' THEN price END) OVER w AS bottom,
    min(CASE WHEN kind = 'HIGH' THEN price END) OVER w AS top_low, max(CASE WHEN kind = 'LOW' THEN price END) OVER w AS bottom_high,
    count(CASE WHEN kind = 'HIGH' THEN 1 END) OVER w AS n_top, count(CASE WHEN kind = 'LOW' THEN 1 END) OVER w AS n_bottom
  FROM alt WINDOW s AS (PARTITION BY symbol ORDER BY market_time, kind), w AS (PARTITION BY symbol ORDER BY market_time, kind ROWS 3 PRECEDING)),
rc AS (
  SELECT r.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = r.symbol AND x.i > r.i AND (x.close > top + coalesce(x.tol, 0.01) OR x.close < bottom - coalesce(x.tol, 0.01))) AS break_i
  FROM rc0 r WHERE n = 4 AND atr > 0 AND top - bottom BETWEEN atr AND 8 * atr AND top - top_low <= 0.25 * atr AND bottom_high - bottom <= 0.25 * atr
    AND NOT EXISTS (SELECT 1 FROM ba x WHERE x.symbol = r.symbol AND x.i BETWEEN r.first_i AND r.i AND (x.close > top + coalesce(x.tol, 0.01) OR x.close < bottom - coalesce(x.tol, 0.01)))),
rn AS (
  SELECT r.*, b.open_ts AS break_ts, b.close AS break_close, (SELECT min(o.k) FROM rc o WHERE o.symbol = r.symbol AND o.first_ts > b.open_ts) AS next_k
  FROM rc r LEFT JOIN ba b ON b.symbol = r.symbol AND b.i = r.break_i),
rw AS (
  SELECT symbol, min(k) AS k FROM rn GROUP BY symbol
  UNION ALL
  SELECT rn.symbol, rn.next_k FROM rw JOIN rn ON rn.symbol = rw.symbol AND rn.k = rw.k WHERE rn.next_k IS NOT NULL),
ra AS (SELECT rn.*, symbol || '|1H|RANGE|' || market_time AS range_id, round_even((top - bottom) / atr, 2) AS height_atr FROM rw JOIN rn USING (symbol, k)),
rb AS (
  SELECT a.*, x.i AS j, x.open_ts AS ts, x.high >= top - 0.25 * a.atr AS at_top, x.low <= bottom + 0.25 * a.atr AS at_bottom
  FROM ra a JOIN ba x ON x.symbol = a.symbol AND x.i >= a.i AND (a.break_i IS NULL OR x.i < a.break_i)),
rt0 AS (SELECT *, lag(at_top) OVER w AS was_top, lag(at_bottom) OVER w AS was_bottom FROM rb WINDOW w AS (PARTITION BY range_id ORDER BY j)),
rt AS (
  SELECT *, row_number() OVER w AS episode, count(*) FILTER (side = 'TOP') OVER (w ROWS UNBOUNDED PRECEDING) AS tops,
    count(*) FILTER (side = 'BOTTOM') OVER (w ROWS UNBOUNDED PRECEDING) AS bottoms
  FROM (SELECT *, 'TOP' AS side, 0 AS o FROM rt0 WHERE at_top AND NOT was_top UNION ALL SELECT *, 'BOTTOM', 1 FROM rt0 WHERE at_bottom AND NOT was_bottom)
  WINDOW w AS (PARTITION BY range_id ORDER BY j, o))
SELECT symbol, range_id, 'FORMED' AS event, market_time, confirmed_at, top, bottom, height_atr, NULL AS side, 0 AS episode, n_top AS top_touches, n_bottom AS bottom_touches, 0 AS bars_held FROM ra
UNION ALL
SELECT symbol, range_id, 'TESTED', ts, greatest(ts + 3600, confirmed_at), top, bottom, height_atr, side, episode, n_top + tops, n_bottom + bottoms, j - i FROM rt WHERE episode <= 10
UNION ALL
SELECT symbol, range_id, 'BROKEN', break_ts, greatest(break_ts + 3600, confirmed_at), top, bottom, height_atr, CASE WHEN break_close > top THEN 'TOP' ELSE 'BOTTOM' END,
  (SELECT count(*) FROM rt WHERE rt.range_id = ra.range_id), n_top + (SELECT count(*) FROM rt WHERE rt.range_id = ra.range_id AND side = 'TOP'),
  n_bottom + (SELECT count(*) FROM rt WHERE rt.range_id = ra.range_id AND side = 'BOTTOM'), break_i - i FROM ra WHERE break_i IS NOT NULL"""


@query("range_events", with_tables(_RANGES, "alt", "ba"))
def range_events(spark, d):
    """Ranges that form, are tested and break, one active range a series."""
    bars = _shared(spark, d)
    pivots = written(W.alternate(W.local(W.micro(bars))), "pivots")
    return R.range_events(written(R.ranges(pivots, bars), "ranges"), bars).drop("tf")


def _cycle_tables(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Daily bars, the accepted lows of both bands and the inversions; a series' seed is its
    first fractal low, as the test tables hold no accepted one."""

    def make() -> tuple[DataFrame, list[DataFrame], DataFrame]:
        bars = written(S.indexed(C.bars_from_ticks(C.lineitem_ticks(spark, d), "1D").where(C.is_sound())), "daily-bars")
        pool = written(Y.fractal_lows(bars), "fractal-lows")
        seeds = pool.groupBy("symbol", "tf").agg(F.min("at").alias("at"))
        daily, turned = Y.cycle_lows(pool, seeds, bars, Y.DAILY_DAYS, "DCL")
        weekly, turned_weeks = Y.cycle_lows(daily.select("symbol", "tf", "at", "low", "i"), seeds, bars, Y.WEEKLY_DAYS, "WCL")
        return bars, [daily, weekly], written(turned.unionByName(turned_weeks), "cycle-inversions")

    return kept(spark, f"{d}/lineitem.parquet", "cycles", make)


def _successor_cte(name: str, pool: str, first: int, last: int) -> str:
    return f"""{name}n AS (
  SELECT p.symbol, p.day, e.end_ts,
    (SELECT min((o.low, o.day)) FROM {pool} o WHERE o.symbol = p.symbol AND o.day BETWEEN p.day + {first} * 86400 AND p.day + {last} * 86400)[2] AS near,
    (SELECT min(o.day) FROM {pool} o WHERE o.symbol = p.symbol AND o.day > p.day + {last} * 86400) AS later
  FROM {pool} p JOIN ends e USING (symbol)),
{name} AS (
  SELECT symbol, day, near IS NULL AS late, near IS NULL AND day + {last + 2} * 86400 <= end_ts AS inverted,
    coalesce(near, CASE WHEN day + {last + 2} * 86400 <= end_ts THEN later END) AS nxt FROM {name}n)"""


_CYCLES = f"""WITH RECURSIVE t AS (
  SELECT l_returnflag AS symbol, floor(epoch(l_shipdate) / 86400)::BIGINT * 86400 AS day, round(l_extendedprice, 2) AS price,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o
  FROM lineitem WHERE l_extendedprice IS NOT NULL),
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i
  FROM (SELECT symbol, day, max(price) AS high, min(price) AS low, arg_max(price, o) AS close FROM t GROUP BY symbol, day) WHERE low > 0),
ends AS (SELECT symbol, max(day) AS end_ts FROM bars GROUP BY symbol),
fl AS (
  SELECT symbol, day, low, i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)
  QUALIFY low < lag(low, 1) OVER w AND low < lag(low, 2) OVER w AND low < lead(low, 1) OVER w AND low < lead(low, 2) OVER w),
{_successor_cte('ds', 'fl', 54, 66)},
dl AS (
  SELECT symbol, min(day) AS day, false AS late, true AS seed FROM fl GROUP BY symbol
  UNION ALL
  SELECT s.symbol, s.nxt, s.late, false FROM dl JOIN ds s ON s.symbol = dl.symbol AND s.day = dl.day WHERE s.nxt IS NOT NULL),
dc AS (SELECT dl.*, b.low, b.i FROM dl JOIN bars b USING (symbol, day)),
{_successor_cte('ws', 'dc', 150, 200)},
wl AS (
  SELECT symbol, min(day) AS day, false AS late, true AS seed FROM dc GROUP BY symbol
  UNION ALL
  SELECT s.symbol, s.nxt, s.late, false FROM wl JOIN ws s ON s.symbol = wl.symbol AND s.day = wl.day WHERE s.nxt IS NOT NULL),
lows AS (
  SELECT 'DCL' AS kind, dc.* FROM dc UNION ALL SELECT 'WCL', wl.*, b.low, b.i FROM wl JOIN bars b USING (symbol, day)),
inv AS (
  SELECT s.symbol, 'DCL_INVERSION' AS kind, s.day AS after_low, s.day + 54 * 86400 AS band_start, s.day + 66 * 86400 AS band_end FROM ds s JOIN dl USING (symbol, day) WHERE inverted
  UNION ALL
  SELECT s.symbol, 'WCL_INVERSION', s.day, s.day + 150 * 86400, s.day + 200 * 86400 FROM ws s JOIN wl USING (symbol, day) WHERE inverted),
legs AS (
  SELECT *, lead(day) OVER w AS end_day, lead(i) OVER w AS end_i, lead(late) OVER w AS late_end FROM lows WINDOW w AS (PARTITION BY symbol, kind ORDER BY day)),
cy AS (
  SELECT l.*, arg_max(b.i, (b.high, -b.i)) AS top_i, arg_max(b.day, (b.high, -b.i)) AS top_ts, max(b.high) AS top_price
  FROM legs l JOIN bars b ON b.symbol = l.symbol AND b.i BETWEEN l.i AND l.end_i WHERE l.end_i > l.i + 1 GROUP BY ALL),
cp AS (SELECT *, lag(top_price) OVER (PARTITION BY symbol, kind ORDER BY day) AS prev_top FROM cy),
cf AS (
  SELECT c.*, (SELECT min(b.i) FROM bars b WHERE b.symbol = c.symbol AND b.i > c.i AND b.i <= c.end_i AND b.close < c.low) AS down,
    (SELECT min(b.i) FROM bars b WHERE b.symbol = c.symbol AND b.i > c.i AND b.i <= c.end_i AND b.high > c.prev_top) AS up FROM cp c)
"""


@query("cycle_lows", _CYCLES + "SELECT symbol, kind, day AS market_time, low AS price, late, seed FROM lows")
def cycle_lows(spark, d):
    _, (daily, weekly), _ = _cycle_tables(spark, d)
    return daily.unionByName(weekly).select("symbol", "kind", F.col("at").alias("market_time"), F.col("low").alias("price"), "late", "seed")


@query("cycle_inversions", _CYCLES + "SELECT symbol, kind, after_low, band_start, band_end FROM inv")
def cycle_inversions(spark, d):
    return _cycle_tables(spark, d)[2].drop("tf")


@query("cycles", _CYCLES + """
SELECT symbol, kind, day AS start_ts, end_day AS end_ts, top_ts, top_price, round_even((top_i - i) / (end_i - i), 3) AS fraction,
  CASE WHEN (top_i - i) / (end_i - i) < 0.4 THEN 'left' WHEN (top_i - i) / (end_i - i) > 0.6 THEN 'right' ELSE 'mid' END AS translation,
  prev_top IS NOT NULL AND down IS NOT NULL AND (up IS NULL OR down < up) AS failed, late_end FROM cf""")
def cycles(spark, d):
    """Completed cycles of both bands: top, translation, failed flag."""
    bars, lows, _ = _cycle_tables(spark, d)
    daily, weekly = (Y.classified(x, bars) for x in lows)
    return daily.unionByName(weekly).drop("tf")


@query("cycle_summary", _CYCLES + """
SELECT l.symbol, l.kind, count(*) - 1 AS primary_count, count(*) - 1 + (SELECT count(*) FROM inv WHERE inv.symbol = l.symbol AND inv.kind = l.kind || '_INVERSION') AS inverted_count,
  max(l.day) AS last_low, ((SELECT end_ts FROM ends WHERE ends.symbol = l.symbol) - max(l.day)) // 86400 AS days_since,
  (SELECT count(*) FROM cf WHERE cf.symbol = l.symbol AND cf.kind = l.kind AND prev_top IS NOT NULL AND down IS NOT NULL AND (up IS NULL OR down < up)) AS failed
FROM lows l GROUP BY l.symbol, l.kind""")
def cycle_summary(spark, d):
    """Counts since the seed, with and without inversions, and where each series stands."""
    bars, lows, turned = _cycle_tables(spark, d)
    ends = bars.groupBy("symbol").agg(F.max("open_ts").alias("end_ts"))
    inverted = turned.groupBy("symbol", F.regexp_replace("kind", "_INVERSION", "").alias("kind")).agg(F.count("*").alias("n_inverted"))
    daily, weekly = (Y.classified(x, bars) for x in lows)
    failed = daily.unionByName(weekly).groupBy("symbol", "kind").agg(F.count_if("failed").alias("failed"))
    told = lows[0].unionByName(lows[1]).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.max("at").alias("last_low"))
    whole = told.join(inverted, ["symbol", "kind"], "left").join(failed, ["symbol", "kind"], "left").join(ends, "symbol")
    return whole.select(
        "symbol", "kind", (F.col("n") - 1).alias("primary_count"), (F.col("n") - 1 + F.coalesce("n_inverted", F.lit(0))).alias("inverted_count"), "last_low",
        F.floor((F.col("end_ts") - F.col("last_low")) / Y.DAY).alias("days_since"), F.coalesce("failed", F.lit(0)).alias("failed"),
    )


_TREND = f"""
, {ema_cte('e20', 20)}, {ema_cte('e50', 50)},
rb0 AS (
  SELECT ba.symbol, ba.i, ba.open_ts, ba.high, ba.low, ba.close, ba.atr, lead(ba.open) OVER w AS next_open, count(*) OVER (PARTITION BY ba.symbol) AS n,
    e20.v AS a, e50.v AS b, CASE WHEN ba.i >= 199 THEN avg(ba.close) OVER (w ROWS 199 PRECEDING) END AS c
  FROM ba LEFT JOIN e20 USING (symbol, i) LEFT JOIN e50 USING (symbol, i) WINDOW w AS (PARTITION BY ba.symbol ORDER BY ba.i)),
rb1 AS (
  SELECT *, n >= 210 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND atr > 0 AS ready, 0.25 * atr AS tol, greatest(a, b, c) AS top, least(a, b, c) AS bottom FROM rb0),
rb2 AS (
  SELECT *, CASE WHEN ready AND a > b + tol AND b > c + tol THEN 'LONG' WHEN ready AND a < b - tol AND b < c - tol THEN 'SHORT' END AS want,
    CASE WHEN close > top + tol THEN 'ABOVE' WHEN close < bottom - tol THEN 'BELOW' ELSE 'INSIDE' END AS pos, abs(close - a) <= 0.6 * atr AS near FROM rb1),
rb3 AS (
  SELECT *, pos = CASE want WHEN 'LONG' THEN 'BELOW' ELSE 'ABOVE' END AS broke, pos = CASE want WHEN 'LONG' THEN 'ABOVE' ELSE 'BELOW' END AS beyond,
    high <= low OR CASE want WHEN 'LONG' THEN close >= low + 0.66 * (high - low) ELSE close <= high - 0.66 * (high - low) END AS rejects FROM rb2),
fsm AS (
  SELECT symbol, -1::BIGINT AS i, NULL::VARCHAR AS side, 0 AS extended, NULL::BIGINT AS pull, NULL::DOUBLE AS ext, NULL::BIGINT AS fired, NULL::DOUBLE AS fired_ext FROM (SELECT DISTINCT symbol FROM ba)
  UNION ALL
  SELECT symbol, i, CASE WHEN ready THEN want ELSE side END,
    CASE WHEN want IS NULL OR broke THEN 0 WHEN pull0 IS NULL THEN ex0 + beyond::INT WHEN done THEN 0 ELSE ex0 END,
    CASE WHEN want IS NULL OR broke THEN NULL WHEN pull0 IS NULL THEN CASE WHEN starts THEN i END WHEN done THEN NULL ELSE pull0 END,
    CASE WHEN pull0 IS NULL THEN CASE want WHEN 'LONG' THEN low ELSE high END ELSE ext1 END,
    CASE WHEN want IS NOT NULL AND NOT broke AND pull0 IS NOT NULL AND done AND NOT late THEN pull0 END, ext1
  FROM (
    SELECT *, CASE WHEN beyond THEN ex0 + 1 >= 3 AND near ELSE ex0 >= 3 END AS starts, i - pull0 > 16 AS late, i - pull0 > 16 OR (beyond AND rejects) AS done,
      CASE want WHEN 'LONG' THEN least(ext, low) ELSE greatest(ext, high) END AS ext1
    FROM (
      SELECT x.*, f.side, f.ext, CASE WHEN f.side IS DISTINCT FROM x.want THEN 0 ELSE f.extended END AS ex0, CASE WHEN f.side IS DISTINCT FROM x.want THEN NULL ELSE f.pull END AS pull0
      FROM fsm f JOIN rb3 x ON x.symbol = f.symbol AND x.i = f.i + 1))),
sg AS (
  SELECT x.symbol, want = 'LONG' AS long, x.i, x.open_ts, x.high - x.low AS span, x.atr, x.i - fired AS pullback_bars, next_open AS entry,
    CASE want WHEN 'LONG' THEN fired_ext - 0.15 * x.atr ELSE fired_ext + 0.15 * x.atr END AS sl
  FROM fsm f JOIN rb3 x ON x.symbol = f.symbol AND x.i = f.i WHERE fired IS NOT NULL AND next_open IS NOT NULL),
sg2 AS (
  SELECT *, CASE WHEN long THEN entry - sl ELSE sl - entry END AS risk,
    CASE WHEN long THEN (SELECT min(q.price) FROM sco q WHERE q.symbol = s.symbol AND q.kind = 'HIGH' AND q.confirmed_at <= s.open_ts + 3600 AND q.price > s.entry)
      ELSE (SELECT max(q.price) FROM sco q WHERE q.symbol = s.symbol AND q.kind = 'LOW' AND q.confirmed_at <= s.open_ts + 3600 AND q.price < s.entry) END AS far FROM sg s),
sg3 AS (SELECT *, CASE WHEN far IS NOT NULL THEN CASE WHEN long THEN least(far, entry + 3 * risk) ELSE greatest(far, entry - 3 * risk) END END AS tp FROM sg2),
sg4 AS (SELECT *, round_even(CASE WHEN long THEN tp - entry ELSE entry - tp END / risk, 2) AS rr FROM sg3)
SELECT n.symbol, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction, open_ts AS market_time, open_ts + 3600 AS confirmed_at, round(entry, 6) AS entry, round(sl, 6) AS sl, round(tp, 6) AS tp, rr,
  round(CASE WHEN long THEN entry - 0.1 * risk ELSE entry + 0.1 * risk END, 6) AS maker_limit, pullback_bars,
  CASE WHEN risk <= 0 THEN 'INVALID_BRACKET' WHEN span < 0.15 * atr OR risk < 0.02 THEN 'VETOED' WHEN far IS NULL THEN 'NO_CAUSAL_TARGET' WHEN rr < 1.5 THEN 'RR_BELOW_MINIMUM'
    WHEN risk < 2 * ((maker + taker) * entry + 0.05 * atr + 1e-4 * 10 * settlements / 24 * entry) THEN 'UNECONOMIC_AFTER_COSTS' END AS reason, i + 1 AS fill_i
FROM sg4 JOIN nm n ON n.base = sg4.symbol"""


@query("trend_continuations", with_tables(_NAMES + _TREND, "sco"))
def trend_continuations(spark, d):
    """Pullbacks to the ribbon that resume, at three venues, with the gate that refuses the others."""
    facts = structure_facts(spark, d)
    told = G.continuations(written(_named(facts.bars), "named-bars"), _named(facts.swings))
    rounded = [F.round(c, 6).alias(c) for c in ("entry", "sl", "tp", "maker_limit")]
    return told.select("symbol", "direction", "market_time", "confirmed_at", *rounded, "rr", "pullback_bars", "reason", "fill_i")
