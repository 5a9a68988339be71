"""Universe, profile, place-in-range and validation queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import execution as E
from ..operators import joins as J
from ..operators import profile as P
from ..operators import series as S
from ..operators import swings as W
from ..operators import universe as U
from ..sources import candles as C
from .catalog import query
from .decisions import _bars, _on_book, book, plans, settled
from .market import TF, _arms, _schmitt_sql, _shared, _sql_arms, _tiered
from .sql import with_tables

# These tables hold five symbols over a month, so the ranks, the floor and the warm-up are theirs.
SEEDS, RANKS, FLOOR, WARM_UP = ("view",), 3, 300.0, 7
# Fixed value: swings of either side that make the range.
RANGE_SWINGS = 6


_UNIVERSE = f"""
WITH t AS (SELECT event_type AS symbol, floor(epoch(ts) / 86400)::BIGINT * 86400 AS day, round(value, 2) AS price FROM events WHERE value IS NOT NULL),
d AS (SELECT symbol, day, round(sum(price), 2) AS volume FROM t GROUP BY ALL),
g AS (SELECT symbol, unnest(range(a, b + 1, 86400)) AS day FROM (SELECT DISTINCT symbol FROM d), (SELECT min(day) AS a, max(day) AS b FROM d)),
k AS (SELECT g.symbol, g.day, coalesce(volume, 0) AS volume, count(volume) OVER (PARTITION BY g.symbol ORDER BY g.day) AS n_daily FROM g LEFT JOIN d USING (symbol, day)),
p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY volume DESC, symbol) AS place, symbol = 'view' AS seed FROM k),
u AS (
  SELECT symbol, day, day + 86400 AS confirmed_at, CASE WHEN place <= {RANKS} THEN place END AS rank, volume, n_daily,
    CASE WHEN place > {RANKS} AND NOT seed THEN 'OUTSIDE' WHEN volume < {FLOOR} AND NOT seed THEN 'REJECTED' WHEN n_daily < {WARM_UP} THEN 'WARMING' ELSE 'ADMITTED' END AS state,
    CASE WHEN place > {RANKS} AND NOT seed THEN 'beyond_ranks' WHEN place > {RANKS} THEN 'seed_anchor' WHEN volume < {FLOOR} AND NOT seed THEN 'below_liquidity_floor'
      WHEN n_daily < {WARM_UP} THEN 'insufficient_history' ELSE 'liquid_and_warm' END AS reason
  FROM p)"""


def _members(spark, d) -> DataFrame:
    ticks = C.event_ticks(spark, d).where("price is not null").withColumn("day", C.bucket_start(F.unix_timestamp("ts"), "1D"))
    days = ticks.groupBy("symbol", "day").agg(F.round(F.sum("price"), 2).alias("volume"))
    return U.snapshots(days, SEEDS, RANKS, FLOOR, WARM_UP)


@query("universe_members", _UNIVERSE + " SELECT * FROM u")
def universe_members(spark, d):
    return _members(spark, d)


@query("universe_asof", _UNIVERSE + """,
h AS (SELECT DISTINCT event_type AS symbol, floor(epoch(ts) / 3600)::BIGINT * 3600 AS at FROM events WHERE value IS NOT NULL)
SELECT h.symbol, h.at, coalesce(u.state = 'ADMITTED', h.symbol = 'view') AS admitted FROM h ASOF LEFT JOIN u ON h.symbol = u.symbol AND h.at >= u.confirmed_at""")
def universe_asof(spark, d):
    """Whether each hour's symbol belonged to the universe that was known then."""
    hours = C.event_ticks(spark, d).where("price is not null").select("symbol", C.bucket_start(F.unix_timestamp("ts"), TF).alias("at")).distinct()
    return U.admitted_at(hours, _members(spark, d), "at", SEEDS)


@query("universe_current", _UNIVERSE + " SELECT symbol, state, state = 'ADMITTED' AS traded FROM u WHERE day = (SELECT max(day) FROM u)")
def universe_current(spark, d):
    """The last snapshot: what is tracked and what of it is traded."""
    last = J.latest(_members(spark, d), ["symbol"], ["confirmed_at"])
    return last.select("symbol", "state", (F.col("state") == "ADMITTED").alias("traded"))


_SPREAD = f"""
, s0 AS (SELECT *, round({P.BIN_SHARE} * first_value(close) OVER (PARTITION BY symbol ORDER BY i), 8) AS step FROM b),
sp AS (SELECT symbol, i, floor(low / step) AS b0, floor(high / step) AS b1, floor(close / step) AS cb, volume / (floor(high / step) - floor(low / step) + 1) AS share FROM s0),
rn AS (SELECT symbol, i, cb, i - (i - {P.WINDOW}) % {P.STRIDE} AS r FROM sp WHERE i >= {P.WINDOW}),
ow AS (
  SELECT rn.symbol, rn.i, rn.r, coalesce(sum(y.share) FILTER (rn.cb BETWEEN y.b0 AND y.b1), 0) AS own
  FROM rn JOIN sp y ON y.symbol = rn.symbol AND y.i BETWEEN rn.i - {P.WINDOW - 1} AND rn.i GROUP BY ALL),
yy AS (SELECT g.symbol, g.r, sp.b0, sp.b1, sp.share FROM (SELECT DISTINCT symbol, r FROM rn) g JOIN sp ON sp.symbol = g.symbol AND sp.i BETWEEN g.r - {P.WINDOW - 1} AND g.r),
ed AS (SELECT symbol, r, edge, lead(edge) OVER (PARTITION BY symbol, r ORDER BY edge) - edge AS width FROM (SELECT DISTINCT symbol, r, unnest([b0, b1 + 1]) AS edge FROM yy)),
lv AS (SELECT ed.symbol, ed.r, ed.edge, ed.width, sum(yy.share) AS level FROM ed JOIN yy ON yy.symbol = ed.symbol AND yy.r = ed.r AND ed.edge BETWEEN yy.b0 AND yy.b1 GROUP BY ALL),
cu AS (SELECT *, sum(width) OVER (PARTITION BY symbol, r ORDER BY level, edge) AS upto, sum(width) OVER (PARTITION BY symbol, r) AS bins FROM lv),
md AS (SELECT symbol, r, min(level) AS median FROM cu WHERE upto > floor(bins / 2) GROUP BY symbol, r),
rt AS (SELECT ow.symbol, ow.i, round(own / median, 9) AS ratio FROM ow JOIN md USING (symbol, r))"""


@query("spread_ratio", with_tables(_SPREAD + " SELECT symbol, i, round(ratio, 6) AS ratio FROM rt", "b"))
def spread_ratio(spark, d):
    return P.spread_ratio(S.indexed(C.candles(spark, d, TF))).select("symbol", "i", F.round("ratio", 6).alias("ratio"))


@query("vp_states", with_tables(_SPREAD + _schmitt_sql("rt", "ratio", _sql_arms(P.NODE_BANDS), "MID") + " SELECT * FROM ch", "b"))
def vp_states(spark, d):
    """Closes that enter or leave nodes of high or low volume."""
    told = P.spread_ratio(S.indexed(C.candles(spark, d, TF)))
    told = told.withColumn("state", S.schmitt(F.col("ratio"), _arms("ratio", P.NODE_BANDS), "MID"))
    return S.changes(told, "state").select("symbol", "i", "state", "from", "bars_in_prev")


def _ranges(frame: pd.DataFrame) -> pd.DataFrame:
    """The extremes of either side's last swings, anew at every confirmation."""
    last, out = {"HIGH": [], "LOW": []}, []
    frame = frame.sort_values(["confirmed_at", "market_time", "kind"])
    for known, at, kind, price in zip(frame["confirmed_at"], frame["market_time"], frame["kind"], frame["price"], strict=True):
        last[kind] = sorted([*last[kind], (at, price)])[-RANGE_SWINGS:]
        if last["HIGH"] and last["LOW"]:
            out.append((known, at, max(p for _, p in last["HIGH"]), min(p for _, p in last["LOW"])))
    told = pd.DataFrame(out, columns=["known", "at", "hi", "lo"]).drop_duplicates("known", keep="last").drop(columns="at")
    return told.assign(symbol=frame["symbol"].iloc[0], tf=frame["tf"].iloc[0])[["symbol", "tf", "known", "hi", "lo"]]


@query("premium_discount")
def premium_discount(spark, d):
    """Each close's place between the extremes of the last six swings a side, 0 to 100."""
    bars = _shared(spark, d)
    swings = _tiered(bars, *W.POOL_TIERS).select("symbol", "tf", "confirmed_at", "market_time", "kind", "price")
    bounds = J.fold_series(swings, _ranges, "symbol string, tf string, known long, hi double, lo double")
    closes = bars.select("symbol", "tf", "i", "close", (F.col("open_ts") + W.seconds()).alias("closed"))
    told = J.asof(closes, bounds, ["symbol", "tf"], "closed", "known", ["hi", "lo"]).where("hi > lo")
    place = 100 * (F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return told.select("symbol", "i", F.least(F.greatest(place, F.lit(0.0)), F.lit(100.0)).cast("long").alias("pct"))


_STATS = """count(*) AS n, round(100 * count(*) FILTER (r > 0) / count(*), 6) AS win_pct, round(sum(r), 6) AS sum_r, round(avg(r), 6) AS avg_r,
  round(sum(r) FILTER (r > 0) / -(sum(r) FILTER (r < 0)), 6) AS profit_factor"""


def _stats(r: Column) -> list[Column]:
    won, lost = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    return [
        F.count("*").alias("n"), F.round(100 * F.count_if(r > 0) / F.count("*"), 6).alias("win_pct"), F.round(F.sum(r), 6).alias("sum_r"),
        F.round(F.avg(r), 6).alias("avg_r"), F.round(won / lost, 6).alias("profit_factor"),
    ]


@query("validation_cohorts", _on_book(f"""
, pl AS (SELECT *, row_number() OVER (ORDER BY r_multiple DESC, setup_id) AS place FROM book),
co AS (
  SELECT 'ALL' AS cohort, r_multiple AS r FROM pl UNION ALL SELECT 'GROSS', r_gross FROM pl UNION ALL SELECT symbol, r_multiple FROM pl
  UNION ALL SELECT direction, r_multiple FROM pl UNION ALL SELECT strftime(to_timestamp(market_time)::TIMESTAMP, '%Y'), r_multiple FROM pl
  UNION ALL SELECT 'MINUS_TOP_' || k, r_multiple FROM pl, (VALUES (1), (3), (5)) x(k) WHERE place > k)
SELECT cohort, {_STATS} FROM co GROUP BY cohort"""))
def validation_cohorts(spark, d):
    """The book's figures over all trades, before costs, by symbol, side and year, and without its best trades."""
    trades = book(spark, d).select("setup_id", "symbol", "direction", "market_time", "r_multiple", "r_gross")
    # The five best are a top-k, not a sort of the book.
    best = trades.orderBy(F.desc("r_multiple"), "setup_id").limit(5).select("setup_id", "r_multiple")
    place = F.row_number().over(Window.orderBy(F.desc("r_multiple"), "setup_id"))
    told = trades.join(best.select("setup_id", place.alias("place")), "setup_id", "left")
    one = lambda name, r="r_multiple": F.struct(name.alias("cohort"), F.col(r).alias("r"))
    cut = lambda k: F.when(F.coalesce("place", F.lit(9)) > k, one(F.lit(f"MINUS_TOP_{k}")))
    year = F.date_format(F.timestamp_seconds("market_time"), "yyyy")
    parts = [one(F.lit("ALL")), one(F.lit("GROSS"), "r_gross"), one(F.col("symbol")), one(F.col("direction")), one(year), cut(1), cut(3), cut(5)]
    long = told.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*")
    return long.groupBy("cohort").agg(*_stats(F.col("r")))


@query("excursion_summary", _on_book("""
 SELECT outcome, count(*) AS n, round(avg(mfe / risk), 6) AS mean, round(quantile_cont(mfe / risk, 0.5), 6) AS median, round(min(mfe / risk), 6) AS least, round(max(mfe / risk), 6) AS most
 FROM book GROUP BY outcome"""))
def excursion_summary(spark, d):
    x = F.col("mfe") / F.abs(F.col("entry") - F.col("sl"))
    six = {"mean": F.avg(x), "median": F.percentile(x, 0.5), "least": F.min(x), "most": F.max(x)}
    return book(spark, d).groupBy("outcome").agg(F.count("*").alias("n"), *[F.round(c, 6).alias(n) for n, c in six.items()])


@query("blocked_share", _on_book("""
, cd AS (SELECT symbol, direction, exit_ts AS starts_at, exit_ts + CASE WHEN outcome = 'SL' THEN 43200 ELSE 1800 END AS expires_at, outcome FROM book),
bl AS (
  SELECT p.setup_id, any_value(p.symbol) AS symbol, arg_max(cd.outcome, expires_at) AS cause
  FROM p JOIN cd ON cd.symbol = p.symbol AND cd.direction = p.direction AND starts_at <= p.market_time + 3600 AND p.market_time + 3600 < expires_at GROUP BY p.setup_id),
al AS (SELECT p.symbol, coalesce(cause, 'NONE') AS cause FROM p LEFT JOIN bl USING (setup_id))
SELECT symbol, cause, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 1) AS pct FROM al GROUP BY symbol, cause"""))
def blocked_share(spark, d):
    """What share of each symbol's plans a cooldown holds back, by its cause."""
    bars = _bars(spark, d)
    made = plans(bars)
    told = made.select("setup_id", "symbol").join(E.blocked(made, E.cooldowns(settled(bars))).select("setup_id", "cause"), "setup_id", "left")
    counted = told.groupBy("symbol", F.coalesce("cause", F.lit("NONE")).alias("cause")).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("symbol")), 1))
