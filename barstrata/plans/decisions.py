"""Decision and evidence queries: a gap-retest book, its settlement, risk and statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import trading as T
from ..operators import execution as E
from ..operators import joins as J
from ..operators import series as S
from ..operators import structure as X
from ..sources import candles as C
from ..streaming.bars import written
from .catalog import query
from .sql import with_tables

TF = "1H"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """The analysed bars, computed once for the joins of a query that read them."""
    return written(S.analysed(C.candles(spark, d, TF)).withColumn("symbol", F.concat("symbol", F.lit("USDT"))), "analysed-bars")


def plans(bars: DataFrame) -> DataFrame:
    """A trade in each value gap's direction at the next open: the stop 0.15 ATR
    beyond the gap, the target at 2 R. A stop on the wrong side makes no plan."""
    nxt = bars.select("symbol", "tf", (F.col("i") - 1).alias("i"), F.col("open").alias("entry"), F.col("open_ts").alias("fill_ts"))
    atr = bars.select("symbol", "tf", "i", "atr")
    long = F.col("direction") == "BULL"
    base = X.gap_bands(bars).join(nxt, ["symbol", "tf", "i"]).join(atr, ["symbol", "tf", "i"])
    sl = F.when(long, F.col("bottom") - 0.15 * F.col("atr")).otherwise(F.col("top") + 0.15 * F.col("atr"))
    return (
        base.withColumn("sl", sl)
        .withColumn("risk", F.when(long, F.col("entry") - F.col("sl")).otherwise(F.col("sl") - F.col("entry")))
        .where("risk > 0")
        .select(
            "symbol",
            "tf",
            F.concat_ws("|", "symbol", F.col("market_time").cast("string")).alias("setup_id"),
            F.when(long, "LONG").otherwise("SHORT").alias("direction"),
            "market_time",
            (F.col("market_time") + 3600).alias("confirmed_at"),
            "entry",
            "sl",
            F.when(long, F.col("entry") + 2 * F.col("risk")).otherwise(F.col("entry") - 2 * F.col("risk")).alias("tp"),
            (F.col("i") + 1).alias("fill_i"),
        )
    )


def book(spark: SparkSession, d: str) -> DataFrame:
    """The settled trades."""
    return settled(_bars(spark, d))


def settled(bars: DataFrame) -> DataFrame:
    done = E.settle(E.walk_exits(plans(bars), bars), 3600)
    times = bars.select("symbol", "tf", F.col("i").alias("exit_i"), (F.col("open_ts") + 3600).alias("exit_ts"))
    return done.join(times, ["symbol", "tf", "exit_i"])


_BOOK = """
, n AS (SELECT symbol, i - 1 AS i, open AS entry FROM ba),
p0 AS (
  SELECT g.symbol || 'USDT' AS symbol, g.symbol AS s, g.open_ts AS market_time, CASE g.direction WHEN 'BULL' THEN 'LONG' ELSE 'SHORT' END AS direction, n.entry,
    CASE g.direction WHEN 'BULL' THEN g.bottom - 0.15 * g.atr ELSE g.top + 0.15 * g.atr END AS sl, g.i + 1 AS fill_i
  FROM gap g JOIN n USING (symbol, i) WHERE g.top - g.bottom >= 0.25 * g.atr),
p AS (
  SELECT *, symbol || '|' || market_time AS setup_id, abs(entry - sl) AS risk,
    CASE direction WHEN 'LONG' THEN entry + 2 * (entry - sl) ELSE entry - 2 * (sl - entry) END AS tp
  FROM p0 WHERE CASE direction WHEN 'LONG' THEN entry - sl ELSE sl - entry END > 0),
h AS (
  SELECT p.*, x.i, x.high, x.low, x.close, x.atr,
    CASE direction WHEN 'LONG' THEN x.low <= sl ELSE x.high >= sl END AS hs, CASE direction WHEN 'LONG' THEN x.high >= tp ELSE x.low <= tp END AS ht
  FROM p JOIN ba x ON x.symbol = p.s AND x.i >= p.fill_i AND x.i < p.fill_i + 100),
e AS (SELECT setup_id, coalesce(min(i) FILTER (hs OR ht), CASE WHEN max(i) = any_value(fill_i) + 99 THEN max(i) END) AS exit_i FROM h GROUP BY setup_id),
x AS (
  SELECT h.*, exit_i, CASE WHEN hs THEN 'SL' WHEN ht THEN 'TP' ELSE 'TIMEOUT' END AS outcome, hs AND ht AS ambiguous,
    CASE WHEN hs THEN sl WHEN ht THEN tp ELSE close END AS exit_price
  FROM h JOIN e ON h.setup_id = e.setup_id AND h.i = e.exit_i),
m AS (
  SELECT h.setup_id, max(CASE direction WHEN 'LONG' THEN high - entry ELSE entry - low END) AS mfe,
    max(CASE direction WHEN 'LONG' THEN entry - low ELSE high - entry END) AS mae
  FROM h JOIN e ON h.setup_id = e.setup_id AND h.i <= e.exit_i GROUP BY h.setup_id),
s AS (
  SELECT x.*, mfe, mae, i - fill_i AS bars_held, CASE WHEN outcome = 'TP' THEN 0 ELSE 0.05 * atr END AS slip
  FROM x JOIN m USING (setup_id)),
s2 AS (SELECT *, CASE direction WHEN 'LONG' THEN exit_price - slip ELSE exit_price + slip END AS eff_exit FROM s),
bk AS (
  SELECT s2.*, 6e-4 * entry + CASE WHEN outcome = 'TP' THEN 1e-4 ELSE 6e-4 END * eff_exit AS fees, 1e-4 * bars_held / 8 * entry AS funding,
    CASE direction WHEN 'LONG' THEN exit_price - entry ELSE entry - exit_price END / risk AS gross, b.open_ts + 3600 AS exit_ts
  FROM s2 JOIN ba b ON b.symbol = s2.s AND b.i = s2.exit_i),
book AS (
  SELECT *, round_even(gross, 2) AS r_gross,
    round_even((CASE direction WHEN 'LONG' THEN eff_exit - entry ELSE entry - eff_exit END - fees - funding) / risk, 2) AS r_multiple
  FROM bk)"""


def _on_book(final: str) -> str:
    return with_tables(_BOOK + final, "gap")


@query("exec_exits", _on_book(" SELECT setup_id, direction, outcome, ambiguous, bars_held, round(exit_price, 6) AS exit_price FROM book"))
def exec_exits(spark, d):
    return book(spark, d).select("setup_id", "direction", "outcome", "ambiguous", "bars_held", F.round("exit_price", 6).alias("exit_price"))


@query("settlement", _on_book(" SELECT setup_id, round(slip, 6) AS slip, round(fees, 6) AS fees, round(funding, 6) AS funding, round(r_gross, 2) AS r_gross, round(r_multiple, 2) AS r_multiple FROM book"))
def settlement(spark, d):
    return book(spark, d).select("setup_id", *[F.round(c, 6).alias(c) for c in ("slip", "fees", "funding")], "r_gross", "r_multiple")


@query("mfe_mae", _on_book(" SELECT setup_id, round(mfe / risk, 6) AS mfe_r, round(mae / risk, 6) AS mae_r FROM book"))
def mfe_mae(spark, d):
    risk = F.abs(F.col("entry") - F.col("sl"))
    return book(spark, d).select("setup_id", F.round(F.col("mfe") / risk, 6).alias("mfe_r"), F.round(F.col("mae") / risk, 6).alias("mae_r"))


@query("entry_fill_rate", with_tables("""
, pl AS (SELECT symbol, i, i + 1 AS order_i, close AS limit_price FROM ba WHERE atr IS NOT NULL),
f AS (
  SELECT pl.symbol, pl.i, min(x.i) FILTER (pl.limit_price BETWEEN x.low AND x.high) AS fill_i, any_value(order_i) AS order_i,
    (SELECT max(i) FROM ba z WHERE z.symbol = pl.symbol) AS last_i
  FROM pl LEFT JOIN ba x ON x.symbol = pl.symbol AND x.i >= order_i AND x.i < order_i + 4 GROUP BY pl.symbol, pl.i)
SELECT symbol || 'USDT' AS symbol, CASE WHEN fill_i IS NOT NULL THEN 'FILLED' WHEN order_i + 4 > last_i + 1 THEN 'PENDING' ELSE 'MISSED' END AS status, count(*) AS n
FROM f GROUP BY ALL""", "ba"))
def entry_fill_rate(spark, d):
    bars = _bars(spark, d)
    orders = bars.where("atr is not null").select(
        "symbol", "tf", F.concat_ws("|", "symbol", F.col("i").cast("string")).alias("setup_id"), (F.col("i") + 1).alias("order_i"), F.col("close").alias("limit_price")
    )
    return E.limit_fills(orders, bars).groupBy("symbol", "status").agg(F.count("*").alias("n"))


@query("edge_core", _on_book("""
 SELECT symbol, count(*) AS n, round(sum(r_multiple), 6) AS sum_r,
  CASE WHEN count(*) >= 10 THEN round(avg(r_multiple), 6) END AS mean_r,
  CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN r_multiple > 0 THEN 1.0 ELSE 0 END), 6) END AS win_rate,
  CASE WHEN count(*) >= 10 AND sum(r_multiple) FILTER (r_multiple < 0) < 0 THEN round(sum(r_multiple) FILTER (r_multiple > 0) / -sum(r_multiple) FILTER (r_multiple < 0), 6) END AS profit_factor
 FROM book GROUP BY symbol"""))
def edge_core(spark, d):
    r = F.col("r_multiple")
    enough = F.count("*") >= 10
    won, lost = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    return book(spark, d).groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.round(F.sum(r), 6).alias("sum_r"),
        F.when(enough, F.round(F.avg(r), 6)).alias("mean_r"),
        F.when(enough, F.round(F.avg((r > 0).cast("double")), 6)).alias("win_rate"),
        F.when(enough & (lost > 0), F.round(won / lost, 6)).alias("profit_factor"),
    )


@query("fee_scenarios", _on_book("""
 SELECT symbol, scenario, round(avg(r), 6) AS mean_r FROM (
  SELECT symbol, 'AS_RECORDED' AS scenario, r_multiple AS r FROM book
  UNION ALL SELECT symbol, 'FEE_FREE', r_multiple + fees / risk FROM book
  UNION ALL SELECT symbol, 'GROSS', r_gross FROM book) GROUP BY ALL"""))
def fee_scenarios(spark, d):
    risk = F.abs(F.col("entry") - F.col("sl"))
    wide = book(spark, d).select("symbol", F.col("r_multiple").alias("AS_RECORDED"), (F.col("r_multiple") + F.col("fees") / risk).alias("FEE_FREE"), F.col("r_gross").alias("GROSS"))
    return wide.unpivot(["symbol"], ["AS_RECORDED", "FEE_FREE", "GROSS"], "scenario", "r").groupBy("symbol", "scenario").agg(F.round(F.avg("r"), 6).alias("mean_r"))


@query("performance_cuts", _on_book("""
 SELECT symbol, direction, outcome, count(*) AS n, round(sum(r_multiple), 6) AS sum_r
 FROM book GROUP BY GROUPING SETS ((symbol), (direction), (outcome), ())"""))
def performance_cuts(spark, d):
    """Trades by symbol, by direction, by outcome and in total; the total is told without trades, too."""
    sets = [[F.col("symbol")], [F.col("direction")], [F.col("outcome")], []]
    cuts = book(spark, d).groupingSets(sets, "symbol", "direction", "outcome").agg(
        F.grouping_id().alias("cut"), F.count("*").alias("n"), F.round(F.sum("r_multiple"), 6).alias("sum_r")
    )
    # Spark's grouping sets of no rows have no total; 7 is the cut by none of the three.
    total = spark.range(1).select(F.lit(7).cast("long").alias("cut"))
    return cuts.join(total, "cut", "full").na.fill(0, ["n"]).select("symbol", "direction", "outcome", "n", "sum_r")


@query("drawdown_streak", _on_book("""
, o AS (SELECT *, sum(r_multiple) OVER w AS eq, sum(CASE WHEN r_multiple >= 0 THEN 1 ELSE 0 END) OVER w AS st FROM book
  WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, setup_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY exit_ts, setup_id ROWS UNBOUNDED PRECEDING), 0) - eq AS fall FROM o),
g AS (SELECT symbol, st, count(*) FILTER (r_multiple < 0) AS losses, max(fall) AS fall FROM f GROUP BY symbol, st)
SELECT symbol, round(max(fall), 6) AS max_drawdown, max(losses) AS loss_streak FROM g GROUP BY symbol"""))
def drawdown_streak(spark, d):
    return E.drawdown(book(spark, d), ["symbol"], ["exit_ts", "setup_id"]).withColumn("max_drawdown", F.round("max_drawdown", 6))


@query("cooldown_active", _on_book("""
, cd AS (SELECT symbol, direction, exit_ts AS starts_at, exit_ts + CASE WHEN outcome = 'SL' THEN 43200 ELSE 1800 END AS expires_at, outcome FROM book)
SELECT p.setup_id, max(expires_at) AS expires_at, arg_max(cd.outcome, expires_at) AS cause
FROM p JOIN cd ON cd.symbol = p.symbol AND cd.direction = p.direction AND starts_at <= p.market_time + 3600 AND p.market_time + 3600 < expires_at GROUP BY p.setup_id"""))
def cooldown_active(spark, d):
    bars = _bars(spark, d)
    return E.blocked(plans(bars), E.cooldowns(settled(bars)))


@query("risk_replay")
def risk_replay(spark, d):
    # One account decides over all symbols, so this replay is one fold; its input is
    # the book, which is small beside the bars.
    trades = written(book(spark, d), "book")
    stops = E.blocked(trades.select("setup_id", "symbol", "direction", "confirmed_at"), E.cooldowns(trades)).select("setup_id", F.lit(True).alias("cooling"))
    intents = trades.join(stops, "setup_id", "left").select(
        F.lit("PAPER").alias("account"), "setup_id", "market_time", "confirmed_at", "entry", "sl", "exit_ts", "r_multiple", F.coalesce("cooling", F.lit(False)).alias("cooling")
    )
    return E.replay(intents)


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(["exit_ts", "setup_id"])["r_multiple"].to_numpy(float)
        lo, hi, p = T.bootstrap_mean(values, 2000) if len(values) >= 10 else (math.nan,) * 3
        return pd.DataFrame({"symbol": [frame["symbol"].iloc[0]], "n": [len(values)], "ci_lo": [lo], "ci_hi": [hi], "p_gt_zero": [p]})

    return book(spark, d).select("symbol", "exit_ts", "setup_id", "r_multiple").groupBy("symbol").applyInPandas(
        run, "symbol string, n long, ci_lo double, ci_hi double, p_gt_zero double"
    )


def _factors(trades: DataFrame) -> DataFrame:
    """Long table (setup_id, exit_ts, factor, x, r) of a few numeric factors."""
    risk = F.abs(F.col("entry") - F.col("sl"))
    wide = trades.select(
        "setup_id", "exit_ts", F.col("r_multiple").alias("r"),
        (risk / F.col("entry")).alias("risk_pct"), F.col("bars_held").cast("double").alias("bars_held"), (F.col("atr_exit") / F.col("entry")).alias("atr_pct"),
    )
    return wide.unpivot(["setup_id", "exit_ts", "r"], ["risk_pct", "bars_held", "atr_pct"], "factor", "x")


_FACT = """
, fx AS (
  SELECT setup_id, exit_ts, r_multiple AS r, 'risk_pct' AS factor, risk / entry AS x FROM book
  UNION ALL SELECT setup_id, exit_ts, r_multiple, 'bars_held', bars_held::DOUBLE FROM book
  UNION ALL SELECT setup_id, exit_ts, r_multiple, 'atr_pct', atr / entry FROM book)"""


@query("factor_stats", _on_book(_FACT + """
 SELECT factor, count(x) AS n, round(corr(x, r), 6) AS r_corr, round(stddev_pop(x), 6) AS sd, round(1.96 / sqrt(count(x)), 6) AS noise FROM fx GROUP BY factor"""))
def factor_stats(spark, d):
    return _factors(book(spark, d)).groupBy("factor").agg(
        F.count("x").alias("n"), F.round(F.corr("x", "r"), 6).alias("r_corr"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.round(1.96 / F.sqrt(F.count("x")), 6).alias("noise")
    )


@query("factor_redundancy", _on_book(_FACT + """
 SELECT a.factor AS a, b.factor AS b, round(corr(a.x, b.x), 6) AS r_corr FROM fx a JOIN fx b USING (setup_id) WHERE a.factor < b.factor GROUP BY ALL"""))
def factor_redundancy(spark, d):
    long = _factors(book(spark, d)).select("setup_id", "factor", "x")
    a = long.select("setup_id", F.col("factor").alias("a"), F.col("x").alias("xa"))
    b = long.select("setup_id", F.col("factor").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "setup_id").where("a < b").groupBy("a", "b").agg(F.round(F.corr("xa", "xb"), 6).alias("r_corr"))


def erfc(z):
    """Complementary error function of a double column, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(v) if v == v else np.nan)

    return run(z)


@query("evidence_bh")
def evidence_bh(spark, d):
    """Chronological train, validation and forward splits of each factor: the training
    median as threshold, uplift, p by normal tail, Benjamini-Hochberg q."""
    place = Window.partitionBy("factor").orderBy("exit_ts", "setup_id")
    whole = Window.partitionBy("factor")
    told = _factors(book(spark, d)).where("x is not null").withColumn("k", F.row_number().over(place) - 1).withColumn("n", F.count("*").over(whole))
    split = F.when(F.col("k") < F.floor(F.col("n") * 0.6), "TRAIN").when(F.col("k") < F.floor(F.col("n") * 0.8), "VALIDATE").otherwise("FORWARD")
    parts = told.withColumn("part", split)
    order = Window.partitionBy("factor").orderBy("x", "setup_id")
    train = parts.where("part = 'TRAIN'").withColumn("j", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(whole))
    cut = train.where("j = floor(m / 2)").select("factor", F.col("x").alias("threshold"))
    sides = parts.join(cut, "factor").withColumn("high", F.col("x") >= F.col("threshold"))
    arm = lambda side: [F.avg(F.when(side, F.col("r"))), F.var_samp(F.when(side, F.col("r"))), F.count(F.when(side, 1))]
    hi, lo = arm(F.col("high")), arm(~F.col("high"))
    stats = sides.groupBy("factor", "part").agg((hi[0] - lo[0]).alias("uplift"), F.sqrt(hi[1] / hi[2] + lo[1] / lo[2]).alias("se"), F.count("*").alias("n"))
    tested = stats.withColumn("p", erfc(F.abs(F.col("uplift")) / F.col("se") / F.sqrt(F.lit(2.0)))).withColumn("shrunk", F.col("uplift") * F.col("n") / (F.col("n") + 30))
    ranked = Window.partitionBy("part").orderBy("p", "factor")
    back = Window.partitionBy("part").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count("*").over(Window.partitionBy("part"))
    return tested.withColumn("rank", F.row_number().over(ranked)).withColumn("raw", F.col("p") * m / F.col("rank")).withColumn("q", F.least(F.min("raw").over(back), F.lit(1.0))).drop("raw")


_TOP = """
, hi AS (SELECT symbol, open_ts AS known, CASE WHEN close > open THEN 'UP' ELSE 'DOWN' END AS side FROM c WHERE volume >= 5)"""


@query("asof_side", with_tables(_TOP + """
 SELECT c.symbol, c.open_ts, hi.side, CASE WHEN c.open_ts - hi.known <= 7200 THEN hi.side END AS fresh_side
 FROM c ASOF LEFT JOIN hi ON c.symbol = hi.symbol AND c.open_ts >= hi.known""", "c"))
def asof_side(spark, d):
    bars = C.candles(spark, d, TF)
    facts = bars.where("volume >= 5").select("symbol", F.col("open_ts").alias("known"), F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN").alias("side"))
    base = J.asof(bars.select("symbol", "open_ts"), facts, ["symbol"], "open_ts", "known", ["side"])
    return J.asof(base, facts.withColumnRenamed("side", "fresh_side"), ["symbol"], "open_ts", "known", ["fresh_side"], max_age=7200)


@query("latest_state", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(event_id) FILTER (true) AS last_id FROM events GROUP BY user_id""")
def latest_state(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("event_id").alias("last_id"))


@query("overview_change", """
WITH d1 AS (SELECT event_type AS symbol, floor(epoch(ts) / 86400)::BIGINT * 86400 AS day, ts, round(value, 2) AS price FROM events WHERE value IS NOT NULL),
d2 AS (SELECT symbol, day, arg_max(price, ts) AS close, min(price) AS low FROM d1 GROUP BY symbol, day),
d3 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM d2 WHERE low > 0)
SELECT symbol, close, round(100 * (close - prev) / prev, 6) AS change_pct FROM d3 WHERE k = 1""")
def overview_change(spark, d):
    last = J.latest(
        C.candles(spark, d, "1D").withColumn("prev", F.lag("close").over(S.by_time())), ["symbol"], ["open_ts"]
    )
    return last.select("symbol", "close", F.round(100 * (F.col("close") - F.col("prev")) / F.col("prev"), 6).alias("change_pct"))


@query("venue_ranking", """
SELECT symbol, round(sum(price), 2) AS quote_volume, rank() OVER (ORDER BY round(sum(price), 2) DESC, symbol) AS place
FROM (SELECT event_type AS symbol, round(value, 2) AS price FROM events WHERE value IS NOT NULL) GROUP BY symbol""")
def venue_ranking(spark, d):
    sums = C.event_ticks(spark, d).where("price is not null").groupBy("symbol").agg(F.round(F.sum("price"), 2).alias("quote_volume"))
    # One row per symbol: the ranking is over the universe, not over ticks.
    return sums.withColumn("place", F.rank().over(Window.orderBy(F.desc("quote_volume"), "symbol")).cast("long"))


@query("aggregate_reconcile", with_tables("""
, a AS (SELECT symbol, open_ts // 14400 * 14400 AS bucket, max(high) AS high, min(low) AS low, sum(volume) AS volume, count(*) AS n FROM c GROUP BY ALL),
k AS (
  SELECT event_type AS symbol, floor(epoch(ts) / 14400)::BIGINT * 14400 AS bucket, max(round(value, 2)) AS high, min(round(value, 2)) AS low, count(*)::DOUBLE AS volume
  FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT coalesce(a.symbol, k.symbol) AS symbol,
  CASE WHEN a.symbol IS NULL OR a.n < 4 THEN 'INCOMPLETE' WHEN a.high = k.high AND a.low = k.low AND a.volume = k.volume THEN 'MATCH' ELSE 'MISMATCH' END AS status, count(*) AS n
FROM a FULL JOIN k ON a.symbol = k.symbol AND a.bucket = k.bucket GROUP BY ALL""", "c"))
def aggregate_reconcile(spark, d):
    ours = C.resample(C.candles(spark, d, TF), "4H").select("symbol", "open_ts", F.struct("high", "low", "volume").alias("a"))
    direct = C.bars_from_ticks(C.event_ticks(spark, d), "4H").select("symbol", "open_ts", F.struct("high", "low", "volume").alias("k"))
    status = F.when(F.col("a").isNull(), "INCOMPLETE").when(F.col("a").eqNullSafe(F.col("k")), "MATCH").otherwise("MISMATCH")
    return ours.join(direct, ["symbol", "open_ts"], "full").groupBy("symbol", status.alias("status")).agg(F.count("*").alias("n"))
