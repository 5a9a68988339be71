"""Evidence and scalar queries: summaries of the book, funding, sizing, labels, ribbon and control-point moves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trading as T
from ..operators import joins as J
from ..operators import series as S
from ..operators import swings as W
from ..sources import candles as C
from .catalog import query
from .decisions import _bars, _on_book, book, plans, settled
from .sql import ema_cte, with_tables

TF, STEP = "1H", 3600
# Trades that a group needs before its rates are told, spread below which
# a factor separates nothing, slope lookbacks of the ribbon and their dead band in ATR,
# the control point's move in ATR.
LEAST_TRADES, FLAT_RATIO = 30, 0.10
RIBBON = (("ema20", 5), ("ema50", 12), ("sma200", 50))
DEAD_BAND, POC_MOVE = 0.25, 1.0


def _risk() -> Column:
    return F.abs(F.col("entry") - F.col("sl"))


def r6(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


@query("breakeven_fee", _on_book("""
, f AS (SELECT avg(r_multiple + fees / risk) AS ex, avg((entry + eff_exit) / risk) AS legs, count(*) AS n FROM book)
SELECT 'phemex-perp' AS venue, n, round(ex, 6) AS mean_r_ex_fee, round(legs, 6) AS mean_legs_r, round(ex / legs, 6) AS per_side, 2 * ex / legs > 7e-4 AS survives FROM f"""))
def breakeven_fee(spark, d):
    """The fee a side at which mean net R is 0, against each venue's round trip.

    The book's venue is told without trades, too.
    """
    venues = spark.range(1).select(T.venue_for(F.lit("USDT")).alias("venue"))
    found = book(spark, d).groupBy(T.venue_for(F.col("symbol")).alias("venue")).agg(
        F.count("*").alias("n"), F.avg(F.col("r_multiple") + F.col("fees") / _risk()).alias("ex"),
        F.avg((F.col("entry") + F.col("eff_exit")) / _risk()).alias("legs"),
        F.first(T.venue_value(F.col("symbol"), "maker") + T.venue_value(F.col("symbol"), "taker")).alias("trip"),
    )
    fee = F.col("ex") / F.col("legs")
    return found.join(venues, "venue", "full").na.fill(0, ["n"]).select("venue", "n", *r6(mean_r_ex_fee=F.col("ex"), mean_legs_r=F.col("legs"), per_side=fee), (2 * fee > F.col("trip")).alias("survives"))


@query("journal_summary", _on_book("""
SELECT direction, count(*) AS n, count(*) FILTER (r_multiple > 0) AS wins, round(avg(r_multiple), 6) AS avg_r, round(max(r_multiple), 6) AS best,
  round(min(r_multiple), 6) AS worst, round(quantile_cont(r_multiple, 0.5), 6) AS median_r, round(quantile_cont(bars_held, 0.5), 6) AS median_held
FROM book GROUP BY direction"""))
def journal_summary(spark, d):
    r = F.col("r_multiple")
    return book(spark, d).groupBy("direction").agg(
        F.count("*").alias("n"), F.count_if(r > 0).alias("wins"),
        *r6(avg_r=F.avg(r), best=F.max(r), worst=F.min(r), median_r=F.percentile(r, 0.5), median_held=F.percentile("bars_held", 0.5)),
    )


@query("strategy_cohorts", _on_book("""
SELECT p.symbol, count(*) AS planned, count(book.setup_id) AS closed, count(*) FILTER (book.r_multiple > 0) AS winners,
  count(*) FILTER (book.outcome = 'SL') AS stop_losses, round(coalesce(sum(book.r_multiple), 0), 6) AS net_r
FROM p LEFT JOIN book USING (setup_id) GROUP BY p.symbol"""))
def strategy_cohorts(spark, d):
    """The funnel from plan to winner, by symbol."""
    bars = _bars(spark, d)
    done = settled(bars).select("setup_id", "outcome", "r_multiple", F.lit(1).alias("closed"))
    told = plans(bars).select("setup_id", "symbol").join(done, "setup_id", "left")
    return told.groupBy("symbol").agg(
        F.count("*").alias("planned"), F.count("closed").alias("closed"), F.count_if(F.col("r_multiple") > 0).alias("winners"),
        F.count_if(F.col("outcome") == "SL").alias("stop_losses"), *r6(net_r=F.coalesce(F.sum("r_multiple"), F.lit(0.0))),
    )


@query("outcome_order", _on_book("""
SELECT outcome, direction, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, outcome, direction) AS place FROM book GROUP BY outcome, direction"""))
def outcome_order(spark, d):
    """Outcomes, most common first; the ranking is over their few kinds."""
    counted = book(spark, d).groupBy("outcome", "direction").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "outcome", "direction")).cast("long"))


@query("outcome_split", _on_book(f"""
, g AS (SELECT r_multiple AS r, CASE WHEN x IS NULL THEN 'missing' WHEN x >= 0.5 THEN 'at_or_above' ELSE 'below' END AS side
  FROM (SELECT r_multiple, CASE WHEN mfe > 0 THEN mae / mfe END AS x FROM book))
SELECT side, count(*) AS n, count(*) FILTER (r > 0) AS n_wins, count(*) >= {LEAST_TRADES} AS sample_ok,
  CASE WHEN count(*) >= {LEAST_TRADES} THEN round(count(*) FILTER (r > 0) / count(*), 6) END AS win_rate,
  CASE WHEN count(*) >= {LEAST_TRADES} THEN round(avg(r), 6) END AS mean_r, round(sum(r), 6) AS total_r
FROM g GROUP BY side"""))
def outcome_split(spark, d):
    """What trades on either side of a factor's threshold earned, and those without the factor."""
    x = F.when(F.col("mfe") > 0, F.col("mae") / F.col("mfe"))
    side = F.when(x.isNull(), "missing").when(x >= 0.5, "at_or_above").otherwise("below")
    n, r = F.count("*"), F.col("r_multiple")
    enough = n >= LEAST_TRADES
    return book(spark, d).groupBy(side.alias("side")).agg(
        n.alias("n"), F.count_if(r > 0).alias("n_wins"), enough.alias("sample_ok"),
        F.when(enough, F.round(F.count_if(r > 0) / n, 6)).alias("win_rate"), F.when(enough, F.round(F.avg(r), 6)).alias("mean_r"), *r6(total_r=F.sum(r)),
    )


@query("factor_verdicts", _on_book(f"""
, fx AS (
  SELECT r_multiple AS r, 'risk_pct' AS factor, risk / entry AS x FROM book
  UNION ALL SELECT r_multiple, 'bars_held', bars_held::DOUBLE FROM book
  UNION ALL SELECT r_multiple, 'excursion', mfe / risk FROM book
  UNION ALL SELECT r_multiple, 'constant', 1.0 FROM book
  UNION ALL SELECT r_multiple, 'absent', NULL FROM book),
fs AS (SELECT factor, count(x) AS n, CASE WHEN stddev_pop(x) > 0 THEN corr(x, r) END AS c, stddev_pop(x) AS sd, max(x) - min(x) AS span FROM fx GROUP BY factor)
SELECT factor, n, CASE WHEN n = 0 THEN 'ABSENT' WHEN sd = 0 THEN 'ZERO_DISPERSION' WHEN sd / span < {FLAT_RATIO} THEN 'FLAT' WHEN n < {LEAST_TRADES} OR c IS NULL THEN 'UNPROVEN'
  WHEN abs(c) < 1.96 / sqrt(n) THEN 'NOISE' WHEN c < 0 THEN 'ANTI' ELSE 'EDGE' END AS verdict
FROM fs"""))
def factor_verdicts(spark, d):
    """Each factor's verdict: absent, without spread, unproven, noise, anti or edge."""
    wide = book(spark, d).select(
        F.col("r_multiple").alias("r"), (_risk() / F.col("entry")).alias("risk_pct"), F.col("bars_held").cast("double").alias("bars_held"),
        (F.col("mfe") / _risk()).alias("excursion"), F.lit(1.0).alias("constant"), F.lit(None).cast("double").alias("absent"),
    )
    long = wide.unpivot(["r"], [c for c in wide.columns if c != "r"], "factor", "x")
    # Pearson's correlation, null without spread on either side.
    corr = F.try_divide(F.covar_pop("x", "r"), F.stddev_pop("x") * F.stddev_pop(F.when(F.col("x").isNotNull(), F.col("r"))))
    s = long.groupBy("factor").agg(F.count("x").alias("n"), F.stddev_pop("x").alias("sd"), (F.max("x") - F.min("x")).alias("span"), corr.alias("c"))
    c = F.col("c")
    verdict = (
        F.when(F.col("n") == 0, "ABSENT").when(F.col("sd") == 0, "ZERO_DISPERSION").when(F.col("sd") / F.nullif("span", F.lit(0.0)) < FLAT_RATIO, "FLAT")
        .when((F.col("n") < LEAST_TRADES) | c.isNull(), "UNPROVEN").when(F.abs(c) < 1.96 / F.sqrt("n"), "NOISE").when(c < 0, "ANTI").otherwise("EDGE")
    )
    return s.select("factor", "n", verdict.alias("verdict"))


@query("underwater", _on_book("""
, o AS (SELECT symbol, exit_ts, setup_id, r_multiple, sum(r_multiple) OVER w AS eq, row_number() OVER w AS n FROM book
  WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, setup_id ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, greatest(max(eq) OVER w, 0) - eq > 1e-9 AS down FROM o WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING)),
g AS (SELECT symbol, down, n - row_number() OVER (PARTITION BY symbol, down ORDER BY n) AS island FROM u)
SELECT symbol, coalesce(max(k), 0) AS longest_underwater FROM (SELECT symbol, island, CASE WHEN down THEN count(*) END AS k FROM g GROUP BY symbol, island, down) GROUP BY symbol"""))
def underwater(spark, d):
    """The longest run of trades below an earlier equity peak."""
    order = Window.partitionBy("symbol").orderBy("exit_ts", "setup_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    told = book(spark, d).select("symbol", "exit_ts", "setup_id", F.sum("r_multiple").over(run).alias("eq"))
    below = told.withColumn("down", F.greatest(F.max("eq").over(run), F.lit(0.0)) - F.col("eq") > 1e-9)
    runs = below.withColumn("peaks", F.sum((~F.col("down")).cast("int")).over(run)).groupBy("symbol", "peaks").agg(F.count_if("down").alias("k"))
    return runs.groupBy("symbol").agg(F.max("k").alias("longest_underwater"))


_FUND = """
, fr AS (SELECT symbol || 'USDT' AS symbol, open_ts AS ts, round((close - open) / open / 100, 8) AS rate FROM c WHERE open_ts % 28800 = 0),
fs AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM fr GROUP BY symbol),
hold AS (SELECT setup_id, symbol, direction, entry, risk, funding, (SELECT open_ts FROM ba WHERE ba.symbol = bk.s AND ba.i = bk.fill_i) AS t0, bars_held FROM bk),
ch AS (
  SELECT hold.setup_id, any_value(hold.symbol) AS symbol, any_value(hold.direction) AS direction, any_value(entry) AS entry, any_value(risk) AS risk, any_value(funding) AS funding,
    count(fr.ts) AS settlements, coalesce(sum(CASE direction WHEN 'LONG' THEN rate ELSE -rate END), 0) AS rate_sum,
    any_value(a <= t0 AND b >= t0 + bars_held * 3600) AS covered
  FROM hold LEFT JOIN fs ON fs.symbol = hold.symbol LEFT JOIN fr ON fr.symbol = hold.symbol AND fr.ts >= t0 AND fr.ts < t0 + bars_held * 3600 GROUP BY hold.setup_id)"""


def _charges(spark, d) -> DataFrame:
    """Each trade's signed sum of the funding settled while it was held.

    The rates stand in for a fetched series: one a settlement, from the bars. A day's
    bin joins them, so a trade meets the settlements of its own days only.
    """
    bars = _bars(spark, d)
    rates = bars.where("open_ts % 28800 = 0").select("symbol", F.col("open_ts").alias("ts"), F.round((F.col("close") - F.col("open")) / F.col("open") / 100, 8).alias("rate"))
    span = rates.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    start = bars.select("symbol", "tf", F.col("i").alias("fill_i"), F.col("open_ts").alias("t0"))
    held = settled(bars).join(start, ["symbol", "tf", "fill_i"]).withColumn("t1", F.col("t0") + F.col("bars_held") * STEP)
    day = lambda c: F.floor(F.col(c) / 86400)
    inside = (
        held.select("setup_id", "symbol", "direction", "t0", "t1", F.explode(F.sequence(day("t0"), day("t1"))).alias("day"))
        .join(rates.withColumn("day", day("ts")), ["symbol", "day"]).where("ts >= t0 and ts < t1")
        .groupBy("setup_id").agg(F.count("*").alias("settlements"), F.sum(F.when(F.col("direction") == "LONG", F.col("rate")).otherwise(-F.col("rate"))).alias("rate_sum"))
    )
    return (
        held.join(inside, "setup_id", "left").join(span, "symbol", "left").na.fill(0, ["settlements", "rate_sum"])
        .withColumn("covered", (F.col("a") <= F.col("t0")) & (F.col("b") >= F.col("t1")))
    )


@query("funding_charges", _on_book(_FUND + " SELECT setup_id, settlements, round(rate_sum, 8) AS rate_sum, round(rate_sum * entry, 6) AS price_units, covered FROM ch"))
def funding_charges(spark, d):
    return _charges(spark, d).select("setup_id", "settlements", F.round("rate_sum", 8).alias("rate_sum"), *r6(price_units=F.col("rate_sum") * F.col("entry")), "covered")


@query("funding_report", _on_book(_FUND + """
 SELECT direction, count(*) AS n, count(*) FILTER (covered) AS covered, round(avg(funding / risk), 6) AS modelled_r,
  round(avg(rate_sum * entry / risk) FILTER (covered), 6) AS paid_r FROM ch GROUP BY direction"""))
def funding_report(spark, d):
    """Modelled funding against what covered trades paid, in R."""
    paid = F.col("rate_sum") * F.col("entry") / _risk()
    return _charges(spark, d).groupBy("direction").agg(
        F.count("*").alias("n"), F.count_if("covered").alias("covered"), *r6(modelled_r=F.avg(F.col("funding") / _risk()), paid_r=F.avg(F.when(F.col("covered"), paid)))
    )


_NAMES = """
, sy AS (SELECT DISTINCT symbol AS s FROM c),
nm AS (SELECT s || 'USDT' AS symbol, 'phemex-perp' AS venue, s AS base, 1e-4 AS maker, 6e-4 AS taker, 3 AS settlements, true AS shorts, 10.0 AS leverage FROM sy
  UNION ALL SELECT 'PF_' || s || 'USD', 'kraken-perp', s, 2e-4, 5e-4, 24, true, 10.0 FROM sy
  UNION ALL SELECT s || '-USD', 'coinbase-spot', s, 4e-3, 6e-3, 0, false, 1.0 FROM sy)"""


def _named(bars: DataFrame) -> DataFrame:
    """Every series under its name at each venue."""
    names = F.array(F.concat("symbol", F.lit("USDT")), F.concat(F.lit("PF_"), "symbol", F.lit("USD")), F.concat("symbol", F.lit("-USD")))
    return bars.withColumn("symbol", F.explode(names))


@query("symbol_venues", with_tables(_NAMES + " SELECT symbol, venue, base, maker, taker, settlements::BIGINT AS settlements, shorts, leverage FROM nm", "c"))
def symbol_venues(spark, d):
    s = F.col("symbol")
    told = _named(C.candles(spark, d, TF).select("symbol").distinct())
    values = [T.venue_value(s, w).cast(t).alias(w) for w, t in (("maker", "double"), ("taker", "double"), ("settlements", "long"), ("shorts", "boolean"), ("leverage", "double"))]
    return told.select("symbol", T.venue_for(s).alias("venue"), T.base_asset(s).alias("base"), *values)


@query("round_trip_costs", with_tables(_NAMES + """
 SELECT nm.symbol, ba.i, round((maker + taker) * close + 0.05 * atr + 1e-4 * 10 * settlements / 24 * close, 6) AS cost
 FROM ba JOIN nm ON nm.base = ba.symbol WHERE atr IS NOT NULL""", "ba"))
def round_trip_costs(spark, d):
    bars = _named(S.analysed(C.candles(spark, d, TF))).where("atr is not null")
    return bars.select("symbol", "i", *r6(cost=T.round_trip_cost(F.col("symbol"), F.col("close"), F.col("atr"), STEP)))


@query("order_sizes", with_tables(_NAMES + """
, q AS (
  SELECT nm.symbol, i, nm.leverage AS cap, long, atr, close AS entry, CASE WHEN long THEN close - k * atr ELSE close + k * atr END AS stop, used
  FROM ba JOIN nm ON nm.base = ba.symbol, (VALUES (true), (false)) l(long), (VALUES (0.02), (1.5)) m(k), (VALUES (0.0), (250.0), (380.0)) o(used) WHERE atr IS NOT NULL),
a AS (SELECT *, abs(entry - stop) AS dist, 200.0 AS intended, 400.0 - used AS budget FROM q),
b2 AS (SELECT *, least(intended, budget) AS reduced, least(intended, budget) / dist * entry / 10000.0 AS lev FROM a),
r AS (SELECT *, CASE WHEN lev > cap THEN round_even(reduced * cap / lev, 2) ELSE reduced END AS risk, least(lev, cap) AS used_lev FROM b2),
z AS (
  SELECT *, risk / dist AS units, CASE WHEN used_lev <= 1 THEN NULL WHEN 1 / used_lev - 0.005 <= 0 THEN entry WHEN long THEN entry * (1 - (1 / used_lev - 0.005)) ELSE entry * (1 + (1 / used_lev - 0.005)) END AS liq
  FROM r),
y AS (
  SELECT *, CASE WHEN dist <= 0 THEN 'INVALID_STOP_DISTANCE' WHEN budget < intended * 0.25 THEN 'EXPOSURE_LIMIT'
    WHEN liq IS NOT NULL AND NOT (CASE WHEN long THEN stop > liq ELSE stop < liq END) THEN 'STOP_BEYOND_LIQUIDATION' WHEN units * entry < 1 THEN 'BELOW_MIN_NOTIONAL' END AS bad,
    CASE WHEN lev > cap THEN 'LEVERAGE_CAP' WHEN budget < intended THEN 'EXPOSURE_LIMIT' END AS cut FROM z)
SELECT symbol, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction, used, CASE WHEN bad IS NOT NULL THEN 'REJECTED' WHEN cut IS NOT NULL THEN 'REDUCED' ELSE 'APPROVED' END AS decision,
  coalesce(bad, cut, 'WITHIN_LIMITS') AS reason, count(*) AS n, round(sum(CASE WHEN bad IS NULL THEN risk ELSE 0 END), 2) AS risk_usd,
  round(max(CASE WHEN bad IS NULL THEN used_lev ELSE 0 END), 4) AS leverage
FROM y GROUP BY ALL""", "ba"))
def order_sizes(spark, d):
    """Orders at every bar's close on each venue, near and far stops, by open risk: what sizing says."""
    many = lambda *x: F.explode(F.array(*[F.lit(v) for v in x]))
    base = _named(S.analysed(C.candles(spark, d, TF))).where("atr is not null").select("symbol", F.col("close").alias("entry"), "atr", many(True, False).alias("long"))
    told = base.withColumn("k", many(0.02, 1.5)).withColumn("used", many(0.0, 250.0, 380.0))
    stop = F.when(F.col("long"), F.col("entry") - F.col("k") * F.col("atr")).otherwise(F.col("entry") + F.col("k") * F.col("atr"))
    order = T.size_order(F.lit(10_000.0), F.col("entry"), F.col("stop"), F.col("symbol"), F.col("long"), F.col("used"))
    sized = told.withColumn("stop", stop).withColumn("o", order)
    return sized.groupBy("symbol", F.when(F.col("long"), "LONG").otherwise("SHORT").alias("direction"), "used", F.col("o.decision").alias("decision"), F.col("o.reason").alias("reason")).agg(
        F.count("*").alias("n"), F.round(F.sum("o.risk_usd"), 2).alias("risk_usd"), F.round(F.max("o.leverage"), 4).alias("leverage")
    )


def _move(k: int) -> Column:
    was = F.lag("close", k).over(S.by_time())
    return F.when(F.col("close") > was, "UP").when(F.col("close") < was, "DOWN").when(was.isNotNull(), "FLAT")


_SIDES = """
, m AS (SELECT symbol, i, close, lag(close) OVER w AS a, lag(close, 4) OVER w AS b4, lag(close, 24) OVER w AS c24 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY i)),
s AS (SELECT symbol, i, list_filter([sign(close - a), sign(close - b4), sign(close - c24)], lambda x: x IS NOT NULL) AS v FROM m),
cm AS (SELECT symbol, i, CASE WHEN len(v) = 0 THEN 'UNKNOWN' WHEN list_contains(v, 1) AND list_contains(v, -1) THEN 'MIXED' WHEN list_contains(v, 1) THEN 'UP' WHEN list_contains(v, -1) THEN 'DOWN' ELSE 'FLAT' END AS side FROM s)"""


@query("side_alignment", with_tables(_SIDES + """
SELECT symbol, i, side, CASE side WHEN 'UP' THEN 'WITH' WHEN 'DOWN' THEN 'AGAINST' ELSE side END AS long_alignment,
  CASE side WHEN 'DOWN' THEN 'WITH' WHEN 'UP' THEN 'AGAINST' ELSE side END AS short_alignment FROM cm""", "b"))
def side_alignment(spark, d):
    """One side of three rungs, and how either direction stands to it."""
    told = _plain(spark, d).withColumn("side", T.composite(F.array(_move(1), _move(4), _move(24))))
    at = lambda direction: T.alignment(F.col("side"), F.lit(direction))
    return told.select("symbol", "i", "side", at("LONG").alias("long_alignment"), at("SHORT").alias("short_alignment"))


def _plain(spark, d) -> DataFrame:
    return S.indexed(C.candles(spark, d, TF))


@query("confirm_bars", with_tables("""
, z AS (SELECT *, greatest(lag(open) OVER w, lag(close) OVER w) AS top, least(lag(open) OVER w, lag(close) OVER w) AS bottom FROM b WINDOW w AS (PARTITION BY symbol ORDER BY i))
SELECT symbol, i, low <= top AND close > top AND (high - low <= 0 OR close >= low + 0.66 * (high - low)) AS up,
  high >= bottom AND close < bottom AND (high - low <= 0 OR close <= high - 0.66 * (high - low)) AS down FROM z WHERE top IS NOT NULL""", "b"))
def confirm_bars(spark, d):
    """Bars that engage the body of the bar before and close out of it in their outer third."""
    before = [F.lag(c).over(S.by_time()) for c in ("open", "close")]
    told = _plain(spark, d).withColumns({"top": F.greatest(*before), "bottom": F.least(*before)}).where("i > 0")
    side = lambda up: T.confirms(F.lit(up), F.col("top"), F.col("bottom"))
    return told.select("symbol", "i", side(True).alias("up"), side(False).alias("down"))


@query("playbook_table", """
SELECT zone_type, regime, evidence, CASE WHEN trend THEN 'PULLBACK' WHEN turn THEN 'REVERSAL' END AS strategy,
  CASE WHEN trend OR turn THEN CASE zone_type WHEN 'DEMAND' THEN 'LONG' ELSE 'SHORT' END END AS direction, CASE WHEN trend THEN 50 WHEN turn THEN 40 END AS rank,
  CASE WHEN regime LIKE '%BULL%' THEN 'UP' WHEN regime LIKE '%BEAR%' THEN 'DOWN' ELSE 'FLAT' END AS side
FROM (
  SELECT *, CASE zone_type WHEN 'DEMAND' THEN regime LIKE '%BULL%' ELSE regime LIKE '%BEAR%' END AS trend, regime = 'TRANSITION' AND evidence AS turn
  FROM (VALUES ('DEMAND'), ('SUPPLY')) z(zone_type), (VALUES ('BULL_TREND'), ('WEAKENING_BULL'), ('BEAR_TREND'), ('WEAKENING_BEAR'), ('RANGE'), ('TRANSITION')) r(regime), (VALUES (true), (false)) e(evidence))""")
def playbook_table(spark, d):
    """The play of every zone type, regime and evidence: the whole decision table."""
    table = spark.range(1).select(F.explode(F.array(F.lit("DEMAND"), F.lit("SUPPLY"))).alias("zone_type"))
    table = table.withColumn("regime", F.explode(F.array(*[F.lit(r) for r in T.REGIME_SIDES]))).withColumn("evidence", F.explode(F.array(F.lit(True), F.lit(False))))
    told = table.withColumn("p", T.playbook(F.col("zone_type"), F.col("regime"), F.col("evidence")))
    return told.select("zone_type", "regime", "evidence", "p.strategy", "p.direction", "p.rank", T.regime_side(F.col("regime")).alias("side"))


@query("facts_in_last_bars", with_tables("""
, l AS (SELECT symbol, min(open_ts) AS cut FROM (SELECT symbol, open_ts, row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) AS k FROM c) WHERE k <= 50 GROUP BY symbol)
SELECT symbol, kind, market_time, price FROM mic JOIN l USING (symbol) WHERE market_time >= cut""", "mic"))
def facts_in_last_bars(spark, d):
    """Swings of the last 50 bars of each series, which is the operator's feature."""
    bars = C.candles(spark, d, TF)
    cut = C.tail(bars, 50).groupBy("symbol").agg(F.min("open_ts").alias("cut"))
    return W.micro(S.analysed(bars)).join(cut, "symbol").where("market_time >= cut").select("symbol", "kind", "market_time", "price")


@query("announceable_swings", with_tables("""
, e AS (SELECT max(open_ts) + 3600 AS now, min(open_ts) + 5 * 86400 AS started FROM c),
g AS (SELECT symbol, kind = 'HIGH' AS state_ok, confirmed_at >= started AS in_baseline, now - confirmed_at <= 2 * 3600 AS fresh FROM mic, e)
SELECT symbol, count(*) AS n, count(*) FILTER (state_ok AND in_baseline AND fresh) AS announced, count(*) FILTER (NOT state_ok) AS wrong_state,
  count(*) FILTER (state_ok AND NOT in_baseline) AS before_baseline, count(*) FILTER (state_ok AND in_baseline AND NOT fresh) AS late,
  count(*) FILTER (in_baseline) AS forward, count(*) FILTER (NOT in_baseline) AS historical FROM g GROUP BY symbol""", "mic"))
def announceable_swings(spark, d):
    """Swings that pass the gates of an announcement, and how many each gate holds back."""
    bars = C.candles(spark, d, TF)
    ends = bars.agg((F.max("open_ts") + STEP).alias("now"), (F.min("open_ts") + 5 * 86400).alias("started"))
    told = W.micro(S.analysed(bars)).join(F.broadcast(ends))  # one row of two numbers
    state, base, fresh = F.col("kind") == "HIGH", F.col("confirmed_at") >= F.col("started"), F.col("now") - F.col("confirmed_at") <= 2 * STEP
    return told.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(state & base & fresh).alias("announced"), F.count_if(~state).alias("wrong_state"),
        F.count_if(state & ~base).alias("before_baseline"), F.count_if(state & base & ~fresh).alias("late"), F.count_if(base).alias("forward"), F.count_if(~base).alias("historical"),
    )


def bin_price(index: Column) -> Column:
    """The lower edge of a price bin; the inverse of ``price_bin``."""
    power = F.floor(index / 9000)
    return (index - power * 9000 + 1000) * F.pow(F.lit(10.0), power - 3)


_POC = """
, pb AS (SELECT symbol, i, volume, pw * 9000 + floor(tp * pow(10, 3 - pw) + 1e-9) - 1000 AS bin
  FROM (SELECT *, floor(log10(tp) + 1e-12) AS pw FROM (SELECT *, (high + low + close) / 3 AS tp FROM b))),
w AS (SELECT x.symbol, x.i, y.bin, sum(y.volume) AS v FROM pb x JOIN pb y ON x.symbol = y.symbol AND y.i BETWEEN x.i - 99 AND x.i WHERE x.i >= 100 GROUP BY ALL),
pc AS (SELECT symbol, i, arg_max(bin, (v, bin)) AS bin FROM w GROUP BY symbol, i),
pp AS (SELECT pc.symbol, pc.i, (bin - floor(bin / 9000) * 9000 + 1000) * pow(10, floor(bin / 9000) - 3) AS poc, atr, row_number() OVER (PARTITION BY pc.symbol ORDER BY pc.i) AS n
  FROM pc JOIN ba ON ba.symbol = pc.symbol AND ba.i = pc.i WHERE atr > 0)"""


@query("price_bin_edges", with_tables(_POC + " SELECT symbol, bin::BIGINT AS bin, count(*) AS n, round((bin - floor(bin / 9000) * 9000 + 1000) * pow(10, floor(bin / 9000) - 3), 8) AS edge FROM pb GROUP BY symbol, bin", "ba"))
def price_bin_edges(spark, d):
    at = S.price_bin((F.col("high") + F.col("low") + F.col("close")) / 3)
    return _plain(spark, d).groupBy("symbol", at.alias("bin")).agg(F.count("*").alias("n")).withColumn("edge", F.round(bin_price(F.col("bin")), 8))


def _moved(frame: pd.DataFrame) -> pd.DataFrame:
    """The control points at least an ATR away from the last one told."""
    frame, told, rows = frame.sort_values("i"), None, []
    for i, poc, atr in zip(frame["i"], frame["poc"], frame["atr"], strict=True):
        if told is None or abs(poc - told) >= POC_MOVE * atr:
            rows.append((i, "CHANGED" if rows else "ESTABLISHED", poc, told))
            told = poc
    out = pd.DataFrame(rows, columns=["i", "state", "poc", "prev_poc"])
    return out.assign(symbol=frame["symbol"].iloc[0])[["symbol", "i", "state", "poc", "prev_poc"]]


@query("poc_moves", with_tables(_POC + """
, mv AS (
  SELECT symbol, n, i, poc, poc AS told, NULL::DOUBLE AS prev, true AS moved FROM pp WHERE n = 1
  UNION ALL
  SELECT pp.symbol, pp.n, pp.i, pp.poc, CASE WHEN abs(pp.poc - mv.told) >= pp.atr THEN pp.poc ELSE mv.told END, mv.told, abs(pp.poc - mv.told) >= pp.atr
  FROM mv JOIN pp ON pp.symbol = mv.symbol AND pp.n = mv.n + 1)
SELECT symbol, i, CASE WHEN prev IS NULL THEN 'ESTABLISHED' ELSE 'CHANGED' END AS state, round(poc, 8) AS poc, round(prev, 8) AS prev_poc FROM mv WHERE moved""", "ba"))
def poc_moves(spark, d):
    """Moves of the rolling control point against the last one told: only this choice is a fold."""
    bars = S.analysed(C.candles(spark, d, TF))
    poc = S.rolling_poc(bars).where("i >= 100").select("symbol", "tf", "i", bin_price(F.col("poc_bin")).alias("poc"))
    told = poc.join(bars.where("atr > 0").select("symbol", "tf", "i", "atr"), ["symbol", "tf", "i"])
    return J.fold_series(told, _moved, "symbol string, i long, state string, poc double, prev_poc double").withColumns({c: F.round(c, 8) for c in ("poc", "prev_poc")})


_RIBBON = f"""
, {ema_cte('e2', 20)}, {ema_cte('e5', 50)},
rb AS (
  SELECT ba.symbol, ba.i, close, atr, tol, e2.v AS ema20, e5.v AS ema50, CASE WHEN ba.i >= 199 THEN avg(close) OVER (PARTITION BY ba.symbol ORDER BY ba.i ROWS 199 PRECEDING) END AS sma200
  FROM ba LEFT JOIN e2 ON e2.symbol = ba.symbol AND e2.i = ba.i LEFT JOIN e5 ON e5.symbol = ba.symbol AND e5.i = ba.i),
dl AS (SELECT *, ema20 - lag(ema20, 5) OVER w AS d20, ema50 - lag(ema50, 12) OVER w AS d50, sma200 - lag(sma200, 50) OVER w AS d200 FROM rb WINDOW w AS (PARTITION BY symbol ORDER BY i)),
sl AS (
  SELECT *, last_value(CASE WHEN d20 > 0.25 * atr THEN 'UP' WHEN d20 < -0.25 * atr THEN 'DOWN' END IGNORE NULLS) OVER w AS s20,
    last_value(CASE WHEN d50 > 0.25 * atr THEN 'UP' WHEN d50 < -0.25 * atr THEN 'DOWN' END IGNORE NULLS) OVER w AS s50,
    last_value(CASE WHEN d200 > 0.25 * atr THEN 'UP' WHEN d200 < -0.25 * atr THEN 'DOWN' END IGNORE NULLS) OVER w AS s200,
    CASE WHEN ema20 > ema50 + tol AND ema50 > sma200 + tol THEN 'BULL' WHEN ema20 < ema50 - tol AND ema50 < sma200 - tol THEN 'BEAR' ELSE 'MIXED' END AS stack,
    CASE WHEN close > greatest(ema20, ema50, sma200) + tol THEN 'ABOVE' WHEN close < least(ema20, ema50, sma200) - tol THEN 'BELOW' ELSE 'INSIDE' END AS position
  FROM dl WHERE i >= 199 WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, (stack, position, s20, s50, s200) AS state, lag((stack, position, s20, s50, s200)) OVER (PARTITION BY symbol ORDER BY i) AS was FROM sl)"""


def ribbon_changes(bars: DataFrame) -> DataFrame:
    """The bars where the ribbon's stack, the close's place or a latched slope changes; ``was`` is the state before."""
    bars = bars.withColumn("sma200", S.sma("close", 200))
    bars = bars.withColumns({f"d_{c}": F.col(c) - F.lag(c, k).over(S.by_time()) for c, k in RIBBON}).where("i >= 199 and atr is not null")
    band, tol, fast, mid, slow = DEAD_BAND * F.col("atr"), F.col("tol"), F.col("ema20"), F.col("ema50"), F.col("sma200")
    slope = lambda c: S.latch(F.when(F.col(f"d_{c}") > band, "UP").when(F.col(f"d_{c}") < -band, "DOWN"))
    stack = F.when((fast > mid + tol) & (mid > slow + tol), "BULL").when((fast < mid - tol) & (mid < slow - tol), "BEAR").otherwise("MIXED")
    place = F.when(F.col("close") > F.greatest(fast, mid, slow) + tol, "ABOVE").when(F.col("close") < F.least(fast, mid, slow) - tol, "BELOW").otherwise("INSIDE")
    told = bars.withColumns({f"slope_{c}": slope(c) for c, _ in RIBBON} | {"stack": stack, "position": place})
    state = F.struct("stack", "position", *[f"slope_{c}" for c, _ in RIBBON])
    return told.withColumn("state", state).withColumn("was", F.lag("state").over(S.by_time())).where("not (state <=> was)")


@query("ma_ribbon_events", with_tables(_RIBBON + """
SELECT symbol, i, CASE WHEN was IS NULL THEN 'ESTABLISHED' ELSE 'CHANGED' END AS event, stack, position, s20 AS slope_ema20, s50 AS slope_ema50, s200 AS slope_sma200
FROM st WHERE was IS DISTINCT FROM state""", "ba"))
def ma_ribbon_events(spark, d):
    """Changes of the ribbon's stack, the close's place and the latched slopes, from bar 199 on."""
    moved = ribbon_changes(S.analysed(C.candles(spark, d, TF)))
    event = F.when(F.col("was").isNull(), "ESTABLISHED").otherwise("CHANGED")
    return moved.select("symbol", "i", event.alias("event"), "stack", "position", *[f"slope_{c}" for c, _ in RIBBON])
