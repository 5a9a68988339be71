"""Queries of the universe over three venues, and of prices that run away from the last closed bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import venues as V
from ..sources import candles as C
from .catalog import query

# A look every four hours; ranks, floor and warm-up of five underlyings over a month.
STEP, SEEDS, RANKS, FLOOR, WARM_UP = 14400, ("view-USD", "click-USD"), 4, 60.0, 6

_LISTINGS = f"""
WITH ls AS (
  SELECT CASE user_id % 3 WHEN 0 THEN event_type || 'USDT' WHEN 1 THEN 'PF_' || event_type || 'USD' ELSE event_type || '-USD' END AS symbol, event_type AS base, user_id % 3 AS venue,
    floor(epoch(ts) / {STEP})::BIGINT * {STEP} AS look, round(sum(round(value, 2)), 2) AS volume
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL)"""
_TRADED = """,
tb AS (SELECT look, base, arg_max(symbol, CASE venue WHEN 0 THEN 1 ELSE 0 END) AS symbol, arg_max(volume, CASE venue WHEN 0 THEN 1 ELSE 0 END) AS volume FROM ls WHERE venue <> 1 GROUP BY look, base)"""
_LOOKS = f""",
gr AS (SELECT symbol, unnest(range(a, (SELECT max(look) FROM ls) + 1, {STEP})) AS look FROM (SELECT symbol, min(look) AS a FROM ls GROUP BY symbol)),
lk0 AS (SELECT gr.look, count(*) AS listed, count(ls.volume) AS answered FROM gr LEFT JOIN ls USING (symbol, look) GROUP BY gr.look),
lk AS (SELECT *, answered / listed AS coverage, answered / listed >= {V.MIN_COVERAGE} AS taken FROM lk0),
st AS (SELECT *, (SELECT max(o.look) FROM lk o WHERE o.taken AND o.look <= lk.look) AS standing FROM lk)"""
_MEMBERS = _TRADED + f""",
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY look ORDER BY volume DESC, symbol) AS rank FROM tb) WHERE rank <= {RANKS}),
sd(symbol, base) AS (VALUES ('view-USD', 'view'), ('click-USD', 'click')),
m0 AS (
  SELECT look, symbol, base, rank, volume, 'RANKED' AS kind FROM rk
  UNION ALL SELECT a.look, sd.symbol, sd.base, NULL, NULL, 'ANCHOR' FROM (SELECT DISTINCT look FROM ls) a, sd WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.look = a.look AND rk.base = sd.base)
  UNION ALL SELECT look, symbol, base, NULL, volume, 'SHADOW' FROM ls WHERE venue = 1 AND volume >= {FLOOR}),
m1 AS (SELECT m0.*, (SELECT count(*) FROM ls WHERE ls.symbol = m0.symbol AND ls.look <= m0.look) AS n, m0.symbol IN (SELECT symbol FROM sd) AS seed FROM m0),
mb AS (
  SELECT look, symbol, base, rank, n,
    CASE WHEN kind = 'SHADOW' THEN 'SHADOW' WHEN kind = 'RANKED' AND volume < {FLOOR} AND NOT seed THEN 'REJECTED' WHEN n < {WARM_UP} THEN 'WARMING' ELSE 'ADMITTED' END AS state,
    CASE WHEN kind = 'SHADOW' THEN 'warming_for_venue_switch' WHEN kind = 'ANCHOR' THEN 'seed_anchor' WHEN volume < {FLOOR} AND NOT seed THEN 'below_liquidity_floor'
      WHEN n < {WARM_UP} THEN 'insufficient_history' ELSE 'liquid_and_warm' END AS reason
  FROM m1)"""


def _listings(spark, d) -> DataFrame:
    """Each user's quotes are on one of the three venues."""
    name = F.col("event_type")
    at_venue = F.when(F.col("user_id") % 3 == 0, F.concat(name, F.lit("USDT"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("PF_"), name, F.lit("USD"))).otherwise(F.concat(name, F.lit("-USD")))
    at = C.epoch_seconds(F.col("ts"))
    quotes = spark.read.parquet(f"{d}/events.parquet").where("value is not null and user_id is not null")
    return quotes.groupBy(at_venue.alias("symbol"), (at - F.pmod(at, F.lit(STEP))).alias("look")).agg(F.round(F.sum(F.round("value", 2)), 2).alias("volume"))


def _members(spark, d) -> DataFrame:
    return V.members(_listings(spark, d), SEEDS, RANKS, FLOOR, WARM_UP)


@query("venue_listings", _LISTINGS + """
SELECT look, base, arg_max(symbol, CASE venue WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS symbol, arg_max(volume, CASE venue WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS volume FROM ls GROUP BY look, base""")
def venue_listings(spark, d):
    """Each look's one listing an underlying, over all three venues."""
    return V.one_per_base(_listings(spark, d))


@query("universe_refreshes", _LISTINGS + _LOOKS + " SELECT look, listed, answered, round(coverage, 6) AS coverage, taken, standing FROM st")
def universe_refreshes(spark, d):
    return V.refreshes(_listings(spark, d), STEP).withColumn("coverage", F.round("coverage", 6))


@query("venue_members", _LISTINGS + _MEMBERS + " SELECT look, symbol, base, rank, state, reason, n FROM mb")
def venue_members(spark, d):
    return _members(spark, d)


@query("scan_sets", _LISTINGS + _LOOKS + _MEMBERS + """
SELECT st.look, mb.symbol, mb.state = 'ADMITTED' AS traded, st.standing AS known FROM st JOIN mb ON mb.look = st.standing WHERE mb.state IN ('ADMITTED', 'SHADOW')""")
def scan_sets(spark, d):
    """What is scanned at each look, traded or watched only, by the last ranking that was taken."""
    looks = V.refreshes(_listings(spark, d), STEP).select("look", F.col("standing").alias("known"))
    held = _members(spark, d).where("state in ('ADMITTED', 'SHADOW')").select(F.col("look").alias("known"), "symbol", (F.col("state") == "ADMITTED").alias("traded"))
    return looks.join(held, "known").select("look", "symbol", "traded", "known")


@query("price_drifts", f"""
WITH t AS (SELECT event_type AS symbol, event_id AS seq, ts, floor(epoch(ts))::BIGINT AS look, round(value, 2) AS price FROM events WHERE value IS NOT NULL),
c AS (
  SELECT symbol, look - look % 900 + 900 AS known, arg_max(price, (ts, seq)) AS close FROM t GROUP BY symbol, look - look % 900 HAVING min(price) > 0),
j AS (SELECT t.*, c.close, c.known, (t.price - c.close) / c.close AS drift FROM t ASOF JOIN c ON t.symbol = c.symbol AND t.look >= c.known)
SELECT symbol, look - look % 900 AS bucket, min(look) AS look, round(arg_min(price, (look, seq)), 2) AS price, round(arg_min(close, (look, seq)), 2) AS close, round(arg_min(drift, (look, seq)), 6) AS drift
FROM j WHERE look - known <= {V.DRIFT_BARS * V.DRIFT_TF} AND abs(drift) >= {V.DRIFT} GROUP BY symbol, look - look % 900""")
def price_drifts(spark, d):
    """The first tick of a quarter of an hour that is 3 percent off the last closed one."""
    ticks = C.event_ticks(spark, d).where("price is not null")
    bars = C.bars_from_ticks(ticks, "15m").where(C.is_sound())
    told = V.drifts(ticks.select("symbol", C.epoch_seconds(F.col("ts")).alias("look"), "seq", "price"), bars)
    return told.select("symbol", "bucket", "look", "price", "close", F.round("drift", 6).alias("drift"))
