"""Queries over facts, audits, tails, coarser series and the live bar stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import trading as T
from ..operators import facts as P
from ..operators import joins as J
from ..operators import series as S
from ..operators import swings as W
from ..sources import candles as C
from ..streaming import bars as B
from .catalog import query
from .sql import with_tables

TF, STEP, VERSION = "1H", 3600, "swings-1"


def _swing_facts(spark, d):
    found = W.micro(S.analysed(C.candles(spark, d, TF)))
    rows = found.withColumn("price", F.col("price").cast("decimal(18,2)").cast("string")).withColumn("tf", F.lit(TF))
    return P.as_facts(rows.select("symbol", "tf", "market_time", "confirmed_at", "kind", "price"), "swing", VERSION, ["kind", "price"])


_FACTS = f"""
, f0 AS (
  SELECT symbol, '1H' AS tf, 'swing' AS kind, market_time, confirmed_at, '{VERSION}' AS algo_version,
    '{{"kind":"' || kind || '","price":"' || price::DECIMAL(18,2)::VARCHAR || '"}}' AS payload
  FROM mic),
f AS (SELECT *, sha256(concat_ws('|', symbol, tf, kind, market_time, confirmed_at, algo_version, payload)) AS fact_hash FROM f0)"""


@query("swing_facts", with_tables(_FACTS + " SELECT * FROM f", "mic"))
def swing_facts(spark, d):
    return _swing_facts(spark, d)


@query("facts_appended_twice", with_tables(_FACTS + """
 SELECT symbol, kind, count(DISTINCT fact_hash) AS first_append, 0::BIGINT AS second_append FROM f GROUP BY symbol, kind""", "mic"))
def facts_appended_twice(spark, d):
    """How many facts a first append adds, and a second append of the same rows."""
    new = _swing_facts(spark, d)
    held = P.append(new.where("false"), new)
    again = P.append(held, new).groupBy("symbol", "kind").agg(F.count("*").alias("second_append"))
    first = held.groupBy("symbol", "kind").agg(F.count("*").alias("first_append"))
    return first.join(again, ["symbol", "kind"], "left").na.fill(0, ["second_append"])


@query("facts_as_of_noon", with_tables(_FACTS + """
, s AS (SELECT (SELECT min(open_ts) FROM c) + 10 * 86400 + 43200 AS known_by)
SELECT symbol, fact_hash, confirmed_at FROM f, s WHERE confirmed_at <= known_by""", "mic"))
def facts_as_of_noon(spark, d):
    """Facts knowable at noon of the eleventh day: the cut is a one-row aggregate."""
    cut = C.candles(spark, d, TF).agg((F.min("open_ts") + 10 * 86400 + 43200).alias("known_by"))
    return P.as_of(_swing_facts(spark, d).join(F.broadcast(cut)), F.col("known_by"), "swing").select("symbol", "fact_hash", "confirmed_at")


@query("latest_swing_per_kind", with_tables("""
 SELECT symbol, kind, max(market_time) AS market_time, arg_max(price, market_time) AS price FROM mic GROUP BY symbol, kind""", "mic"))
def latest_swing(spark, d):
    found = W.micro(S.analysed(C.candles(spark, d, TF))).select("symbol", "kind", "market_time", "price")
    return J.latest(found, ["symbol", "kind"], ["market_time"])


@query("candles_tail", with_tables("""
 SELECT symbol, open_ts, open, high, low, close, volume FROM c
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) <= 50""", "c"))
def candles_tail(spark, d):
    """The last 50 bars of each series, which is the operator's feature."""
    return C.tail(C.candles(spark, d, TF), 50).select("symbol", "open_ts", "open", "high", "low", "close", "volume")


@query("audit_market_inputs", with_tables("""
, a AS (
  SELECT symbol, '1H' AS tf, count(*) AS bars, min(open_ts) AS first_ts, max(open_ts) AS last_ts, 0::BIGINT AS misaligned,
    count(*) FILTER (NOT (high >= greatest(open, close, low) AND low <= least(open, close) AND low > 0)) AS unsound,
    (max(open_ts) - min(open_ts)) // 3600 + 1 - count(DISTINCT open_ts) AS missing
  FROM raw GROUP BY symbol)
SELECT *, CASE WHEN unsound > 0 THEN 'ERROR' WHEN missing > 0 THEN 'WARN' ELSE 'OK' END AS status FROM a""", "raw"))
def audit_market_inputs(spark, d):
    return P.audit_series(C.bars_from_ticks(C.event_ticks(spark, d), TF), C.is_sound(), STEP)


@query("orphan_checks", """
SELECT 'lineitem_order' AS rule, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans
UNION ALL SELECT 'order_customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'customer_nation', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))""")
def orphan_checks(spark, d):
    """Children without a parent, by rule: one anti-join and one count each."""
    rules = (
        ("lineitem_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("order_customer", "orders", "o_custkey", "customer", "c_custkey"),
        ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    )
    out = None
    for rule, child, fk, parent, pk in rules:
        children = spark.read.parquet(f"{d}/{child}.parquet").where(F.col(fk).isNotNull()).select(fk)
        parents = spark.read.parquet(f"{d}/{parent}.parquet").select(F.col(pk).alias(fk))
        one = children.join(parents, fk, "left_anti").agg(F.lit(rule).alias("rule"), F.count("*").alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


@query("daily_fractal_lows", """
WITH d AS (
  SELECT l_returnflag AS symbol, floor(epoch(l_shipdate) / 86400)::BIGINT * 86400 AS open_ts, min(round(l_extendedprice, 2)) AS low
  FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL)
SELECT symbol, open_ts, low FROM d
WINDOW w AS (PARTITION BY symbol ORDER BY open_ts)
QUALIFY low < lag(low, 1) OVER w AND low < lag(low, 2) OVER w AND low < lead(low, 1) OVER w AND low < lead(low, 2) OVER w""")
def daily_fractal_lows(spark, d):
    """Lows strictly below the two before and the two after, on daily bars: the candidates of cycle lows."""
    days = C.lineitem_ticks(spark, d).groupBy("symbol", C.bucket_start(C.epoch_seconds(F.col("ts")), "1D").alias("open_ts")).agg(F.min("price").alias("low"))
    series = Window.partitionBy("symbol").orderBy("open_ts")
    lower = [F.col("low") < f("low", k).over(series) for f in (F.lag, F.lead) for k in (1, 2)]
    marked = days.withColumn("is_low", lower[0] & lower[1] & lower[2] & lower[3])
    return marked.where("is_low").drop("is_low")


@query("candles_15m", """
WITH t AS (SELECT event_type AS symbol, floor(epoch(ts) / 900)::BIGINT * 900 AS open_ts, ts, round(value, 2) AS price FROM events WHERE value IS NOT NULL),
r AS (
  SELECT symbol, open_ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*)::DOUBLE AS volume
  FROM t GROUP BY symbol, open_ts)
SELECT * FROM r WHERE low > 0""")
def candles_15m(spark, d):
    return C.candles(spark, d, "15m").drop("tf")


@query("liquidation_prices", with_tables("""
, l AS (SELECT symbol, open_ts, close, unnest([2.0, 5.0, 10.0]::DOUBLE[]) AS leverage FROM c)
SELECT symbol, open_ts, leverage, round(close * (1 - (1 / leverage - 0.005)), 6) AS long_liquidation,
  round(close * (1 + (1 / leverage - 0.005)), 6) AS short_liquidation FROM l""", "c"))
def liquidation_prices(spark, d):
    levels = C.candles(spark, d, TF).select("symbol", "open_ts", "close", F.explode(F.array(F.lit(2.0), F.lit(5.0), F.lit(10.0))).alias("leverage"))
    at = lambda long: F.round(T.liquidation_price(F.col("close"), F.col("leverage"), F.lit(long)), 6)
    return levels.select("symbol", "open_ts", "leverage", at(True).alias("long_liquidation"), at(False).alias("short_liquidation"))


@query("live_bars_1h", with_tables("""
 SELECT symbol, open_ts, open, high, low, close, volume, '1H' AS tf FROM raw
 WHERE (open_ts + 3600) * 1000 <= (SELECT max(epoch_ms(ts)) FROM events)""", "raw"))
def live_bars(spark, d):
    """The bars that the stream of ticks has closed."""
    path = f"{d}/events.parquet"
    events = B.stream_files(spark, path, spark.read.parquet(path).schema)
    ticks = events.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.round("value", 2).alias("price")
    )
    return B.run_to_end(B.closed_bars(ticks, TF), B.shared_folder(spark, "live-bars"))
