"""Queries of adds to running trades and of what may be forgotten."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import execution as E
from ..operators import retention as R
from ..operators import scalein as A
from ..operators import structure as X
from ..operators import swings as W
from ..streaming.bars import written
from .catalog import ORACLES, QUERIES, query
from .decisions import _BOOK, _bars, plans
from .market import TF, _tiered
from .sql import with_tables

#: The parents' target in R: adds want a trade that may run further than the book's.
TARGET_R = 4
# Days that a run and a superseded fact are kept on tables of a month.
RUN_DAYS, FACT_DAYS = 7, 3

_PARENTS = _BOOK.replace("entry + 2 * (entry - sl) ELSE entry - 2 * (sl - entry)", f"entry + {TARGET_R} * (entry - sl) ELSE entry - {TARGET_R} * (sl - entry)")


@query("scale_ins", with_tables(_PARENTS + f"""
, bt AS (SELECT b.symbol, x.i, b.direction, b.confirmed_at, x.close AS px, x.atr FROM brk b JOIN ba x ON x.symbol = b.symbol AND x.open_ts = b.market_time),
ad AS (
  SELECT p.symbol, p.s, p.setup_id, p.direction, b.i, px, p.entry, p.tp, p.risk, CASE p.direction WHEN 'LONG' THEN 1.0 ELSE -1.0 END AS sg, b.atr, b.confirmed_at
  FROM p JOIN bt b ON b.symbol = p.s AND b.direction = CASE p.direction WHEN 'LONG' THEN 'BULL' ELSE 'BEAR' END AND b.confirmed_at > p.market_time + 3600
  LEFT JOIN book k ON k.setup_id = p.setup_id WHERE k.exit_ts IS NULL OR b.confirmed_at < k.exit_ts),
ag AS (
  SELECT *, round_even(sg * (tp - px) / abs(px - entry), 2) AS rr, row_number() OVER (PARTITION BY setup_id ORDER BY confirmed_at) AS n FROM ad
  WHERE sg * (px - entry) >= {A.AHEAD_R} * risk AND atr IS NOT NULL AND abs(px - entry) > 0 AND abs(px - entry) >= {A.RISK_IN_COSTS} * (7e-4 * px + 0.05 * atr)
    AND sg * (tp - px) > 0 AND round_even(sg * (tp - px) / abs(px - entry), 2) >= {A.MIN_RR}),
af AS (SELECT ag.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = ag.s AND x.i > ag.i AND x.i <= ag.i + 4 AND px BETWEEN x.low AND x.high) AS fill_i, (SELECT max(x.i) FROM ba x WHERE x.symbol = ag.s) AS last_i FROM ag WHERE n <= {A.MAX_ADDS})
SELECT setup_id || '|ADD' || n AS setup_id, setup_id AS parent_id, direction, i + 1 AS order_i, round(px, 6) AS entry, round(entry, 6) AS sl, round(tp, 6) AS tp, rr, fill_i,
  CASE WHEN fill_i IS NOT NULL THEN 'FILLED' WHEN i + 5 > last_i + 1 THEN 'PENDING' ELSE 'MISSED' END AS status
FROM af""", "gap", "brk"))
def scale_ins(spark, d):
    """Adds to the gap-retest trades, held for four risks, on breaks of structure."""
    bars = _bars(spark, d)
    trades = plans(bars)
    risk = F.col("entry") - F.col("sl")
    trades = written(trades.withColumn("tp", F.col("entry") + TARGET_R * risk), "parents")
    ended = E.walk_exits(trades, bars).select("setup_id", "exit_i")
    broken = X.breaks(written(_tiered(bars, W.STRUCTURE_TIER[TF]), "swings"), bars)
    told = A.scale_ins(trades.join(ended, "setup_id", "left"), bars, broken)
    return told.select("setup_id", "parent_id", "direction", "order_i", *[F.round(c, 6).alias(c) for c in ("entry", "sl", "tp")], "rr", "fill_i", "status")


@query("prunable_runs", f"""
WITH r AS (SELECT event_id AS run_id, event_type AS engine, epoch_us(ts) AS run_at, CASE WHEN value IS NULL OR value < 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM events),
l AS (SELECT engine, max((run_at, run_id)) AS last FROM r GROUP BY engine)
SELECT engine, count(*) AS n, min(run_at) AS first_at, max(run_at) AS last_at FROM r JOIN l USING (engine)
WHERE status = 'PASS' AND run_at < (SELECT max(run_at) FROM r) - {RUN_DAYS} * 86400000000 AND (run_at, run_id) <> last AND run_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
GROUP BY engine""")
def prunable_runs(spark, d):
    """Each event as a run of its type's engine, which the customer of its number refers to."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    runs = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("engine"), us.alias("run_at"), F.when(F.col("value").isNull() | (F.col("value") < 1), "FAIL").otherwise("PASS").alias("status")
    )
    named = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("run_id"))
    cutoff = runs.agg(F.max("run_at")).first()[0]
    gone = R.prunable_runs(runs, named, F.lit((cutoff or 0) - RUN_DAYS * 86_400_000_000))
    return gone.groupBy("engine").agg(F.count("*").alias("n"), F.min("run_at").alias("first_at"), F.max("run_at").alias("last_at"))


@query("prunable_facts", f"""
WITH z AS (SELECT * FROM ({ORACLES['zones_created']})), e AS (SELECT DISTINCT zone_id FROM ({ORACLES['zone_events']})),
f AS (SELECT zone_id, confirmed_at, v AS algo_version FROM z, (VALUES ('zone-1'), ('zone-2')) g(v))
SELECT zone_id, algo_version, confirmed_at FROM f WHERE algo_version <> 'zone-2' AND confirmed_at < (SELECT max(confirmed_at) FROM f) - {FACT_DAYS * 86400} AND zone_id NOT IN (SELECT zone_id FROM e)""")
def prunable_facts(spark, d):
    """Of two generations of zones the facts of the older one that no event names."""
    zones = QUERIES["zones_created"](spark, d).select(F.col("zone_id").alias("ref"), "confirmed_at")
    facts = written(zones.select(F.lit("zone").alias("kind"), F.explode(F.array(F.lit("zone-1"), F.lit("zone-2"))).alias("algo_version"), "confirmed_at", "ref"), "zone-facts")
    cutoff = facts.agg(F.max("confirmed_at")).first()[0] or 0
    gone = R.prunable_facts(facts, {"zone": "zone-2"}, F.lit(cutoff - FACT_DAYS * 86400), QUERIES["zone_events"](spark, d).select(F.col("zone_id").alias("ref")))
    return gone.select(F.col("ref").alias("zone_id"), "algo_version", "confirmed_at")
