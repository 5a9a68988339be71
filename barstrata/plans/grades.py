"""Matching, factor grades and the life of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as A
from ..operators import findings as N
from ..operators import matching as M
from ..sources import candles as C
from ..streaming.bars import shared_folder, written
from .catalog import query
from .decisions import _on_book, book
from .market import TF
from .setups import structure_facts
from .sql import with_tables

DAY = 86400

_MATCH = """
, dx AS (
  SELECT symbol, 'HIGH' AS kind, open_ts // 86400 * 86400 AS w, max(high) AS price FROM ba GROUP BY 1, 3
  UNION ALL SELECT symbol, 'LOW', open_ts // 86400 * 86400, min(low) FROM ba GROUP BY 1, 3),
wq AS (
  SELECT d.*, row_number() OVER (PARTITION BY d.symbol, d.kind ORDER BY w) AS n,
    (SELECT list(s.market_time ORDER BY s.market_time) FROM sco s WHERE s.symbol = d.symbol AND s.kind = d.kind AND abs(s.market_time - d.w) <= 86400 AND abs(s.price - d.price) / d.price <= 0.10) AS near
  FROM dx d),
gm AS (
  SELECT symbol, kind, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS w, NULL::BIGINT AS f FROM (SELECT DISTINCT symbol, kind FROM wq)
  UNION ALL
  SELECT symbol, kind, n, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, w, f
  FROM (SELECT q.symbol, q.kind, q.n, q.w, g.used, list_filter(coalesce(q.near, []), lambda x: NOT list_contains(g.used, x))[1] AS f FROM gm g JOIN wq q ON q.symbol = g.symbol AND q.kind = g.kind AND q.n = g.n + 1))
"""


@query("pivot_matches", with_tables(_MATCH + """
SELECT symbol, kind, w AS day, f AS swing_ts, CASE WHEN f IS NULL THEN 'MISS' ELSE 'MATCH' END AS result FROM gm WHERE n > 0
UNION ALL
SELECT symbol, kind, NULL, market_time, 'EXTRA' FROM sco s WHERE NOT EXISTS (SELECT 1 FROM gm WHERE gm.symbol = s.symbol AND gm.kind = s.kind AND gm.f = s.market_time)""", "sco"))
def pivot_matches(spark, d):
    """Each day's extremes against the scored swings, one to one within a day and a tenth of the price."""
    facts = structure_facts(spark, d)
    bars, swings = facts.bars, facts.swings
    key = ["symbol", "kind"]
    kinds = F.explode(F.array(F.lit("HIGH"), F.lit("LOW")))
    day = C.bucket_start(F.col("open_ts"), "1D")
    price = F.when(F.col("kind") == "HIGH", F.max("high")).otherwise(F.min("low"))
    days = bars.withColumn("kind", kinds).groupBy(*key, day.alias("w")).agg(price.alias("price")).withColumns({"time": F.col("w"), "tolerance": F.lit(DAY)})
    engine = swings.select(*key, F.col("market_time").alias("f"), F.col("market_time").alias("time"), "price")
    taken = M.greedy_match(M.candidates(days, engine, key, 0.10), key)
    told = days.select(*key, "w").join(taken, [*key, "w"], "full_outer")
    told = told.select(*key, F.col("w").alias("day"), F.col("f").alias("swing_ts"), F.when(F.col("f").isNull(), "MISS").otherwise("MATCH").alias("result"))
    extra = engine.join(taken, [*key, "f"], "left_anti").select(*key, F.lit(None).cast("long").alias("day"), F.col("f").alias("swing_ts"), F.lit("EXTRA").alias("result"))
    return told.unionByName(extra)


_FACTORS = {
    "risk_share": "risk / entry", "held": "bars_held::DOUBLE", "excursion_r": "mfe / risk", "adverse_r": "mae / risk", "entry_level": "entry", "stop_level": "sl", "target_level": "tp",
    "is_long": "CASE direction WHEN 'LONG' THEN 1.0 ELSE 0.0 END", "long_hold": "CASE WHEN bars_held >= 60 THEN 1.0 ELSE 0.0 END", "constant": "1.0", "absent": "NULL::DOUBLE",
}
_NAMES = list(_FACTORS)
_GRADES = f"""
, cd AS (SELECT r_multiple AS r, {', '.join(f'{x} AS {n}' for n, x in _FACTORS.items())} FROM book),
lg AS (SELECT row_number() OVER () AS id, * FROM cd),
lo AS ({' UNION ALL '.join(f"SELECT id, r, '{n}' AS a, {n} AS x FROM lg" for n in _NAMES)}),
ag AS (
  SELECT a, count(x) AS n_observed, count(*) FILTER (x <> 0) AS n_present, count(*) FILTER (x <> 0) / count(*) AS fire_rate, coalesce(stddev_pop(x), 0) AS sd,
    coalesce(stddev_pop(x) / nullif(max(x) - min(x), 0), 0) AS dispersion, CASE WHEN count(x) >= 30 AND stddev_pop(x) > 0 THEN corr(x, r) END AS rr FROM lo GROUP BY a),
sg AS (SELECT *, CASE WHEN n_observed = 0 OR n_present = 0 THEN 'ABSENT' WHEN fire_rate < 0.1 THEN 'RARE' WHEN sd = 0 THEN 'ZERO_DISPERSION' WHEN dispersion < 0.1 THEN 'FLAT' END AS structural FROM ag),
ed AS (
  SELECT p.a, q.a AS b FROM lo p JOIN lo q ON p.id = q.id AND p.a <> q.a WHERE p.x IS NOT NULL AND q.x IS NOT NULL
    AND p.a IN (SELECT a FROM sg WHERE structural IS NULL) AND q.a IN (SELECT a FROM sg WHERE structural IS NULL)
  GROUP BY p.a, q.a HAVING abs(corr(p.x, q.x)) >= 0.7),
cl AS (SELECT a, a AS b FROM sg WHERE structural IS NULL UNION SELECT cl.a, ed.b FROM cl JOIN ed ON ed.a = cl.b),
gr AS (SELECT a, min(b) AS grp FROM cl GROUP BY a),
pk AS (SELECT sg.*, grp, CASE WHEN grp IS NOT NULL THEN row_number() OVER (PARTITION BY grp ORDER BY coalesce(abs(rr), -1) DESC, dispersion DESC, a) END AS place FROM sg LEFT JOIN gr USING (a))
SELECT a AS factor, n_observed, n_present, round(fire_rate, 6) AS fire_rate, round(dispersion, 6) AS dispersion, round(rr, 6) AS r, grp AS cluster,
  CASE WHEN structural IS NOT NULL THEN structural WHEN place > 1 THEN 'REDUNDANT' WHEN rr IS NULL THEN 'UNPROVEN' WHEN abs(rr) < 1.96 / sqrt(n_observed) THEN 'NOISE' WHEN rr < 0 THEN 'ANTI' ELSE 'EDGE' END AS verdict
FROM pk"""


@query("factor_clusters", _on_book(_GRADES))
def factor_clusters(spark, d):
    """Factors of the book's trades, with those that echo a stronger one of their cluster."""
    risk = F.abs(F.col("entry") - F.col("sl"))
    wide = book(spark, d).select(
        F.col("r_multiple").alias("r"), (risk / F.col("entry")).alias("risk_share"), F.col("bars_held").cast("double").alias("held"), (F.col("mfe") / risk).alias("excursion_r"),
        (F.col("mae") / risk).alias("adverse_r"), F.col("entry").alias("entry_level"), F.col("sl").alias("stop_level"), F.col("tp").alias("target_level"),
        (F.col("direction") == "LONG").cast("double").alias("is_long"), (F.col("bars_held") >= 60).cast("double").alias("long_hold"), F.lit(1.0).alias("constant"),
        F.lit(None).cast("double").alias("absent"),
    )
    told = A.grades(wide, _NAMES, "r")
    return told.select("factor", "n_observed", "n_present", *[F.round(c, 6).alias(c) for c in ("fire_rate", "dispersion", "r")], F.col("group").alias("cluster"), "verdict")


#: Days between two looks at the missing bars, and the days that a look goes back.
LOOK_DAYS, BACK_DAYS, LOOKS = 6, 8, 4


@query("finding_life", with_tables(f"""
, sp AS (SELECT symbol, min(open_ts) AS a, max(open_ts) AS z FROM c GROUP BY symbol),
ms AS (SELECT symbol, unnest(generate_series(a, z, 3600)) AS missing FROM sp EXCEPT SELECT symbol, open_ts FROM c),
lk AS (SELECT (SELECT min(a) FROM sp) // 86400 * 86400 + {LOOK_DAYS * DAY} * k AS at_ts FROM generate_series(1, {LOOKS}) g(k)),
sn AS (SELECT symbol, missing, at_ts FROM ms, lk WHERE missing < at_ts AND missing >= at_ts - {BACK_DAYS * DAY}),
ag AS (SELECT symbol, missing, min(at_ts) AS first_seen, max(at_ts) AS last_seen FROM sn GROUP BY symbol, missing)
SELECT symbol, missing, first_seen, last_seen, (SELECT min(at_ts) FROM lk WHERE at_ts > last_seen) AS closed_at FROM ag""", "c"))
def finding_life(spark, d):
    """Missing bars as four looks at the last days see them: since when, until when, closed when."""
    bars = written(C.candles(spark, d, TF), "bars")
    missing = written(C.gaps(bars).select("symbol", F.col("open_ts").alias("missing")), "missing")
    start = bars.agg(F.min("open_ts")).first()[0] // DAY * DAY
    path, told = shared_folder(spark, "findings"), None
    for k in range(1, LOOKS + 1):
        at = start + LOOK_DAYS * DAY * k
        seen = missing.where((F.col("missing") < at) & (F.col("missing") >= at - BACK_DAYS * DAY))
        told = N.look(spark, path, seen, ["symbol", "missing"], at, "symbol")
    return told
