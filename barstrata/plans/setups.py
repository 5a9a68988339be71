"""Setup queries: the race at each zone, its targets and what became of it, at three venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trading import venue_value
from ..operators import setups as U
from ..operators import structure as X
from ..operators import swings as W
from ..streaming.bars import written
from .catalog import query
from .evidence import _NAMES, _named
from .market import TF, _pivots, _shared
from .sql import with_tables
from .store import kept

#: The queries arm orders on the test tables' own timeframe, too.
ARMING = (TF, *U.FORMING_TFS)


def structure_facts(spark: SparkSession, d: str) -> U.Facts:
    """The facts that setups read, each computed once a session."""

    def make() -> U.Facts:
        bars = _shared(spark, d)
        swings = written(W.scored(_pivots(bars), bars), "swings")
        tiered = swings.where(F.col("tier") == W.STRUCTURE_TIER[TF])
        broken = written(X.breaks(tiered, bars), "breaks")
        zones = written(X.zones(swings), "zones")
        pools = written(X.pools(swings), "pools")
        return U.Facts(
            bars, zones, written(X.zone_events(zones, bars), "zone-events"), written(X.regimes(X.labels(tiered), broken), "regimes"), broken, pools,
            written(X.pool_events(pools, bars), "pool-events"), swings,
        )

    return kept(spark, f"{d}/events.parquet", f"structure-{TF}", make)


def named_facts(spark: SparkSession, d: str) -> U.Facts:
    """The same facts under each series' name at each venue."""
    plain = structure_facts(spark, d)
    return U.Facts(**{name: _named(table) for name, table in vars(plain).items()})


def setup_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All states of the setups, and the rejections, computed once a session."""

    def make() -> tuple[DataFrame, DataFrame]:
        told, refused = U.setups(named_facts(spark, d), ARMING)
        return written(told, "setups"), written(refused, "setup-rejections")

    return kept(spark, f"{d}/events.parquet", f"setups-{TF}", make)


def _target(symbol: str, long: str, price: str, as_of: str) -> str:
    """The nearest active level as correlated subqueries: pools, else swings."""
    def side(table: str, value: str, alive: str) -> str:
        known = f"FROM {table} q WHERE q.symbol = {symbol} AND q.confirmed_at <= {as_of}{alive}"
        return (
            f"CASE WHEN {long} THEN (SELECT min(q.{value}) {known} AND q.kind = 'HIGH' AND q.{value} > {price}) "
            f"ELSE (SELECT max(q.{value}) {known} AND q.kind = 'LOW' AND q.{value} < {price}) END"
        )

    return f"coalesce({side('pev', 'level', f' AND (q.broken_at IS NULL OR q.broken_at + 3600 > {as_of})')}, {side('sco', 'price', '')})"


_PLAY = """CASE WHEN zone_type = 'DEMAND' AND regime IN ('BULL_TREND', 'WEAKENING_BULL') OR zone_type = 'SUPPLY' AND regime IN ('BEAR_TREND', 'WEAKENING_BEAR') THEN 'PULLBACK'
    WHEN regime = 'TRANSITION' AND {evidence} THEN 'REVERSAL' END"""
_COST = "((maker + taker) * entry + 0.05 * atr + 1e-4 * 10 * settlements / 24 * entry)"

_SETUPS = f"""
, tch AS (
  SELECT z.*, zone_type = 'DEMAND' AS long,
    (SELECT min(x.i) FROM ba x WHERE x.symbol = z.symbol AND x.i > z.i AND x.open_ts + 3600 > z.confirmed_at AND (z.broken_i IS NULL OR x.i < z.broken_i)
      AND x.low <= z.top AND x.high >= z.bottom) AS touch_i,
    (SELECT min(x.i) FROM ba x WHERE x.symbol = z.symbol AND x.i > z.i AND x.open_ts + 3600 > z.confirmed_at
      AND CASE zone_type WHEN 'DEMAND' THEN x.low <= z.top ELSE x.high >= z.bottom END) AS reach_i
  FROM zbr z),
zz AS (
  SELECT t.*, a.open_ts AS touch_ts, b.open_ts AS broken_ts
  FROM tch t LEFT JOIN ba a ON a.symbol = t.symbol AND a.i = t.touch_i LEFT JOIN ba b ON b.symbol = t.symbol AND b.i = t.broken_i),
vol AS (
  SELECT symbol, i, lead(open) OVER (PARTITION BY symbol ORDER BY i) AS next_open, max(i) OVER (PARTITION BY symbol) AS last_i,
    CASE WHEN i >= 20 THEN round_even(volume / avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 2) END AS vr
  FROM ba),
cnd AS (
  SELECT z.*, x.i AS j, x.open_ts AS bar_ts, x.atr, CASE WHEN long THEN z.top ELSE z.bottom END AS entry,
    CASE WHEN long THEN z.bottom - 0.25 * x.atr ELSE z.top + 0.25 * x.atr END AS sl,
    (SELECT max((r.confirmed_at, r.regime)) FROM reg r WHERE r.symbol = z.symbol AND r.confirmed_at <= x.open_ts + 3600)[2] AS regime,
    EXISTS (SELECT 1 FROM pev s WHERE s.symbol = z.symbol AND s.kind = CASE WHEN z.long THEN 'LOW' ELSE 'HIGH' END AND x.open_ts - s.swept_at BETWEEN 0 AND 36000) AS swept
  FROM zz z JOIN ba x ON x.symbol = z.symbol AND x.i > z.i AND x.open_ts + 3600 > z.confirmed_at AND x.i < least(coalesce(reach_i, 1e9), coalesce(touch_i, 1e9), coalesce(broken_i, 1e9))
    AND x.atr IS NOT NULL AND CASE WHEN z.long THEN x.low - z.top ELSE z.bottom - x.high END <= x.atr),
cn2 AS (SELECT *, {_PLAY.format(evidence="swept")} AS strategy FROM cnd),
cn3 AS (SELECT c.*, {_target("c.symbol", "c.long", "c.entry", "c.bar_ts + 3600")} AS tp FROM cn2 c WHERE strategy IS NOT NULL),
cn4 AS (SELECT *, abs(entry - sl) AS risk, round_even((CASE WHEN long THEN tp - entry ELSE entry - tp END) / abs(entry - sl), 2) AS rr FROM cn3),
arm AS (
  SELECT n.symbol AS venue_symbol, n.leverage AS cap, c.*, n.symbol || '|1H|' || strategy || '|' || zone_id || '|v1' AS setup_id
  FROM cn4 c JOIN nm n ON n.base = c.symbol WHERE rr >= 1.5 AND risk >= 2 * {_COST}
  QUALIFY row_number() OVER (PARTITION BY n.symbol, zone_id ORDER BY j) = 1),
ar2 AS (SELECT *, least(200.0 / risk * entry / 10000.0, cap) AS lev, CASE WHEN 200.0 / risk * entry / 10000.0 > cap THEN round_even(200.0 * cap / (200.0 / risk * entry / 10000.0), 2) ELSE 200.0 END AS usd FROM arm),
ar3 AS (
  SELECT *, CASE WHEN lev > 1 AND CASE WHEN 1 / lev - 0.005 <= 0 THEN CASE WHEN long THEN sl <= entry ELSE sl >= entry END
      WHEN long THEN sl <= entry * (1 - (1 / lev - 0.005)) ELSE sl >= entry * (1 + (1 / lev - 0.005)) END THEN 0.0
    WHEN usd / risk * entry < 1 THEN 0.0 ELSE usd / risk END AS units FROM ar2),
sn AS (
  SELECT z.*,
    (SELECT max((r.confirmed_at, r.regime)) FROM reg r WHERE r.symbol = z.symbol AND r.confirmed_at <= z.touch_ts + 3600)[2] AS regime,
    EXISTS (SELECT 1 FROM pev s WHERE s.symbol = z.symbol AND s.kind = CASE WHEN z.long THEN 'LOW' ELSE 'HIGH' END AND z.touch_ts - s.swept_at BETWEEN 0 AND 36000) AS swept,
    EXISTS (SELECT 1 FROM brk b WHERE b.symbol = z.symbol AND b.event = 'CHOCH' AND z.touch_ts - b.market_time BETWEEN 0 AND 72000) AS choch,
    (SELECT v.vr FROM vol v WHERE v.symbol = z.symbol AND v.i = z.touch_i) AS touch_vr
  FROM zz z WHERE touch_i IS NOT NULL),
pl AS (SELECT *, {_PLAY.format(evidence="(swept OR choch OR coalesce(touch_vr >= 1.3, false))")} AS strategy FROM sn),
pf AS (
  SELECT p.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = p.symbol AND x.i BETWEEN p.touch_i AND p.touch_i + 3 AND (p.broken_i IS NULL OR x.i < p.broken_i)
    AND CASE WHEN p.long THEN x.low <= p.top AND x.close > p.top AND (x.high <= x.low OR x.close >= x.low + 0.66 * (x.high - x.low))
      ELSE x.high >= p.bottom AND x.close < p.bottom AND (x.high <= x.low OR x.close <= x.high - 0.66 * (x.high - x.low)) END) AS ci
  FROM pl p),
en AS (
  SELECT p.*, b.open_ts AS end_ts, least(touch_i + 3, last_i) AS end_i
  FROM pf p JOIN vol v ON v.symbol = p.symbol AND v.i = p.touch_i JOIN ba b ON b.symbol = p.symbol AND b.i = least(p.touch_i + 3, v.last_i) WHERE strategy IS NOT NULL AND ci IS NULL),
va AS (
  SELECT p.*, x.open_ts AS bar_ts, x.atr, x.high - x.low AS span, v.vr, v.next_open AS entry,
    CASE WHEN long THEN least(x.low, bottom) - 0.15 * x.atr ELSE greatest(x.high, top) + 0.15 * x.atr END AS sl
  FROM pf p JOIN ba x ON x.symbol = p.symbol AND x.i = p.ci JOIN vol v ON v.symbol = p.symbol AND v.i = p.ci WHERE strategy IS NOT NULL AND v.next_open IS NOT NULL),
vb AS (SELECT v.*, CASE WHEN long THEN entry - sl ELSE sl - entry END AS risk, {_target("v.symbol", "v.long", "v.entry", "v.bar_ts + 3600")} AS far FROM va v),
vc AS (SELECT *, CASE WHEN far IS NOT NULL THEN CASE WHEN long THEN least(far, entry + 3 * risk) ELSE greatest(far, entry - 3 * risk) END END AS tp FROM vb),
vd AS (SELECT *, round_even(CASE WHEN long THEN tp - entry ELSE entry - tp END / risk, 2) AS rr FROM vc),
ve AS (
  SELECT n.symbol AS venue_symbol, n.symbol || '|1H|' || strategy || '|' || zone_id || '|v1' AS setup_id, d.*,
    CASE WHEN atr IS NULL THEN 'ATR_UNAVAILABLE' WHEN risk <= 0 THEN 'INVALID_BRACKET' WHEN span < 0.15 * atr OR risk < 2 * 0.01 THEN 'VETOED'
      WHEN far IS NULL THEN 'NO_CAUSAL_TARGET' WHEN rr < 1.5 THEN 'RR_BELOW_MINIMUM' WHEN risk < 2 * {_COST} THEN 'UNECONOMIC_AFTER_COSTS' END AS refusal
  FROM vd d JOIN nm n ON n.base = d.symbol),
vf AS (
  SELECT e.venue_symbol AS symbol, e.setup_id, e.zone_id, e.strategy, e.long, e.regime, e.bar_ts, e.ci, e.broken_ts,
    coalesce(a.entry, e.entry) AS entry, coalesce(a.sl, e.sl) AS sl, coalesce(a.tp, e.tp) AS tp, a.setup_id IS NOT NULL AS inherited, a.units,
    CASE strategy2 WHEN 'PULLBACK' THEN 50 ELSE 40 END + CASE WHEN e.swept THEN 20 ELSE 0 END + CASE WHEN e.vr > 1.5 THEN 15 ELSE 0 END + CASE WHEN e.rr >= 2.5 THEN 15 ELSE 0 END AS rank
  FROM (SELECT *, strategy AS strategy2 FROM ve WHERE refusal IS NULL) e LEFT JOIN ar3 a ON a.setup_id = e.setup_id),
vg AS (SELECT *, abs(entry - sl) AS risk, round_even(CASE WHEN long THEN tp - entry ELSE entry - tp END / abs(entry - sl), 2) AS rr FROM vf),
st AS (
  SELECT venue_symbol AS symbol, setup_id, zone_id, 'FORMING' AS state, strategy, long, regime, bar_ts AS market_time, bar_ts + 3600 AS confirmed_at, entry, sl, tp, rr, 0 AS rank,
    NULL::DOUBLE AS maker_limit, NULL::VARCHAR AS reason, NULL::BOOLEAN AS inherited, units, NULL::BIGINT AS fill_i FROM ar3
  UNION ALL
  SELECT venue_symbol, setup_id, zone_id, 'CANCELLED', strategy, long, regime, broken_ts, broken_ts + 3600, entry, sl, tp, rr, 0, NULL, NULL, NULL, units, NULL FROM ar3
  WHERE broken_ts IS NOT NULL AND touch_i IS NULL
  UNION ALL
  SELECT n.symbol, n.symbol || '|1H|' || strategy || '|' || zone_id || '|v1', zone_id, 'CONFIRMING', strategy, long, regime, touch_ts, touch_ts + 3600, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL, NULL, NULL
  FROM pf p JOIN nm n ON n.base = p.symbol WHERE strategy IS NOT NULL
  UNION ALL
  SELECT n.symbol, n.symbol || '|1H|' || strategy || '|' || zone_id || '|v1', zone_id, 'CANCELLED', strategy, long, regime, end_ts, end_ts + 3600, NULL, NULL, NULL, NULL, 0, NULL,
    CASE WHEN broken_i <= end_i THEN 'ZONE_BROKE_UNCONFIRMED' ELSE 'CONFIRMATION_TIMEOUT' END, NULL, NULL, NULL
  FROM en p JOIN nm n ON n.base = p.symbol
  UNION ALL
  SELECT symbol, setup_id, zone_id, 'VALIDATED', strategy, long, regime, bar_ts, bar_ts + 3600, entry, sl, tp, rr, rank, CASE WHEN long THEN entry - 0.1 * risk ELSE entry + 0.1 * risk END, NULL, inherited, units, ci + 1 FROM vg
  UNION ALL
  SELECT symbol, setup_id, zone_id, 'EXPIRED', strategy, long, regime, broken_ts, broken_ts + 3600, entry, sl, tp, rr, rank, CASE WHEN long THEN entry - 0.1 * risk ELSE entry + 0.1 * risk END, NULL, inherited, units, ci + 1
  FROM vg WHERE broken_ts > bar_ts),
rj AS (
  SELECT n.symbol, zone_id, 'NO_ELIGIBLE_PLAYBOOK' AS reason, touch_ts AS market_time FROM pl p JOIN nm n ON n.base = p.symbol WHERE strategy IS NULL
  UNION ALL
  SELECT venue_symbol, zone_id, refusal, touch_ts FROM ve WHERE refusal IS NOT NULL)
"""


def _on_setups(final: str) -> str:
    return with_tables(_NAMES + _SETUPS + final, "zbr", "reg", "pev")


@query("active_targets", with_tables(f"""
, w AS (SELECT symbol, i, open_ts, close, long FROM ba, (VALUES (true), (false)) l(long))
SELECT symbol, i, long, {_target("w.symbol", "w.long", "w.close", "w.open_ts + 3600")} AS target FROM w""", "pev"))
def active_targets(spark, d):
    """The nearest active level above and below every close."""
    facts = structure_facts(spark, d)
    wanted = facts.bars.select(
        "symbol", "tf", "i", F.explode(F.array(F.lit(True), F.lit(False))).alias("long"), F.col("close").alias("price"), (F.col("open_ts") + 3600).alias("as_of")
    )
    return U.targets(wanted, facts).select("symbol", "i", "long", "target")


@query("setups", _on_setups("""
SELECT symbol, setup_id, zone_id, state, strategy, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction, regime, market_time, confirmed_at,
  round(entry, 6) AS entry, round(sl, 6) AS sl, round(tp, 6) AS tp, rr, rank, round(maker_limit, 6) AS maker_limit, reason, inherited, round(units, 6) AS units, fill_i FROM st"""))
def setups(spark, d):
    told, _ = setup_facts(spark, d)
    rounded = [F.round(c, 6).alias(c) for c in ("entry", "sl", "tp", "maker_limit", "units")]
    return told.select("symbol", "setup_id", "zone_id", "state", "strategy", "direction", "regime", "market_time", "confirmed_at", *rounded, "rr", "rank", "reason", "inherited", "fill_i")


@query("setup_rejections", _on_setups("SELECT symbol, zone_id, reason, market_time FROM rj"))
def setup_rejections(spark, d):
    _, refused = setup_facts(spark, d)
    return refused.select("symbol", "zone_id", "reason", "market_time")


@query("setup_funnel", _on_setups("""
SELECT symbol, state, coalesce(reason, '') AS reason, count(*) AS n, count(DISTINCT zone_id) AS zones FROM st GROUP BY ALL
UNION ALL
SELECT symbol, 'REJECTED', reason, count(*), count(DISTINCT zone_id) FROM rj GROUP BY ALL"""))
def setup_funnel(spark, d):
    """How many setups reached each state, and why the others did not."""
    told, refused = setup_facts(spark, d)
    every = told.select("symbol", "state", F.coalesce("reason", F.lit("")).alias("reason"), "zone_id").unionByName(
        refused.select("symbol", F.lit("REJECTED").alias("state"), "reason", "zone_id")
    )
    return every.groupBy("symbol", "state", "reason").agg(F.count("*").alias("n"), F.count_distinct("zone_id").alias("zones"))


_RETEST = """
, bq AS (
  SELECT b.symbol, b.market_time AS break_ts, x.i AS break_i, b.direction = 'BULL' AS long, b.level FROM brk b JOIN ba x ON x.symbol = b.symbol AND x.open_ts = b.market_time
  WHERE b.event = 'BOS' AND x.atr IS NOT NULL),
bh AS (
  SELECT q.*, x.i, x.open_ts, x.high, x.low, x.close, x.atr, CASE WHEN long THEN x.low <= level + 0.35 * x.atr ELSE x.high >= level - 0.35 * x.atr END AS reached,
    CASE WHEN long THEN x.low < level - 0.75 * x.atr ELSE x.high > level + 0.75 * x.atr END AS failed
  FROM bq q JOIN ba x ON x.symbol = q.symbol AND x.i BETWEEN q.break_i + 1 AND q.break_i + 12 AND x.atr IS NOT NULL),
bc AS (
  SELECT symbol, break_ts, min(i) FILTER (failed) AS failed_i,
    min(i) FILTER (reached AND NOT failed AND CASE WHEN long THEN low <= level + 0.01 AND close > level + 0.01 AND (high <= low OR close >= low + 0.66 * (high - low))
      ELSE high >= level - 0.01 AND close < level - 0.01 AND (high <= low OR close <= high - 0.66 * (high - low)) END) AS ci FROM bh GROUP BY symbol, break_ts),
bs AS (
  SELECT h.*, n.open AS entry, h.high - h.low AS span, CASE WHEN long THEN least(h.low, level) - 0.15 * h.atr ELSE greatest(h.high, level) + 0.15 * h.atr END AS sl
  FROM bc c JOIN bh h ON h.symbol = c.symbol AND h.break_ts = c.break_ts AND h.i = c.ci JOIN ba n ON n.symbol = c.symbol AND n.i = c.ci + 1 WHERE failed_i IS NULL OR ci < failed_i),
bt AS (
  SELECT *, CASE WHEN long THEN entry - sl ELSE sl - entry END AS risk,
    CASE WHEN long THEN (SELECT min(q.price) FROM sco q WHERE q.symbol = s.symbol AND q.kind = 'HIGH' AND q.confirmed_at <= s.open_ts + 3600 AND q.price > s.entry)
      ELSE (SELECT max(q.price) FROM sco q WHERE q.symbol = s.symbol AND q.kind = 'LOW' AND q.confirmed_at <= s.open_ts + 3600 AND q.price < s.entry) END AS far FROM bs s),
bu AS (SELECT *, CASE WHEN far IS NOT NULL THEN CASE WHEN long THEN least(far, entry + 3 * risk) ELSE greatest(far, entry - 3 * risk) END END AS tp FROM bt),
bv AS (SELECT *, round_even(CASE WHEN long THEN tp - entry ELSE entry - tp END / risk, 2) AS rr FROM bu)
"""


@query("breakout_retests", with_tables(_NAMES + _RETEST + f"""
SELECT n.symbol, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction, break_ts, level, open_ts AS market_time, open_ts + 3600 AS confirmed_at, round(entry, 6) AS entry, round(sl, 6) AS sl,
  round(tp, 6) AS tp, rr, round(CASE WHEN long THEN entry - 0.1 * risk ELSE entry + 0.1 * risk END, 6) AS maker_limit, i - break_i AS retest_bars,
  CASE WHEN risk <= 0 THEN 'INVALID_BRACKET' WHEN span < 0.15 * atr OR risk < 0.02 THEN 'VETOED' WHEN far IS NULL THEN 'NO_CAUSAL_TARGET' WHEN rr < 1.5 THEN 'RR_BELOW_MINIMUM'
    WHEN risk < 2 * {_COST} THEN 'UNECONOMIC_AFTER_COSTS' END AS reason, i + 1 AS fill_i
FROM bv JOIN nm n ON n.base = bv.symbol""", "brk"))
def breakout_retests(spark, d):
    told = U.breakout_retests(named_facts(spark, d))
    rounded = [F.round(c, 6).alias(c) for c in ("entry", "sl", "tp", "maker_limit")]
    return told.select("symbol", "direction", "break_ts", "level", "market_time", "confirmed_at", *rounded, "rr", "retest_bars", "reason", "fill_i")


@query("draft_brackets", with_tables(_NAMES + """
, lc AS (
  SELECT symbol, arg_max(close, i) AS price, arg_max(atr, i) FILTER (atr IS NOT NULL) AS atr FROM ba GROUP BY symbol),
lv AS (
  SELECT z.*, c.price, c.atr, n.symbol AS venue_symbol, z.zone_type = 'DEMAND' AS long, greatest(0, CASE z.zone_type WHEN 'DEMAND' THEN c.price - z.top ELSE z.bottom - c.price END) AS distance
  FROM zbr z JOIN lc c USING (symbol) JOIN nm n ON n.base = z.symbol
  WHERE z.broken_i IS NULL AND (z.zone_type = 'DEMAND' AND c.price >= z.bottom OR z.zone_type = 'SUPPLY' AND c.price <= z.top AND n.shorts)),
nz AS (SELECT * FROM lv WHERE distance <= 3 * atr QUALIFY row_number() OVER (PARTITION BY venue_symbol ORDER BY distance, confirmed_at, zone_id) = 1),
bk AS (SELECT *, CASE WHEN long THEN top ELSE bottom END AS entry, CASE WHEN long THEN bottom - 0.25 * atr ELSE top + 0.25 * atr END AS sl FROM nz),
am AS (
  SELECT b.*, (SELECT min((abs(p.level - b.entry), p.pool_id, p.level)) FROM pev p WHERE p.symbol = b.symbol AND p.broken_at IS NULL
    AND CASE WHEN b.long THEN p.kind = 'HIGH' AND p.level > b.entry ELSE p.kind = 'LOW' AND p.level < b.entry END) AS aim FROM bk b)
SELECT venue_symbol AS symbol, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction, zone_id, round(entry, 6) AS entry, round(sl, 6) AS sl,
  round(coalesce(aim[3], CASE WHEN long THEN entry + 2 * (entry - sl) ELSE entry - 2 * (sl - entry) END), 6) AS tp, aim[2] AS pool_id, round_even(distance / atr, 2) AS distance_atr FROM am""", "zbr", "pev"))
def draft_brackets(spark, d):
    """What a trade at the nearest live level would look like now, by venue."""
    told = U.draft_brackets(named_facts(spark, d), venue_value(F.col("symbol"), "shorts"))
    return told.select("symbol", "direction", "zone_id", *[F.round(c, 6).alias(c) for c in ("entry", "sl", "tp")], "pool_id", "distance_atr")
