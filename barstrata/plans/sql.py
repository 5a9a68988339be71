"""Common table expressions of the oracles, composed by name with what they need."""

from __future__ import annotations

_CTES = {
    "t": ((), """t AS (
  SELECT event_type AS symbol, floor(epoch(ts) / 3600)::BIGINT * 3600 AS open_ts, ts, round(value, 2) AS price
  FROM events WHERE value IS NOT NULL)"""),
    "raw": (("t",), """raw AS (
  SELECT symbol, open_ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, ts) AS close, count(*)::DOUBLE AS volume
  FROM t GROUP BY symbol, open_ts)"""),
    "c": (("raw",), """c AS (
  SELECT * FROM raw WHERE high >= greatest(open, close, low) AND low <= least(open, close) AND low > 0)"""),
    "b": (("c",), """b AS (
  SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
  FROM (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc FROM c WINDOW w AS (PARTITION BY symbol ORDER BY open_ts)))"""),
    "atr": (("b",), """atr AS (
  SELECT symbol, 14::BIGINT AS i, sum(tr) / 14 AS atr FROM b WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL
  SELECT b.symbol, b.i, (a.atr * 13 + b.tr) / 14 FROM atr a JOIN b ON b.symbol = a.symbol AND b.i = a.i + 1)"""),
    "ba": (("b", "atr"), """ba AS (
  SELECT b.*, atr, greatest(0.01, 0.05 * atr) AS tol FROM b LEFT JOIN atr USING (symbol, i))"""),
    "mic": (("ba",), """mic AS (
  SELECT symbol, open_ts AS market_time, known AS confirmed_at, kind, CASE kind WHEN 'HIGH' THEN high ELSE low END AS price, i, atr
  FROM (
    SELECT *, lead(open_ts, 2) OVER w + 3600 AS known,
      high > lag(high, 1) OVER w AND high > lag(high, 2) OVER w AND high > lead(high, 1) OVER w AND high > lead(high, 2) OVER w AS top,
      low < lag(low, 1) OVER w AND low < lag(low, 2) OVER w AND low < lead(low, 1) OVER w AND low < lead(low, 2) OVER w AS bottom
    FROM ba WINDOW w AS (PARTITION BY symbol ORDER BY open_ts)
  ), (VALUES ('HIGH'), ('LOW')) k(kind)
  WHERE (kind = 'HIGH' AND top) OR (kind = 'LOW' AND bottom))"""),
    "loc": (("mic",), """loc AS (
  SELECT symbol, market_time, opp_known AS confirmed_at, kind, price, i, atr
  FROM (
    SELECT m.*, (SELECT arg_min(o.price, o.market_time) FROM mic o WHERE o.symbol = m.symbol AND o.kind <> m.kind AND (o.market_time, o.kind) > (m.market_time, m.kind)) AS opp,
      (SELECT arg_min(o.confirmed_at, o.market_time) FROM mic o WHERE o.symbol = m.symbol AND o.kind <> m.kind AND (o.market_time, o.kind) > (m.market_time, m.kind)) AS opp_known
    FROM mic m)
  WHERE atr IS NOT NULL AND abs(price - opp) >= round(0.75 * atr, 8))"""),
    "alt": (("loc",), """alt AS (
  SELECT symbol, kind, arg_max(market_time, (CASE WHEN kind = 'HIGH' THEN price ELSE -price END, -market_time)) AS market_time,
    max(confirmed_at) AS confirmed_at, CASE WHEN kind = 'HIGH' THEN max(price) ELSE min(price) END AS price,
    arg_max(i, (CASE WHEN kind = 'HIGH' THEN price ELSE -price END, -market_time)) AS i,
    arg_max(atr, (CASE WHEN kind = 'HIGH' THEN price ELSE -price END, -market_time)) AS atr
  FROM (
    SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY market_time, kind) AS run
    FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY symbol ORDER BY market_time, kind) = kind THEN 0 ELSE 1 END AS turn FROM loc))
  GROUP BY symbol, run, kind)"""),
    "pro": (("alt",), """pro AS (
  SELECT symbol, market_time, kind, price, i, atr, greatest(confirmed_at, k1, k2) AS confirmed_at, nxt AS next_opposite,
    least(abs(price - l) / l, abs(price - r) / r) AS margin
  FROM (
    SELECT *, lag(price, 2) OVER w AS l, lead(price, 2) OVER w AS r, lead(price) OVER w AS nxt, lead(confirmed_at) OVER w AS k1, lead(confirmed_at, 2) OVER w AS k2
    FROM alt WINDOW w AS (PARTITION BY symbol ORDER BY market_time, kind))
  WHERE CASE WHEN kind = 'HIGH' THEN price > l AND price > r ELSE price < l AND price < r END)"""),
    "sco": (("pro", "ba"), """alt2 AS (
  SELECT symbol, kind, arg_max(market_time, (CASE WHEN kind = 'HIGH' THEN price ELSE -price END, -market_time)) AS market_time,
    CASE WHEN kind = 'HIGH' THEN max(price) ELSE min(price) END AS price
  FROM (
    SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY market_time, kind) AS run
    FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY symbol ORDER BY market_time, kind) = kind THEN 0 ELSE 1 END AS turn FROM pro))
  GROUP BY symbol, run, kind),
maj AS (
  SELECT symbol, market_time, kind, nxt AS o2, least(abs(price - l) / l, abs(price - r) / r) AS m2
  FROM (
    SELECT *, lag(price, 2) OVER w AS l, lead(price, 2) OVER w AS r, lead(price) OVER w AS nxt
    FROM alt2 WINDOW w AS (PARTITION BY symbol ORDER BY market_time, kind))
  WHERE CASE WHEN kind = 'HIGH' THEN price > l AND price > r ELSE price < l AND price < r END),
hld0 AS (
  SELECT p.*, m.o2, m.m2, m.kind IS NOT NULL AS dominant,
    (SELECT min(x.i) FROM ba x WHERE x.symbol = p.symbol AND x.i BETWEEN p.i + 1 AND p.i + 90 AND CASE p.kind WHEN 'HIGH' THEN x.high > p.price ELSE x.low < p.price END) - p.i AS first_beyond,
    (SELECT avg(x.volume) FROM ba x WHERE x.symbol = p.symbol AND x.i BETWEEN p.i - 20 AND p.i - 1) AS avg_volume
  FROM pro p LEFT JOIN maj m ON m.symbol = p.symbol AND m.market_time = p.market_time AND m.kind = p.kind),
hld AS (
  SELECT h.*, coalesce(first_beyond, 90) AS held, c.open_ts + 3600 AS closed, own.volume / avg_volume AS vol_ratio,
    lag(h.price) OVER (PARTITION BY h.symbol, h.kind ORDER BY h.market_time) AS prev
  FROM hld0 h JOIN ba c ON c.symbol = h.symbol AND c.i = h.i + coalesce(first_beyond, 90) JOIN ba own ON own.symbol = h.symbol AND own.i = h.i),
prt AS (
  SELECT *,
    round(least(round(coalesce(m2, margin) * 100, 2) / 100 / 0.05, 1.0) * 18, 2) AS p_margin,
    round(least(coalesce(round(abs(price - coalesce(o2, next_opposite)) / atr, 2), 0.0) / 15.0, 1.0) * 24, 2) AS p_reversal,
    round(least(held / 90.0, 1.0) * 14, 2) AS p_held,
    round(least(log2(round(coalesce(CASE WHEN i >= 20 THEN vol_ratio END, 1.0), 2) + 1) / log2(7.0), 1.0) * 12, 2) AS p_volume,
    CASE WHEN CASE kind WHEN 'HIGH' THEN price > prev ELSE price < prev END THEN 4.0::DOUBLE ELSE 0.0 END AS p_liquidity,
    CASE WHEN dominant THEN 12.0::DOUBLE ELSE 0.0 END AS p_dominance
  FROM hld),
sco AS (
  SELECT *, CASE WHEN score >= 55 THEN 'MAJOR' ELSE 'INTERMEDIATE' END AS tier FROM (
    SELECT symbol, market_time, greatest(confirmed_at, closed) AS confirmed_at, kind, price, i, atr, held, p_margin, p_reversal, p_held, p_volume, p_liquidity, p_dominance,
      round(p_margin + p_reversal + p_held + p_volume + p_liquidity + p_dominance, 2) AS score FROM prt)
  WHERE score >= 30)"""),
    "zon": (("sco",), """zon0 AS (
  SELECT *, CASE WHEN kind = 'HIGH' THEN 'SUPPLY' ELSE 'DEMAND' END AS zone_type,
    CASE WHEN kind = 'HIGH' THEN price - 0.25 * atr ELSE price END AS bottom,
    CASE WHEN kind = 'HIGH' THEN price ELSE price + 0.25 * atr END AS top
  FROM sco WHERE atr IS NOT NULL),
zon AS (
  SELECT symbol, symbol || '|1H|' || zone_type || '|' || market_time AS zone_id, zone_type, market_time, confirmed_at, bottom, top, i,
    (SELECT count(*) FROM zon0 o WHERE o.symbol = z.symbol AND o.kind = z.kind AND o.market_time <> z.market_time
      AND o.price BETWEEN z.bottom AND z.top AND o.confirmed_at <= z.confirmed_at) AS cluster
  FROM zon0 z)"""),
    "zbr": (("zon", "ba"), """zbr AS (
  SELECT z.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = z.symbol AND x.i > z.i AND x.open_ts + 3600 > z.confirmed_at
      AND CASE WHEN z.zone_type = 'DEMAND' THEN x.close + coalesce(x.tol, 0.01) < z.bottom ELSE x.close - coalesce(x.tol, 0.01) > z.top END) AS broken_i
  FROM zon z)"""),
    "lab": (("sco",), """lab AS (
  SELECT symbol, market_time, confirmed_at, kind, price,
    CASE WHEN prev IS NULL THEN NULL WHEN kind = 'HIGH' THEN CASE WHEN price > prev THEN 'HH' ELSE 'LH' END
      ELSE CASE WHEN price > prev THEN 'HL' ELSE 'LL' END END AS label
  FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY market_time) AS prev FROM sco WHERE tier = 'INTERMEDIATE'))"""),
    "brk": (("sco", "ba"), """act AS (
  SELECT b.symbol, b.i, b.open_ts, b.close, coalesce(b.tol, 0.01) AS tol,
    (SELECT max((s.market_time, s.price)) FROM sco s WHERE s.symbol = b.symbol AND s.tier = 'INTERMEDIATE' AND s.kind = 'HIGH' AND s.confirmed_at <= b.open_ts + 3600) AS h,
    (SELECT max((s.market_time, s.price)) FROM sco s WHERE s.symbol = b.symbol AND s.tier = 'INTERMEDIATE' AND s.kind = 'LOW' AND s.confirmed_at <= b.open_ts + 3600) AS l
  FROM ba b),
ac2 AS (
  SELECT *, h[1] AS h_ts, h[2] AS h_price, l[1] AS l_ts, l[2] AS l_price, close > h[2] + tol AS up, close < l[2] - tol AS down FROM act),
wlk AS (
  SELECT symbol, -1::BIGINT AS i, -1::BIGINT AS high_from, -1::BIGINT AS low_from, 'NEUTRAL' AS direction, NULL::BIGINT AS h_ts, NULL::BIGINT AS l_ts,
    'NEUTRAL' AS was, NULL::BIGINT AS open_ts, NULL::DOUBLE AS h_price, NULL::DOUBLE AS l_price
  FROM (SELECT DISTINCT symbol FROM ba)
  UNION ALL
  SELECT symbol, i, CASE WHEN hb THEN open_ts ELSE high_from END, CASE WHEN lb THEN open_ts ELSE low_from END,
    CASE WHEN lb THEN 'BEAR' WHEN hb THEN 'BULL' ELSE direction END, CASE WHEN hb THEN h_ts END, CASE WHEN lb THEN l_ts END, direction, open_ts, h_price, l_price
  FROM (
    SELECT a.*, w.high_from, w.low_from, w.direction, coalesce(a.up AND a.h_ts > w.high_from, false) AS hb, coalesce(a.down AND a.l_ts > w.low_from, false) AS lb
    FROM wlk w JOIN ac2 a ON a.symbol = w.symbol AND a.i = w.i + 1)),
brk AS (
  SELECT symbol, open_ts AS market_time, open_ts + 3600 AS confirmed_at, CASE WHEN was IN ('NEUTRAL', 'BULL') THEN 'BOS' ELSE 'CHOCH' END AS event,
    'BULL' AS direction, h_price AS level, h_ts AS level_swing_ts FROM wlk WHERE h_ts IS NOT NULL
  UNION ALL
  SELECT symbol, open_ts, open_ts + 3600, CASE WHEN h_ts IS NOT NULL OR was = 'BULL' THEN 'CHOCH' ELSE 'BOS' END, 'BEAR', l_price, l_ts FROM wlk WHERE l_ts IS NOT NULL)"""),
    "reg": (("lab", "brk"), """fct AS (
  SELECT symbol, market_time, confirmed_at, 0 AS what, kind, NULL::VARCHAR AS direction, NULL::VARCHAR AS event, label FROM lab WHERE label IS NOT NULL
  UNION ALL
  SELECT symbol, market_time, confirmed_at, 1, NULL, direction, event, NULL FROM brk),
fo AS (
  SELECT *, last_value(event IGNORE NULLS) OVER w AS e, last_value(direction IGNORE NULLS) OVER w AS d,
    last_value(CASE WHEN kind = 'HIGH' THEN label END IGNORE NULLS) OVER w AS hl, last_value(CASE WHEN kind = 'LOW' THEN label END IGNORE NULLS) OVER w AS ll
  FROM fct WINDOW w AS (PARTITION BY symbol ORDER BY confirmed_at, market_time, what, kind NULLS FIRST, direction NULLS FIRST ROWS UNBOUNDED PRECEDING)),
rg0 AS (
  SELECT *, CASE WHEN e IS NULL THEN 'RANGE' WHEN e = 'CHOCH' THEN 'TRANSITION'
    WHEN d = 'BULL' AND hl = 'HH' AND ll = 'HL' THEN 'BULL_TREND' WHEN d = 'BULL' AND (hl = 'HH' OR ll = 'HL') THEN 'WEAKENING_BULL'
    WHEN d = 'BEAR' AND hl = 'LH' AND ll = 'LL' THEN 'BEAR_TREND' WHEN d = 'BEAR' AND (hl = 'LH' OR ll = 'LL') THEN 'WEAKENING_BEAR' ELSE 'RANGE' END AS regime
  FROM fo),
reg AS (
  SELECT * FROM rg0 QUALIFY regime IS DISTINCT FROM
    lag(regime) OVER (PARTITION BY symbol ORDER BY confirmed_at, market_time, what, kind NULLS FIRST, direction NULLS FIRST))"""),
    "poo": (("sco", "ba"), """pvt AS (
  SELECT symbol, kind, market_time, confirmed_at, price, i, row_number() OVER (PARTITION BY symbol, kind ORDER BY market_time) AS n,
    (SELECT list(o.market_time) FROM sco o WHERE o.symbol = s.symbol AND o.kind = s.kind AND o.market_time < s.market_time
      AND s.market_time - o.market_time <= 100 * 3600 AND abs(o.price - s.price) <= 0.10 * s.atr) AS near,
    (SELECT CASE s.kind WHEN 'HIGH' THEN max(o.price) ELSE min(o.price) END FROM sco o WHERE o.symbol = s.symbol AND o.kind = s.kind AND o.market_time <= s.market_time
      AND s.market_time - o.market_time <= 100 * 3600 AND abs(o.price - s.price) <= 0.10 * s.atr) AS level
  FROM sco s),
clm AS (
  SELECT symbol, kind, 0::BIGINT AS n, []::BIGINT[] AS claimed, false AS made FROM (SELECT DISTINCT symbol, kind FROM pvt)
  UNION ALL
  SELECT symbol, kind, n, CASE WHEN made THEN list_concat(claimed, list_append(near, market_time)) ELSE claimed END, made
  FROM (
    SELECT p.symbol, p.kind, p.n, p.near, p.market_time, c.claimed, coalesce(len(p.near) > 0 AND NOT list_has_any(p.near, c.claimed), false) AS made
    FROM clm c JOIN pvt p ON p.symbol = c.symbol AND p.kind = c.kind AND p.n = c.n + 1)),
poo AS (
  SELECT p.symbol, p.symbol || '|1H|EQ' || left(p.kind, 1) || '|' || p.market_time AS pool_id, p.kind, p.market_time, p.confirmed_at, p.level,
    len(p.near) + 1 AS n_members, p.i
  FROM clm c JOIN pvt p ON p.symbol = c.symbol AND p.kind = c.kind AND p.n = c.n WHERE c.made)"""),
    "pev": (("poo",), """pbr AS (
  SELECT p.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = p.symbol AND x.i > p.i AND x.open_ts + 3600 > p.confirmed_at
    AND CASE p.kind WHEN 'HIGH' THEN x.close - coalesce(x.tol, 0.01) > p.level ELSE x.close + coalesce(x.tol, 0.01) < p.level END) AS broken_i
  FROM poo p),
psw AS (
  SELECT p.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = p.symbol AND x.i > p.i AND x.open_ts + 3600 > p.confirmed_at AND (p.broken_i IS NULL OR x.i < p.broken_i)
    AND CASE p.kind WHEN 'HIGH' THEN x.high > p.level AND x.close <= p.level ELSE x.low < p.level AND x.close >= p.level END) AS swept_i
  FROM pbr p),
pev AS (
  SELECT p.*, b.open_ts AS broken_at, s.open_ts AS swept_at
  FROM psw p LEFT JOIN ba b ON b.symbol = p.symbol AND b.i = p.broken_i LEFT JOIN ba s ON s.symbol = p.symbol AND s.i = p.swept_i)"""),
    "gap": (("ba",), """gap AS (
  SELECT *, CASE direction WHEN 'BULL' THEN h2 ELSE high END AS bottom, CASE direction WHEN 'BULL' THEN low ELSE l2 END AS top
  FROM (
    SELECT *, CASE WHEN low > h2 THEN 'BULL' WHEN l2 > high THEN 'BEAR' END AS direction
    FROM (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM ba WINDOW w AS (PARTITION BY symbol ORDER BY open_ts)))
  WHERE direction IS NOT NULL AND atr IS NOT NULL)"""),
}


def _need(name: str, seen: list[str]) -> None:
    for other in _CTES[name][0]:
        _need(other, seen)
    if name not in seen:
        seen.append(name)


def with_tables(final: str, *names: str) -> str:
    """``final`` after the CTEs ``names`` and all that they read."""
    seen: list[str] = []
    for name in names:
        _need(name, seen)
    return "WITH RECURSIVE " + ",\n".join(_CTES[n][1] for n in seen) + "\n" + final


def ema_cte(name: str, period: int, source: str = "b", value: str = "close", first: int = 0) -> str:
    """A recursive table (symbol, i, v): an EMA seeded with a mean, from bar ``first`` on."""
    at = first + period - 1
    return f"""{name} AS (
  SELECT symbol, {at}::BIGINT AS i, sum({value}) / {period} AS v FROM {source} WHERE i BETWEEN {first} AND {at} GROUP BY symbol HAVING count(*) = {period}
  UNION ALL
  SELECT x.symbol, x.i, e.v + 2.0 / {period + 1} * (x.{value} - e.v) FROM {name} e JOIN {source} x ON x.symbol = e.symbol AND x.i = e.i + 1)"""
