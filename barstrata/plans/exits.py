"""Queries of managed exits: the book's trades held, taken in part, trailed and stopped in time."""

from __future__ import annotations

from ..operators import managed as M
from .catalog import query
from .decisions import _bars, _on_book, plans

# Bar by bar over all open trades: what each rule does to the stop, and what ends the trade.
_MANAGED = f"""
, cl(cell, pt, tr, tm) AS (VALUES ('HOLD', false, false, false), ('PARTIAL', true, false, false), ('TRAIL', false, true, false), ('TIME_STOP', false, false, true), ('MANAGED', true, true, true)),
hr AS (
  SELECT p.setup_id, x.i - fill_i AS k, x.atr, sg * (CASE direction WHEN 'LONG' THEN x.high ELSE x.low END - p.entry) / risk AS up,
    sg * (CASE direction WHEN 'LONG' THEN x.low ELSE x.high END - p.entry) / risk AS down, sg * (x.close - p.entry) / risk AS fin, sg * (p.tp - p.entry) / risk AS tp_r
  FROM (SELECT *, CASE direction WHEN 'LONG' THEN 1.0 ELSE -1.0 END AS sg FROM p) p JOIN ba x ON x.symbol = p.s AND x.i >= p.fill_i AND x.i < p.fill_i + 100),
wk AS (
  SELECT setup_id, cell, pt, tr, tm, -1::BIGINT AS k, -1.0::DOUBLE AS stop, 0.0::DOUBLE AS best, NULL::BIGINT AS part, NULL::VARCHAR AS outcome, NULL::DOUBLE AS exit_r, NULL::DOUBLE AS atr FROM p, cl
  UNION ALL
  SELECT setup_id, cell, pt, tr, tm, k, stop, best, part,
    CASE WHEN down <= stop THEN 'SL' WHEN up >= tp_r THEN 'TP' WHEN tm AND k >= {M.HOLD_BARS['1H']} AND fin > {M.STAGNATION} THEN 'TIME' WHEN NOT tm AND k = 99 THEN 'TIMEOUT' END,
    CASE WHEN down <= stop THEN stop WHEN up >= tp_r THEN tp_r ELSE fin END, atr
  FROM (
    SELECT *, CASE WHEN tr AND best >= {M.TRAIL_R} THEN greatest(s2, best - {M.TRAIL_DISTANCE}) ELSE s2 END AS stop
    FROM (
      SELECT *, CASE WHEN tr AND s1 < 0 AND up >= {M.EVEN_R} THEN 0.0 ELSE s1 END AS s2
      FROM (
        SELECT w.setup_id, cell, pt, tr, tm, h.k, h.up, h.down, h.fin, h.tp_r, h.atr, greatest(w.best, h.up) AS best,
          CASE WHEN pt AND part IS NULL AND h.up >= {M.PARTIAL_R} AND h.down > w.stop AND h.down >= 0 THEN h.k ELSE part END AS part,
          CASE WHEN pt AND part IS NULL AND h.up >= {M.PARTIAL_R} AND h.down > w.stop AND h.down >= 0 THEN 0.0 ELSE w.stop END AS s1
        FROM wk w JOIN hr h ON h.setup_id = w.setup_id AND h.k = w.k + 1 WHERE w.outcome IS NULL)))),
lg AS (
  SELECT setup_id, cell, outcome, k, part, atr, CASE WHEN part IS NULL THEN 1.0 ELSE {M.PARTIAL_SHARE} END AS share, outcome <> 'TP' AS market, exit_r AS at_r, k AS held FROM wk WHERE outcome IS NOT NULL
  UNION ALL SELECT setup_id, cell, outcome, k, part, atr, {M.PARTIAL_SHARE}, false, {M.PARTIAL_R}, part FROM wk WHERE outcome IS NOT NULL AND part IS NOT NULL),
lp AS (SELECT lg.*, p.symbol, entry, risk, CASE direction WHEN 'LONG' THEN 1.0 ELSE -1.0 END AS sg FROM lg JOIN p USING (setup_id)),
le AS (SELECT *, entry + sg * at_r * risk - CASE WHEN market THEN sg * 0.05 * atr ELSE 0 END AS eff FROM lp),
mx AS (
  SELECT symbol, setup_id, cell, any_value(outcome) AS outcome, any_value(k) AS bars_held, any_value(part) IS NOT NULL AS partial,
    round(sum(share * round_even((sg * (eff - entry) - (6e-4 * entry + CASE WHEN market THEN 6e-4 ELSE 1e-4 END * eff) - 1e-4 * held / 8 * entry) / risk, 2)), 4) AS r
  FROM le GROUP BY symbol, setup_id, cell)"""


@query("managed_exits", _on_book(_MANAGED + " SELECT setup_id, cell, outcome, bars_held, partial, r FROM mx"))
def managed_exits(spark, d):
    bars = _bars(spark, d)
    return M.managed_exits(plans(bars), bars, 3600).drop("symbol", "tf")


@query("exit_cells", _on_book(_MANAGED + """,
gn AS (SELECT mx.*, mx.r - b.r AS gain FROM mx LEFT JOIN (SELECT setup_id, r FROM mx WHERE cell = 'HOLD') b USING (setup_id))
SELECT cell, count(*) AS n, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate,
  CASE WHEN sum(r) FILTER (r < 0) < 0 THEN round(sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0), 6) END AS profit_factor, round(avg(gain), 6) AS mean_gain,
  count(*) FILTER (round(gain, 6) > 0) AS better, count(*) FILTER (round(gain, 6) < 0) AS worse
FROM gn GROUP BY cell"""))
def exit_cells(spark, d):
    """Each cell against the trades held to stop, target or timeout."""
    bars = _bars(spark, d)
    return M.compared(M.managed_exits(plans(bars), bars, 3600))
