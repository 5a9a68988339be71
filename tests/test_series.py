"""Recurrences in slices, and trades under managed exits, by definition."""

import numpy as np
import pytest


def test_recurrences_in_slices_equal_whole_series(spark):
    from barstrata.operators import series as S

    rng = np.random.default_rng(2)
    rows = []
    for symbol, n in (("A", 5000), ("B", 40), ("C", 1)):
        close = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
        rows += [(symbol, "1H", i, None if i == 0 else float(abs(close[i] - close[i - 1]) + 0.5), float(close[i])) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, tf string, i long, tr double, close double")
    got = S.with_recurrences(bars, size=300).orderBy("symbol", "i").toPandas()
    assert len(got) == len(rows) and S.with_recurrences(bars.where("i < 0")).count() == 0
    for _, part in got.groupby("symbol"):
        want = S._recur(part[["symbol", "tf", "i", "tr", "close"]].reset_index(drop=True))
        for name in S.RECURRENCES:
            np.testing.assert_allclose(part[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-11, atol=1e-11)


def by_hand(trade, bars, rules, hold):
    """One trade bar by bar: (outcome, bars held, partial's bar, exit in R), or None while open."""
    from barstrata.operators import managed as M

    _, _, _, direction, fill, entry, sl, tp = trade
    sign, risk = (1 if direction == "LONG" else -1), abs(entry - sl)
    stop, best, part = -1.0, 0.0, None
    for k, (_, _, _, high, low, close, _) in enumerate(bars[fill : fill + 100]):
        up, down, end = (sign * (x - entry) / risk for x in ((high, low, close) if sign > 0 else (low, high, close)))
        if rules.partial and part is None and up >= M.PARTIAL_R and down > stop and down >= 0:
            part, stop = k, 0.0
        best = max(best, up)
        if rules.trail and best >= M.EVEN_R:
            stop = max(stop, 0.0)
        if rules.trail and best >= M.TRAIL_R:
            stop = max(stop, best - M.TRAIL_DISTANCE)
        if down <= stop:
            return "SL", k, part
        if up >= sign * (tp - entry) / risk:
            return "TP", k, part
        if rules.time_stop and k >= hold and end > M.STAGNATION:
            return "TIME", k, part
    return ("TIMEOUT", 99, part) if not rules.time_stop and fill + 100 <= len(bars) else None


def test_managed_exits_by_definition(spark):
    from barstrata.operators import managed as M
    from barstrata.operators.execution import settle, walk_exits

    rng = np.random.default_rng(8)
    close = 200 + np.cumsum(rng.normal(0, 1, 900))
    bars = [("XUSDT", "1H", i, float(c + rng.exponential(0.7)), float(c - rng.exponential(0.7)), float(c), 1.0) for i, c in enumerate(close)]
    trades = []
    for n in range(300):
        fill, risk, sign = int(rng.integers(0, 900)), float(rng.uniform(0.5, 9)), int(rng.choice([-1, 1]))
        entry = float(close[max(fill - 1, 0)])
        trades.append(("XUSDT", "1H", f"t{n}", "LONG" if sign > 0 else "SHORT", fill, entry, entry - sign * risk, entry + sign * risk * float(rng.uniform(1, 4))))
    frame = spark.createDataFrame(bars, "symbol string, tf string, i long, high double, low double, close double, atr double")
    asked = spark.createDataFrame(trades, "symbol string, tf string, setup_id string, direction string, fill_i long, entry double, sl double, tp double")
    exits = M.managed_exits(asked, frame, 3600)
    got = {(r.setup_id, r.cell): r for r in exits.collect()}
    want = {(t[2], rules.cell): by_hand(t, bars, rules, M.HOLD_BARS["1H"]) for t in trades for rules in M.CELLS}
    want = {key: end for key, end in want.items() if end}
    assert got.keys() == want.keys()
    assert all((r.outcome, r.bars_held, r.partial) == (want[k][0], want[k][1], want[k][2] is not None) for k, r in got.items())
    assert {end[0] for end in want.values()} == {"SL", "TP", "TIME", "TIMEOUT"} and sum(r.partial for r in got.values()) > 30
    # Trades that are merely held end and settle as in the book.
    plain = {r.setup_id: (r.outcome, r.bars_held, r.r_multiple) for r in settle(walk_exits(asked, frame), 3600).collect()}
    assert plain == {k[0]: (r.outcome, r.bars_held, pytest.approx(r.r)) for k, r in got.items() if k[1] == "HOLD"}
    rows = {r.cell: r for r in M.compared(exits).collect()}
    assert rows["HOLD"].mean_gain == 0 and rows["HOLD"].n == len(plain) and rows["TRAIL"].better > 0 < rows["TRAIL"].worse
    assert M.managed_exits(asked.where("false"), frame, 3600).count() == 0


def test_one_listing_an_underlying_and_thin_rankings_refused(spark):
    from barstrata.operators import venues as V

    rows = [
        ("BTC-USD", 0, 900.0), ("BTCUSDT", 0, 50.0), ("PF_XBTUSD", 0, 70.0), ("ETH-USD", 0, 80.0), ("XYZ", 0, 1e9),
        ("BTC-USD", 100, 900.0), ("PF_XBTUSD", 100, 10.0), ("ETH-USD", 100, 30.0), ("ETHUSDT", 100, None),
        ("BTC-USD", 200, 5.0), ("BTCUSDT", 200, 50.0), ("PF_XBTUSD", 200, 70.0), ("ETH-USD", 200, 80.0), ("ETHUSDT", 200, 1.0), ("XYZ", 200, 1.0),
    ]
    listings = spark.createDataFrame(rows, "symbol string, look long, volume double")
    best = {(r.look, r.base): (r.symbol, r.volume) for r in V.one_per_base(listings).collect()}
    assert best[0, "BTC"] == ("PF_XBTUSD", 70.0) and best[100, "ETH"] == ("ETH-USD", 30.0) and best[200, "ETH"] == ("ETHUSDT", 1.0) and len(best) == 6
    looks = {r.look: r for r in V.refreshes(listings, 100, 0.9).collect()}
    assert [(looks[t].listed, looks[t].answered, looks[t].taken, looks[t].standing) for t in (0, 100, 200)] == [(5, 5, True, 0), (6, 3, False, 0), (6, 6, True, 200)]
    told = {(r.look, r.symbol): (r.rank, r.state, r.reason) for r in V.members(listings, ["ETH-USD", "BTC-USD"], 1, 40.0, 2).collect()}
    assert told == {
        (0, "ETH-USD"): (1, "WARMING", "insufficient_history"), (0, "BTC-USD"): (None, "WARMING", "seed_anchor"), (0, "PF_XBTUSD"): (None, "SHADOW", "warming_for_venue_switch"),
        (100, "BTC-USD"): (1, "ADMITTED", "liquid_and_warm"), (100, "ETH-USD"): (None, "ADMITTED", "seed_anchor"),
        (200, "BTCUSDT"): (1, "ADMITTED", "liquid_and_warm"), (200, "ETH-USD"): (None, "ADMITTED", "seed_anchor"), (200, "PF_XBTUSD"): (None, "SHADOW", "warming_for_venue_switch"),
    }
