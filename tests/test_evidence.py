"""Bootstrap intervals and factor evidence by plain loops over the book's trades."""

import math
import statistics

import pytest

#: The fixed generator: multiplier, increment, seed.
A, C, SEED = 6364136223846793005, 1442695040888963407, 0x2545F4914F6CDD1D


def test_bootstrap_intervals_by_definition(spark, sf_dir):
    from barstrata.plans.decisions import book, bootstrap_ci

    trades = {}
    for r in book(spark, sf_dir).select("symbol", "exit_ts", "setup_id", "r_multiple").collect():
        trades.setdefault(r.symbol, []).append((r.exit_ts, r.setup_id, r.r_multiple))
    got = {r.symbol: r for r in bootstrap_ci(spark, sf_dir).collect()}
    assert set(got) == set(trades) and any(len(t) >= 10 for t in trades.values())
    for symbol, rows in trades.items():
        values, n = [r for *_, r in sorted(rows)], len(rows)
        assert got[symbol].n == n
        if n < 10:
            assert got[symbol].ci_lo is None or math.isnan(got[symbol].ci_lo)
            continue
        state, means = SEED, []
        for _ in range(2000):
            total = 0.0
            for _ in range(n):
                state = (state * A + C) % 2**64
                total += values[(state >> 33) % n]
            means.append(total / n)
        means.sort()
        want = (means[50], means[1950], sum(m > 0 for m in means) / 2000)
        assert (got[symbol].ci_lo, got[symbol].ci_hi, got[symbol].p_gt_zero) == pytest.approx(want)


def test_factor_evidence_by_definition(spark, sf_dir):
    from barstrata.plans.decisions import _factors, book, evidence_bh

    rows = {}
    for r in _factors(book(spark, sf_dir)).collect():
        if r.x is not None:
            rows.setdefault(r.factor, []).append((r.exit_ts, r.setup_id, r.x, r.r))
    told, threshold = {}, {}
    for factor, found in rows.items():
        found.sort()
        n = len(found)
        train = sorted((x, s) for _, s, x, _ in found[: math.floor(n * 0.6)])
        threshold[factor] = train[len(train) // 2][0]
        for part, some in (("TRAIN", found[: math.floor(n * 0.6)]), ("VALIDATE", found[math.floor(n * 0.6) : math.floor(n * 0.8)]), ("FORWARD", found[math.floor(n * 0.8) :])):
            high, low = ([r for *_, x, r in some if (x >= threshold[factor]) == side] for side in (True, False))
            told[factor, part] = (high, low, len(some))
    tests = {}
    for key, (high, low, n) in told.items():
        uplift = statistics.fmean(high) - statistics.fmean(low) if high and low else None
        spread = len(high) > 1 and len(low) > 1
        se = math.sqrt(statistics.variance(high) / len(high) + statistics.variance(low) / len(low)) if spread else None
        p = math.erfc(abs(uplift) / se / math.sqrt(2)) if uplift is not None and se else None
        tests[key] = (uplift, se, n, p)
    got = {(r.factor, r.part): r for r in evidence_bh(spark, sf_dir).collect()}
    assert set(got) == set(tests)
    for part in ("TRAIN", "VALIDATE", "FORWARD"):
        ranked = sorted((k for k in tests if k[1] == part), key=lambda k: (tests[k][3] is not None, tests[k][3] or 0.0, k[0]))
        least = 1.0
        for rank in range(len(ranked), 0, -1):
            key = ranked[rank - 1]
            uplift, se, n, p = tests[key]
            r = got[key]
            assert (r["rank"], r.n) == (rank, n)
            if p is None:
                continue
            least = min(least, p * len(ranked) / rank)
            assert (r.uplift, r.se, r.p, r.q, r.shrunk) == pytest.approx((uplift, se, p, least, uplift * n / (n + 30)), rel=1e-5, abs=1e-6)
