"""Queries over the book against their SQL where no price gap makes a trade."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barstrata.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """Bars that all span the same prices, so that there are no gaps and no trades."""
    path, start = tmp_path_factory.mktemp("dense"), datetime.datetime(2024, 1, 1)
    ticks = [(start + datetime.timedelta(hours=h, minutes=10 * k), s, 10.0 + 5 * (k % 3)) for h in range(60) for k in range(6) for s in ("a", "b")]
    pq.write_table(pa.table({
        "event_id": pa.array(range(len(ticks)), pa.int64()), "ts": pa.array([t[0] for t in ticks], pa.timestamp("us")),
        "event_type": [t[1] for t in ticks], "value": [t[2] for t in ticks],
    }), path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["factor_clusters", "breakeven_fee", "performance_cuts"])
def test_no_trades_as_in_sql(spark, dense, name):
    ours = QUERIES[name](spark, dense)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{dense}/events.parquet'")
    theirs = con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert [tuple(r) for r in ours.select(*columns).collect()] == theirs.fetchall()
