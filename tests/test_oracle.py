"""Every registered query against its DuckDB oracle on sf0.001 (the driver
repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import duck_con, rows_multiset

from tests.conftest import SF_SMALL

NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, df.collect()
    oracle = E.oracle_sql().get(name)
    if oracle is None:
        assert len(s_rows) > 0
        return
    cur = con.execute(oracle)
    o_cols = [c[0] for c in cur.description]
    o_rows = cur.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert rows_multiset(s_cols, s_rows) == rows_multiset(o_cols, o_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["users", "products", "services", "open_requests", "mock_revenue_cents"]
    assert df.count() == 1


def test_time_zone_does_not_change_results(spark, con):
    """Durations and 'now' literals are wall-clock: a non-UTC session zone
    (with DST) gives the same answers."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("attempt_limiter", "active_sessions", "mark_read", "attempt_limiter_stream"):
            df = E.queries()[name](spark, SF_SMALL)
            s_cols, s_rows = df.columns, df.collect()
            cur = con.execute(E.oracle_sql()[name])
            o_cols = [c[0] for c in cur.description]
            assert rows_multiset(s_cols, s_rows) == rows_multiset(o_cols, cur.fetchall()), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
