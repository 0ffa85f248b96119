"""Property test: both limiter paths equal a plain sequential fold."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mercato.operators.limiter import attempt_limiter

T = dt.datetime(2024, 1, 1)


def brute(rows, limit, refill):
    out = {}
    for key in {r[0] for r in rows}:
        tokens = anchor = None
        for _, rid, ts in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            s = (ts - T).total_seconds()
            if anchor is None or s - anchor > refill:
                tokens, anchor = limit, s
            out[rid] = tokens > 0
            if tokens > 0:
                tokens -= 1
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(gaps=st.lists(st.lists(st.sampled_from([0, 1, 3, 9, 10, 11, 25, 60]), min_size=1, max_size=40),
                     min_size=1, max_size=3),
       limit=st.integers(1, 4), refill=st.sampled_from([5, 10, 30]))
def test_limiter_equals_sequential_fold(spark, gaps, limit, refill):
    rows, rid = [], 0
    for k, seq in enumerate(gaps):
        t = 0
        for g in seq:
            t += g
            rows.append((f"k{k}", rid, T + dt.timedelta(seconds=t)))
            rid += 1
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp_ntz")
    want = brute(rows, limit, refill)
    got = {r.id: r.allowed for r in attempt_limiter(df, "key", limit, refill).collect()}
    assert got == want
