"""Submissions, accepts and declines of one batch against handling them one by one."""

import datetime as dt
import random

import numpy as np
import pytest

from mercato.operators import quote_events as qe

T = dt.datetime(2024, 1, 1)
EVENTS = "seq long, request_id long, kind string, caller_id long, amount_cents int, notes string, ts timestamp_ntz"
QUOTES = "id long, service_request_id long, amount_cents int, notes string, status string, created_at timestamp_ntz"


def one_by_one(quotes, events, owners):
    held = {r: [i, a, n, s, c] for i, r, a, n, s, c in quotes}
    out = []
    for seq, r, kind, caller, amount, notes, ts in sorted(events, key=lambda e: (e[6] is not None, e[6] or T, e[0])):
        q = held.get(r)
        stood = amount if kind == "quote" else q[1] if q else None
        if r not in owners:
            out.append((seq, "not_found", stood if kind == "quote" or q else None))
        elif kind == "quote":
            held[r] = [q[0] if q else seq, amount, notes, "sent", q[4] if q else ts]
            out.append((seq, "quoted", amount))
        elif q is None:
            out.append((seq, "not_found", None))
        elif caller != owners[r]:
            out.append((seq, "forbidden", stood))
        elif kind == "accept":
            out.append((seq, "accepted" if q[3] in ("draft", "sent") else "bad_state", stood))
            q[3] = "accepted" if q[3] in ("draft", "sent") else q[3]
        else:
            q[3] = "declined"
            out.append((seq, "declined", stood))
    return sorted(out), sorted((i, r, a, n, s, c) for r, (i, a, n, s, c) in held.items())


def made(rng, n, requests):
    rows = []
    for seq in range(n):
        r = rng.choice([1] * requests + list(range(requests + 2)))      # request 1 has a third and more of all events
        kind = rng.choice(["quote", "accept", "accept", "decline"])
        ts = None if rng.random() < 0.02 else T + dt.timedelta(minutes=rng.randrange(n // 3))
        rows.append((seq, r, kind, rng.choice([100 + r, 100 + r, 7, None]), rng.randrange(1000) if kind == "quote" else None,
                     rng.choice([None, f"n{seq}"]) if kind == "quote" else None, ts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "ranges", "batch"), [(1, 500_000, 10_000), (2, 40, 10_000), (3, 40, 7)])
def test_equals_one_by_one(spark, monkeypatch, seed, ranges, batch):
    """Over one range and many, and over Arrow batches that end inside a request."""
    monkeypatch.setattr(qe, "RANGE_ROWS", ranges)
    rng = random.Random(seed)
    events = made(rng, 600, 12)
    quotes = [(1000 + r, r, 50 + r, None, rng.choice(["draft", "sent", "accepted", "declined", "paid"]), T) for r in range(0, 12, 2)]
    owners = {r: 100 + r for r in range(12)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        new, outcomes = qe.apply_quote_events(
            spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(events, EVENTS),
            spark.createDataFrame(list(owners.items()), "id long, user_id long"))
        got = sorted((r.seq, r.outcome, r.amount_cents) for r in outcomes.collect())
        table = sorted(tuple(r) for r in new.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = one_by_one(quotes, events, owners)
    assert got == want
    assert table == held


def test_no_events(spark):
    quotes = [(1, 1, 5, "n", "sent", T)]
    new, outcomes = qe.apply_quote_events(spark.createDataFrame(quotes, QUOTES), spark.createDataFrame([], EVENTS),
                                          spark.createDataFrame([(1, 2)], "id long, user_id long"))
    assert outcomes.collect() == [] and [tuple(r) for r in new.collect()] == quotes


def test_running_maps_compose_in_any_grouping():
    rng = np.random.default_rng(5)
    kinds = list(qe.MAPS.values())
    maps = np.array([kinds[i] for i in rng.integers(0, len(kinds), 200)], np.int8)
    fresh = rng.random(200) < 0.05
    got = qe.running_maps(maps, fresh)
    now = None
    for i in range(200):
        now = maps[i] if fresh[i] or now is None else maps[i][now]
        assert (got[i] == now).all()
