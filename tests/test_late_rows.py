"""Rows behind the watermark: in the late table or in the job's output, never in both or neither."""

import datetime as dt

from mercato.session import scratch_path
from mercato.streaming.jobs import attempt_limiter_stream, read_stream, run_available_now
from mercato.streaming.late import LateSplit, split_available_now

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp"


def _write(spark, path, rows):
    rows = [(i, k, None if h is None else T0 + dt.timedelta(hours=h)) for i, k, h in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, batches, root=None, path=None):
    path = path or scratch_path(spark, "late-in")
    for rows in batches:
        _write(spark, path, rows)
    return split_available_now(read_stream(spark, path, SCHEMA, files_per_trigger=1), lateness="2 hours", root=root), path


def test_every_row_is_late_or_judged_and_a_restart_keeps_the_bar(spark):
    batches = [[(1, "a", 0), (2, "a", 10), (3, "b", 1)],       # bar: none, so nothing is late but rows without a time
               [(4, "a", 7), (5, "a", 8), (6, "b", 12), (7, "b", None)],  # bar: 8, itself on time
               [(8, "b", 9), (9, "a", 10), (10, "c", 3)]]      # bar: 10
    split, path = _run(spark, batches)
    assert {r.id for r in split.late().collect()} == {4, 7, 8, 10}
    judged = run_available_now(attempt_limiter_stream(split.on_time(), "key", 2, "1 hour"), name="judged")
    got = {r.id: r.allowed for r in spark.read.parquet(judged).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 9}
    again, _ = _run(spark, [[(11, "a", 9), (12, "a", 11)]], root=split.root, path=path)  # after a restart: bar still 10
    assert {r.id for r in again.late().collect()} == {4, 7, 8, 10, 11}


def test_a_replayed_batch_changes_nothing(spark):
    split, _ = _run(spark, [[(1, "a", 0), (2, "a", 10)], [(3, "a", 1), (4, "a", 9)]])
    before = sorted(r.id for r in split.late().collect())
    other = spark.createDataFrame([(99, "z", T0)], SCHEMA)
    split(other, 1)  # in place already
    assert sorted(r.id for r in split.late().collect()) == before == [3]
    split(other, 2)  # bar 8 h: a new batch
    assert sorted(r.id for r in split.late().collect()) == [3, 99]


def test_empty_batches_and_clashing_names(spark):
    split = LateSplit(spark, scratch_path(spark, "late"), spark.createDataFrame([], SCHEMA).schema)
    assert split.late().count() == 0
    split(spark.createDataFrame([], SCHEMA), 0)
    assert split.late().count() == 0
    try:
        LateSplit(spark, "x", spark.createDataFrame([], f"{SCHEMA}, _bar long").schema)
    except ValueError as e:
        assert "_bar" in str(e)
    else:
        raise AssertionError("a clash of names passed")
