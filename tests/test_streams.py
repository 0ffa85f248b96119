"""Stream = batch on the same rows, with state carried across micro-batches."""

from pyspark.sql import functions as F

from mercato.operators.keys import active_sessions, latest_session
from mercato.operators.limiter import attempt_limiter
from mercato.session import scratch_path
from mercato.sources.binding import bind
from mercato.streaming.jobs import (attempt_limiter_stream, latest_session_stream, read_stream, run_available_now,
                                    session_stream, write_stream_input)
from tests.conftest import SF_SMALL


def _events(spark):
    return bind(spark, SF_SMALL).source("events").select("event_id", "user_id", "ts")


def test_limiter_stream_equals_batch_over_several_batches(spark):
    ev = _events(spark)
    path = write_stream_input(ev, scratch_path(spark, "t-lim"), "ts", slices=5, files_per_slice=1)
    stream = read_stream(spark, path, ev.schema, files_per_trigger=1)
    out = run_available_now(attempt_limiter_stream(stream, "user_id", 3, "2 days", id_col="event_id",
                                                   lateness="365 days"), name="t-lim")
    got = {r.id: r.allowed for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).select("batch").distinct().count() == 5
    want = {r.event_id: r.allowed for r in attempt_limiter(ev, "user_id", 3, "2 days", id_col="event_id").collect()}
    assert got == want


def test_latest_session_stream_equals_batch(spark):
    ev = _events(spark)
    path = write_stream_input(ev.withColumn("is_login", F.col("event_id") % 4 == 0), scratch_path(spark, "t-ses"),
                              "ts", slices=3, files_per_slice=1)
    s = read_stream(spark, path, ev.schema.add("is_login", "boolean"), files_per_trigger=1)
    logins = s.where("is_login").select(F.col("event_id").alias("id"), "user_id", "ts")
    out = run_available_now(latest_session_stream(logins, s.select("event_id", "user_id", "ts"), lateness="365 days"),
                            name="t-ses")
    got = {(r.event_id, r.login_id) for r in spark.read.parquet(out).collect()}
    lg = ev.where(F.col("event_id") % 4 == 0).select(F.col("event_id").alias("id"), "user_id", "ts")
    want = {(r.event_id, r.login_id) for r in latest_session(lg, ev).collect()}
    assert got == want


def test_request_status_stream_applies_sequential_guards(spark):
    """Accept after a decline is refused; an order pays once; re-quote after
    accept allows a second accept - checked against a hand fold."""
    import datetime as dt

    from mercato.streaming.jobs import request_status_stream

    T = dt.datetime(2024, 1, 1)
    rows = [(1, "init", "open", None, T, 0), (1, "quote", None, None, T + dt.timedelta(hours=1), 1),
            (1, "decline", None, None, T + dt.timedelta(hours=2), 2),
            (1, "accept", None, None, T + dt.timedelta(hours=3), 3),          # refused: declined
            (2, "init", "quoted", "sent", T, 0), (2, "accept", None, None, T + dt.timedelta(hours=1), 1),
            (2, "pay", None, "o1", T + dt.timedelta(hours=2), 2), (2, "deliver", None, None, T + dt.timedelta(hours=3), 3),
            (2, "pay", None, "o1", T + dt.timedelta(hours=4), 4),             # paid twice: no-op
            (3, "init", "quoted", "accepted", T, 0), (3, "quote", None, None, T + dt.timedelta(hours=1), 1),
            (3, "accept", None, None, T + dt.timedelta(hours=2), 2)]
    df = spark.createDataFrame(rows, "request_id long, kind string, status string, order_id string, "
                                     "ts timestamp_ntz, seq long")
    path = write_stream_input(df, scratch_path(spark, "t-rs"), "ts", slices=2, files_per_slice=1)
    out = run_available_now(request_status_stream(read_stream(spark, path, df.schema, files_per_trigger=1)),
                            mode="update", name="t-rs")
    res = spark.read.parquet(out)
    last = {r.request_id: r for r in res.groupBy("request_id").agg(
        F.max_by(F.struct("status", "quote_status"), F.col("batch")).alias("s")).select("request_id", "s.*").collect()}
    assert (last[1].status, last[1].quote_status) == ("declined", "declined")
    assert (last[2].status, last[2].quote_status) == ("delivered", "accepted")
    assert (last[3].status, last[3].quote_status) == ("in_progress", "accepted")


def test_unread_stream_keeps_newest_k(spark):
    import datetime as dt

    from mercato.streaming.jobs import unread_stream

    T = dt.datetime(2024, 1, 1)
    notes = spark.createDataFrame([(i, 7, T + dt.timedelta(minutes=i), None) for i in range(5)],
                                  "id long, user_id long, created_at timestamp_ntz, read_at timestamp_ntz")
    reads = spark.createDataFrame([(4, 7), (0, 7), (3, 8)], "id long, user_id long")
    npath = write_stream_input(notes, scratch_path(spark, "t-un"), "created_at", slices=2, files_per_slice=1)
    rpath = scratch_path(spark, "t-ur")
    reads.write.parquet(rpath)
    out = run_available_now(unread_stream(read_stream(spark, npath, notes.schema),
                                          read_stream(spark, rpath, reads.schema), k=3), mode="update", name="t-un")
    res = spark.read.parquet(out)
    last = res.groupBy("user_id").agg(F.max_by(F.struct("unread", "n_latest"), F.col("batch")).alias("s")) \
        .select("user_id", "s.*").collect()
    # newest 3 of user 7 are ids 4, 3, 2; id 4 read (id 0 is outside the 3); user 8's read touches nothing
    assert [(r.user_id, r.unread, r.n_latest) for r in last] == [(7, 2, 3)]


def test_start_stream_with_processing_time_trigger(spark):
    import time

    from mercato.streaming.jobs import start_stream

    ev = _events(spark)
    path = write_stream_input(ev, scratch_path(spark, "t-start"), "ts", slices=1)
    out = scratch_path(spark, "t-start-out")
    q = start_stream(attempt_limiter_stream(read_stream(spark, path, ev.schema), "user_id", 3, "2 days",
                                            id_col="event_id", lateness="365 days"),
                     out, trigger="1 second", name="t_start")
    try:
        deadline = time.time() + 120
        while time.time() < deadline and q.lastProgress is None:
            time.sleep(1)
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(out).count() == ev.count()


def _unread(spark, batches, k=3, **kw):
    """Last (unread, n_latest) of user 7; each batch is (notification ids or (id, hour), read ids)."""
    import datetime as dt

    from mercato.streaming.jobs import unread_stream

    T = dt.datetime(2024, 1, 1)
    npath, rpath = scratch_path(spark, "t-un"), scratch_path(spark, "t-ur")
    ns, rs = "id long, user_id long, created_at timestamp_ntz, read_at timestamp_ntz", "id long, user_id long"
    for notes, reads in batches:
        notes = [n if isinstance(n, tuple) else (n, n) for n in notes]
        spark.createDataFrame([(i, 7, T + dt.timedelta(hours=h), None) for i, h in notes], ns).coalesce(1).write.mode("append").parquet(npath)
        spark.createDataFrame([(i, 7) for i in reads], rs).coalesce(1).write.mode("append").parquet(rpath)
    s = unread_stream(read_stream(spark, npath, spark.createDataFrame([], ns).schema, 1),
                      read_stream(spark, rpath, spark.createDataFrame([], rs).schema, 1), k=k, **kw)
    res = spark.read.parquet(run_available_now(s, mode="update", name="t-un"))
    last = res.groupBy("user_id").agg(F.max_by(F.struct("unread", "n_latest"), F.col("batch")).alias("s")).first().s
    return last.unread, last.n_latest


def test_unread_stream_counts_reads_that_come_batches_early(spark):
    # 5 and 6 are read two batches and one batch before they come; 9 never comes
    assert _unread(spark, [([1, 2], [5, 9]), ([3], [6]), ([4], []), ([5, 6], [4])]) == (0, 3)
    # the same notification again keeps its mark; a read of one that left the newest changes nothing
    assert _unread(spark, [([1, 2, 3], [2]), ([2, 4], [1]), ([5], [])]) == (3, 3)


def test_unread_stream_forgets_early_reads_in_time(spark):
    late = [([1], [50]), ([(2, 30)], []), ([(3, 200)], []), ([(4, 300)], []), ([(50, 400)], [])]
    assert _unread(spark, late, early="2 days", lateness="1 hour") == (3, 3)
    assert _unread(spark, late, early="60 days", lateness="1 hour") == (2, 3)


def test_session_stream_equals_the_interval_join(spark):
    """Two watermarks of an hour, five micro-batches, one user with a third of all events."""
    ev = _events(spark).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))
    path = write_stream_input(ev, scratch_path(spark, "t-pairs"), "ts", slices=5, files_per_slice=1)
    logins = read_stream(spark, path, ev.schema, files_per_trigger=1).where(F.col("event_id") % 4 == 0)
    s = session_stream(logins.select(F.col("event_id").alias("id"), "user_id", "ts"),
                       read_stream(spark, path, ev.schema, files_per_trigger=1), lateness="1 hour")
    got = sorted(tuple(r) for r in spark.read.parquet(run_available_now(s, name="t-pairs")).select("event_id", "login_id").collect())
    lg = ev.where(F.col("event_id") % 4 == 0).select(F.col("event_id").alias("id"), "user_id", "ts")
    want = sorted(tuple(r) for r in active_sessions(lg, ev).select("event_id", "login_id").collect())
    assert got == want and len(want) > ev.count()


def test_one_call_counts_for_many_users(spark):
    """Users of a bucket are merged in one call with one read and one write of each state variable."""
    import pandas as pd

    from mercato.streaming.processors import UnreadProcessor

    class Value:
        held, reads, writes = None, 0, 0

        def get(self):
            self.reads += 1
            return self.held

        def update(self, value):
            self.held, self.writes = value, self.writes + 1

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.values, self.timers = {}, []

        def getValueState(self, name, schema):  # noqa: N802
            return self.values.setdefault(name, Value())

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 50

    handle, p = Handle(), UnreadProcessor(2, 1000)
    p.init(handle)

    def call(rows, bucket=3):
        df = pd.DataFrame(rows, columns=["user_id", "kind", "id", "created", "is_read"]).assign(bucket=bucket)
        outs = list(p.handleInputRows((bucket,), iter([df]), Times()))
        return {(None if pd.isna(u) else u): (n, k) for o in outs for u, n, k in o[["user_id", "unread", "n_latest"]].itertuples(index=False)}

    notes = [(u, "n", i, i, False) for u in range(1, 40) for i in range(u * 10, u * 10 + 3)]
    got = call([*notes, (1, "r", 12, 0, True), (2, "r", 12, 0, True), (2, "r", 29, 0, True)])
    assert got == {u: (1 if u == 1 else 2, 2) for u in range(1, 40)}  # a read of another user's id touches nothing
    assert [v.writes for v in handle.values.values()] == [1, 1] and handle.timers == [1050]
    assert call([(2, "n", 29, 29, False)]) == {2: (1, 2)}  # read before it came; the others had no rows
    assert call([(0, "n", 7, 7, False)], bucket=-1) == {None: (1, 1)}


def test_a_slice_has_its_files_even_with_few_rows(spark):
    """A micro-batch of so many files is then a slice, so times stay in order from batch to batch."""
    df = spark.range(6).selectExpr("id", "CASE WHEN id < 4 THEN timestamp_ntz'2024-01-01 00:00:00' ELSE "
                                         "timestamp_ntz'2024-01-02 00:00:00' + make_interval(0,0,0,id) END AS ts")
    path = write_stream_input(df, scratch_path(spark, "t-files"), "ts", slices=4, files_per_slice=5)
    assert len(spark.read.parquet(path).inputFiles()) == 20 and spark.read.parquet(path).count() == 6
    out = run_available_now(read_stream(spark, path, df.schema, files_per_trigger=5), name="t-files")
    ends = spark.read.parquet(out).groupBy("batch").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("batch").collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]))


def test_status_stream_reads_each_source_once(spark, monkeypatch):
    """The events are stored before they are cut into slices: they were worked out again for each slice."""
    from mercato.plans import q_streams
    from mercato.streaming import jobs

    class Cut(Exception):
        pass

    def cut(df, *args, **kw):
        raise Cut(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(jobs, "write_stream_input", cut)
    try:
        q_streams.q_request_status_stream(bind(spark, SF_SMALL))
        raise AssertionError("nothing was cut")
    except Cut as e:
        assert "Join" not in str(e) and "Relation" in str(e)
