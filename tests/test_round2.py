"""Nothing is dropped, one path for every size, keys that stay unique, streams that restart."""

import datetime as dt
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.rules import json_object
from mercato.operators import changes, limiter
from mercato.operators.keys import audience_cross
from mercato.operators.orders import create_orders
from mercato.session import scratch_path
from mercato.sources.binding import Domain, bind, store_domain
from mercato.sources.changes import read_changes
from mercato.streaming.jobs import attempt_limiter_stream, read_stream, start_stream, write_stream_input

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def test_blank_change_lines_are_empty_bodies(spark):
    path = scratch_path(spark, "t-blank")
    spark.createDataFrame([('{"a": 1}',), ("",), ("  ",), ("{}",), ("{x",)], "value string").coalesce(1).write.text(path)
    good, bad = read_changes(spark, path, T.StructType().add("a", T.IntegerType()))
    assert sorted((r.a or 0 for r in good.collect())) == [0, 0, 0, 1] and bad.count() == 1


def test_stream_input_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i) if i % 3 else None) for i in range(9)], "id long, ts timestamp_ntz")
    for slices in (1, 4):
        path = write_stream_input(df, scratch_path(spark, "t-null"), "ts", slices=slices)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(9))


def test_limiter_attempts_without_a_key_share_a_bucket_that_refills(spark):
    df = spark.createDataFrame([(None, i, T0 + dt.timedelta(days=i)) for i in range(4)], "key string, id long, ts timestamp_ntz")
    assert all(r.allowed for r in limiter.attempt_limiter(df, "key", 1, 60).collect())


def test_limiter_time_does_not_grow_with_the_square(spark):
    """Each attempt its own anchor; four times the attempts for each key."""
    def seconds(n):
        rows = spark.range(8 * n).select((F.col("id") % 8).cast("string").alias("key"), "id",
                                         (F.lit(T0) + F.make_dt_interval(secs=F.floor(F.col("id") / 8) * 100)).cast("timestamp_ntz").alias("ts"))
        began = time.perf_counter()
        out = limiter.attempt_limiter(rows, "key", 1, 60).agg(F.count_if("allowed"), F.count("*")).first()
        assert tuple(out) == (8 * n, 8 * n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(10_000) < 8 * max(seconds(2_500), 1)


def test_audience_salts_change_nothing(spark):
    users = spark.createDataFrame([(i, ("customer", "staff", "admin")[i % 3]) for i in range(50)], "id long, role string")
    notes = spark.createDataFrame([(1, None), (2, "staff"), (3, "nobody")], "seq long, role string")
    want = sorted([(1, i) for i in range(50)] + [(2, i) for i in range(50) if i % 3 == 1])
    for salts in (1, 16):
        assert sorted((r.seq, r.user_id) for r in audience_cross(notes, users, salts=salts).collect()) == want


def test_stored_domain_equals_lazy_views(spark):
    folder = store_domain(spark, SF + "/")
    try:
        stored, lazy = bind(spark, SF), Domain(spark, SF)
        assert stored is not lazy and folder in stored.orders.inputFiles()[0]
        for name, df in lazy.tables().items():
            assert stored.tables()[name].count() == df.count()
    finally:
        from mercato.sources import binding

        binding._STORED.clear()


def test_item_ids_are_unique_and_batches_do_not_collide(spark):
    d = Domain(spark, SF)
    ids = None
    for batch in (None, "b1", "b2"):
        orders, items, _ = create_orders(d.order_requests, d.order_lines, d.products, d.services, batch=batch)
        assert items.count() == items.select("id").distinct().count()
        assert orders.count() == orders.select("id").distinct().count()
        ids = items.select("id") if ids is None else ids.union(items.select("id"))
    assert ids.count() == ids.distinct().count()


def test_defaults_mint_a_missing_id(spark):
    rows = spark.createDataFrame([("a", "t", "d", 1), ("b", "t", "d", 1)], "slug string, title string, description string, price_cents int")
    got = changes.append_with_defaults(rows, "product", T0).collect()
    assert len({r.id for r in got}) == 2 and None not in {r.id for r in got}


def test_password_only_patch_updates(spark):
    users = spark.createDataFrame([(1, "n", T0)], "id long, name string, updated_at timestamp_ntz")
    patch = spark.createDataFrame([(1, None, "secret12")], "id long, name string, password string")
    table, out = changes.apply_patches(users, patch, ["name"], None, dt.datetime(2025, 1, 1), also=("password",))
    assert [r.outcome for r in out.collect()] == ["updated"]
    assert [(r.name, r.updated_at.year) for r in table.collect()] == [("n", 2025)]


def test_brief_may_begin_with_any_white_space(spark):
    df = spark.createDataFrame([('\n{"a":1}',), ("[1]",), ('"{"',), (None,), ("{",)], "b string")
    assert [r.ok for r in df.select(json_object("b").alias("ok")).collect()] == [True, False, False, False, False]


def test_stream_goes_on_after_a_restart(spark):
    ev = Domain(spark, SF).source("events").select("event_id", "user_id", "ts").orderBy("ts")
    rows = ev.collect()
    path, out = scratch_path(spark, "t-restart"), scratch_path(spark, "t-restart-out")
    for part in (rows[:len(rows) // 2], rows[len(rows) // 2:]):
        spark.createDataFrame(part, ev.schema).coalesce(1).write.mode("append").parquet(path)
        q = start_stream(attempt_limiter_stream(read_stream(spark, path, ev.schema), "user_id", 3, "2 days", id_col="event_id",
                                                lateness="365 days"), out, trigger="1 second", name="t_restart")
        try:
            deadline = time.time() + 120
            while time.time() < deadline and q.lastProgress is None:
                time.sleep(0.5)
            q.processAllAvailable()
        finally:
            q.stop()
    got = {r.id: r.allowed for r in spark.read.parquet(out).collect()}
    want = {r.event_id: r.allowed for r in limiter.attempt_limiter(ev, "user_id", 3, "2 days", id_col="event_id").collect()}
    assert spark.read.parquet(out).count() == len(rows) and got == want
