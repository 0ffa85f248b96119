"""The notification stream: restarts, replays, lost checkpoints, failed batches, late changes, requests made later."""

import datetime as dt

import pytest

from mercato.operators import notify
from mercato.session import scratch_path
from mercato.streaming.jobs import read_stream
from mercato.streaming.notifications import NotificationSink, notification_stream

T = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
FIELDS = [c.split()[0] for c in notify.CHANGES.split(", ")]


def at(hours):
    return T + dt.timedelta(hours=hours)


def change(kind, seq, hours, **kw):
    row = dict.fromkeys(FIELDS) | {"kind": kind, "seq": seq, "ts": None if hours is None else at(hours)} | kw
    return tuple(row[c] for c in FIELDS)


@pytest.fixture
def shop(spark):
    day = dt.datetime(2024, 1, 1)
    users = spark.createDataFrame(
        [(1, "Ada", "admin", day), (2, "Ed", "editor", day + dt.timedelta(days=1)), (3, "Cus", "customer", day),
         (4, "Tom", "customer", day)], "id long, name string, role string, created_at timestamp_ntz")
    services = spark.createDataFrame([(1, "Logo")], "id long, title string")
    requests = {"rows": [(10, 3, 1), (11, 4, 1)]}

    def tables():
        return {"users": users, "services": services,
                "service_requests": spark.createDataFrame(requests["rows"], "id long, user_id long, service_id long")}

    return requests, tables


class Feed:
    """A folder of change files read one per micro-batch into one root."""

    def __init__(self, spark, tables, lateness="2 hours"):
        self.spark, self.tables, self.lateness = spark, tables, lateness
        self.path, self.root = scratch_path(spark, "t-changes"), scratch_path(spark, "t-notify")
        self.sink = NotificationSink(spark, self.root, tables, lateness)

    def add(self, *changes):
        self.frame(changes).coalesce(1).write.mode("append").parquet(self.path)

    def frame(self, changes):
        return self.spark.createDataFrame(list(changes), notify.CHANGES)

    def run(self, checkpoint=None):
        s = read_stream(self.spark, self.path, self.frame([]).schema, files_per_trigger=1)
        notification_stream(s, self.root, self.tables, self.lateness, checkpoint, {"availableNow": True}).awaitTermination()

    def got(self, table="notifications"):
        rows = self.sink.read(table).collect()
        return sorted((r.branch, r.user_id) for r in rows) if table == "notifications" else sorted((r.kind, r.seq, r[-1]) for r in rows)

    def accounted(self, n):
        """Every input row: notified (new), waiting, late or a repeat."""
        rows = self.sink.ledger()
        new = sum(self.spark.read.parquet(self.sink._path("keys", r.step)).count() for r in rows)
        late = [r for r in self.sink.read("late").collect()]
        assert new + sum(r.reason == "late" for r in late) + sum(r.repeated for r in rows) == n


FIRST = [change("message_posted", 1, 0, request_id=10, caller_id=3), change("message_posted", 2, 0, request_id=10, caller_id=1),
         change("quote_ready", 3, 1, request_id=11, quote_id=7), change("quote_accepted", 4, 1, request_id=10, caller_id=3, order_id="o"),
         change("broadcast", 5, 1, title="Hi", body="All", role="customer"), change("broadcast", 6, 1, title="Hi", body="All"),
         change("order_ready", 7, 1, owner_id=4, order_type="digital"), change("order_ready", 8, 1, owner_id=4, order_type="service")]
NOTED = sorted([("message_posted", 1), ("message_posted", 3), ("quote_ready", 4), ("quote_accepted", 1), ("quote_accepted", 2),
                ("broadcast", 3), ("broadcast", 4), ("broadcast", 1), ("broadcast", 2), ("broadcast", 3), ("broadcast", 4),
                ("order_ready", 4)])


def test_restart_replay_late_and_later_requests(spark, shop):
    requests, tables = shop
    feed = Feed(spark, tables)
    feed.add(*FIRST, FIRST[0])                                             # one change twice in one file
    feed.run()
    assert feed.got() == NOTED
    # restarted: known changes again, one behind the watermark (-1 h), one whose request is not there yet
    feed.add(*FIRST[2:4], change("deliverable_posted", 20, 2, request_id=12, deliverable_id="d"))
    feed.add(change("message_posted", 21, 1.5, request_id=11, caller_id=1), change("message_posted", 22, -2, request_id=11, caller_id=1))
    feed.run()
    noted = sorted([*NOTED, ("message_posted", 4)])
    assert feed.got() == noted
    assert feed.got("waiting") == [("deliverable_posted", 20, at(2).replace(tzinfo=None))]
    assert feed.got("late") == [("message_posted", 22, "late")]
    # the request is made after the stream began
    requests["rows"].append((12, 4, 1))
    feed.add(change("quote_declined", 23, 3, request_id=10, caller_id=99, quote_id=5))   # an unknown caller waits
    feed.run()
    noted = sorted([*noted, ("deliverable_posted", 4)])
    assert feed.got() == noted and feed.got("waiting") == [("quote_declined", 23, at(3).replace(tzinfo=None))]
    # the watermark passes what waits
    feed.add(change("order_ready", 24, 9, owner_id=3, order_type="digital"))
    feed.run()
    noted = sorted([*noted, ("order_ready", 3)])
    assert feed.got() == noted and feed.got("waiting") == []
    assert feed.got("late") == [("message_posted", 22, "late"), ("quote_declined", 23, "unresolved")]
    feed.accounted(9 + 3 + 2 + 1 + 1)
    # the checkpoint is lost: everything comes again, nothing is notified again
    feed.run(checkpoint=scratch_path(spark, "t-new-checkpoint"))
    assert feed.got() == noted
    assert {r.id for r in feed.sink.read("notifications").collect()}.__len__() == len(noted)


def test_a_batch_that_failed_is_done_again(spark, shop):
    _, tables = shop
    feed = Feed(spark, tables)

    class Failing(NotificationSink):
        at_ledger = True

        def _path(self, table, step):
            if table == "ledger" and self.at_ledger:
                raise RuntimeError("lost")
            return super()._path(table, step)

    sink = Failing(spark, feed.root, tables, "2 hours")
    with pytest.raises(RuntimeError):
        sink(feed.frame(FIRST), 0)
    assert feed.got() == []                       # written, but it does not count yet
    sink.at_ledger = False
    sink(feed.frame(FIRST), 0)
    assert feed.got() == NOTED
    sink(feed.frame(FIRST), 0)                    # done already
    sink(feed.frame([]), 1)
    assert feed.got() == NOTED and [r.notified for r in sink.ledger()] == [len(NOTED), 0]


def test_changes_without_time_request_or_staff(spark, shop):
    _, tables = shop
    feed = Feed(spark, lambda: tables() | {"users": tables()["users"].where("role = 'customer'")})
    feed.add(change("message_posted", 1, None, request_id=10, caller_id=3), change("message_posted", 2, None, request_id=99, caller_id=3),
             change("message_posted", 3, 0, request_id=None, caller_id=3), change("quote_accepted", 4, 0, request_id=10, caller_id=None),
             change("message_posted", 5, 0, request_id=10, caller_id=None), change("quote_declined", 6, 0, request_id=10, caller_id=3))
    feed.run()
    assert feed.got() == [("message_posted", 3)]  # no staff: neither the owner's message nor the decline notifies anybody
    assert [x[:2] for x in feed.got("waiting")] == [("message_posted", 3), ("quote_accepted", 4)]
    assert feed.got("late") == [("message_posted", 2, "unresolved")]
    feed.accounted(6)


def test_one_pass_joins_users_at_most_twice(spark, shop):
    t = shop[1]()
    notes, _ = notify.change_notifications(spark.createDataFrame([], notify.CHANGES), t["users"], t["service_requests"], t["services"])
    plan = notes._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 4  # services to requests, requests, users by caller, users by audience
