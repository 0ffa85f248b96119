"""Quotes under a batch of submissions, accepts and declines, as if each were handled in its turn.

What an event does to a request's quote depends on the state it finds, so the
events of a request have an order. Each event is a map over the quote states, and
maps compose in any grouping: the events are sorted into ranges, a range composes
the maps of each request's run in it, the runs of a request compose in order, and
each event then finds its state from the state its run starts with. A request with
a third of all events is a run in many ranges; nothing handles it alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.session import scratch_path

#: States of a request's quote, by number. The quote statuses, and no quote at all.
STATES = ("none", "draft", "sent", "accepted", "declined", "paid")
_N = len(STATES)
_NONE, _DRAFT, _SENT, _ACCEPTED, _DECLINED, _PAID = range(_N)
#: Each kind of event as the state it leaves behind for each state it finds.
MAPS = {
    "quote": [_SENT] * _N,
    "accept": [_NONE, _ACCEPTED, _ACCEPTED, _ACCEPTED, _DECLINED, _PAID],
    "decline": [_NONE] + [_DECLINED] * (_N - 1),
    "nothing": list(range(_N)),
}
#: Events in a range, which one task sorts.
RANGE_ROWS = 500_000


def _code(to) -> int:
    """A map as one number, a digit for each state."""
    return sum(int(s) * _N**i for i, s in enumerate(to))


def _applied(code: Column, state: Column) -> Column:
    """The state that a map makes of a state."""
    return F.floor(code / F.pow(F.lit(float(_N)), state)).cast("long") % _N


def running_maps(maps: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The composition of each row's map with all before it since the last ``fresh`` row, by doubling: after a step each
    row has composed twice as many."""
    out, start = maps.copy(), np.maximum.accumulate(np.where(fresh, np.arange(len(maps)), 0))
    step, at = 1, np.arange(len(maps))
    while step < len(maps):
        on = np.flatnonzero(at - step >= start)
        if not len(on):
            break
        out[on] = np.take_along_axis(out[on], out[on - step], axis=1)  # the earlier map first
        step *= 2
    return out


def _runs(batches):
    """Adds to rows in order: the map of the request's earlier events in this range, its own, and the last amount quoted."""
    table = np.array([MAPS[k] for k in MAPS], np.int8)
    index = {k: i for i, k in enumerate(MAPS)}
    digits = _N ** np.arange(_N, dtype=np.int64)
    last, carried, amount = object(), table[index["nothing"]], None
    for batch in batches:
        if not batch.num_rows:
            continue
        request = batch.column("request_id").to_pylist()
        own = table[[index[k] for k in batch.column("does").to_pylist()]]
        fresh = np.array([a != b for a, b in zip(request, [last, *request[:-1]], strict=True)])
        after = running_maps(own, fresh | (np.arange(len(own)) == 0))
        head = len(own) if not fresh.any() else int(fresh.argmax())  # goes on with the batch before
        after[:head] = np.take_along_axis(after[:head], np.broadcast_to(carried, (head, _N)).astype(np.int64), axis=1)
        before = np.vstack([carried[None], after[:-1]])
        before[fresh] = table[index["nothing"]]
        # the last amount quoted before each event in its run; a run's first rows may look back to the batch before
        quote, at = np.array([k == "quote" for k in batch.column("does").to_pylist()]), np.arange(len(own))
        said = np.maximum.accumulate(np.where(quote, at, -1))
        prior = np.r_[-1, said[:-1]]
        start = np.maximum.accumulate(np.where(fresh, at, -1))
        here = batch.column("amount_cents").take(pa.array(np.maximum(prior, 0)))
        amounts = pc.if_else(pa.array(prior >= np.maximum(start, 0)), here, pa.scalar(None, pa.int32()))
        amounts = pc.if_else(pa.array((start < 0) & (prior < 0)), pa.scalar(amount, pa.int32()), amounts)
        if said[-1] >= max(start[-1], 0):
            amount = batch.column("amount_cents")[int(said[-1])].as_py()
        elif start[-1] >= 0:
            amount = None
        last, carried = request[-1], after[-1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(before @ digits), pa.array(after @ digits), amounts],
            names=[*batch.schema.names, "before", "after", "quoted"])


def apply_quote_events(quotes: DataFrame, events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events(seq, request_id, kind quote|accept|decline, caller_id, amount_cents, notes, ts) in the order of (ts, seq)
    -> (new quotes, outcomes).

    A ``quote`` (a submission that passed its guard) makes or replaces the one
    quote of its request and sends it. Answers are the owner's: not_found (no
    such request, or no quote at that time) > forbidden (someone else's) >
    bad_state (an accept of a quote that is neither draft nor sent) > accepted /
    declined; quotes are ``quoted`` or not_found. Outcomes carry the amount that
    stood when the event came, so an accepted one makes the service order.

    A quote keeps its id and created_at; a new one has its first submission's.
    Events without a time come before all others of their request. ``seq`` must
    tell events apart.
    """
    owner = requests.select(F.col("id").alias("_rid"), F.col("user_id").alias("owner_id"))
    e = events.join(owner, events["request_id"] == owner["_rid"], "left")
    mine = F.coalesce(F.col("caller_id") == F.col("owner_id"), F.lit(False))
    does = F.when(F.col("_rid").isNull(), "nothing").when(F.col("kind") == "quote", "quote").when(
        mine & F.col("kind").isin("accept", "decline"), F.col("kind")).otherwise("nothing")
    e = e.select("seq", "request_id", "kind", "caller_id", F.col("amount_cents").cast("int").alias("amount_cents"), "notes", "ts",
                 "owner_id", F.col("_rid").isNotNull().alias("exists"), mine.alias("mine"), does.alias("does"))
    order = ["request_id", "ts", "seq"]
    ranges = -(-events.count() // RANGE_ROWS) or 1
    placed = e.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in e.schema)}, before long, after long, quoted int"
    path = scratch_path(quotes.sparkSession, "quote-events")
    placed.mapInArrow(_runs, schema).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    placed = quotes.sparkSession.read.parquet(path).withColumn("part", F.shiftright("at", 33))

    # one row for each request and range; the states and amounts they start with, in order
    runs = placed.groupBy("request_id", "part").agg(
        F.max_by("after", "at").alias("map"),
        F.max_by("amount_cents", F.when(F.col("does") == "quote", F.col("at"))).alias("amount"))
    q = quotes.select(F.col("service_request_id").alias("_r"), F.col("status").alias("_status"), F.col("amount_cents").alias("_amount"))
    runs = runs.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("part", "map", "amount"))).alias("runs"))
    runs = runs.join(q, runs["request_id"] == q["_r"], "left")
    first = F.coalesce(F.array_position(F.lit(list(STATES)), F.col("_status")) - 1, F.lit(_NONE)).cast("long")
    kind = "array<struct<part:bigint,state:bigint,amount:int>>"
    start = F.array(F.struct(F.lit(-1).cast("long").alias("part"), first.alias("state"), F.col("_amount").cast("int").alias("amount")))
    walked = F.aggregate("runs", start.cast(kind), lambda acc, r: F.concat(acc, F.array(F.struct(
        r["part"].cast("long").alias("part"), _applied(r["map"], F.element_at(acc, -1)["state"]).alias("state"),
        F.coalesce(r["amount"], F.element_at(acc, -1)["amount"]).cast("int").alias("amount")))))
    runs = runs.withColumn("walked", walked)
    enters = runs.select("request_id", F.posexplode("runs").alias("i", "run"), "walked").select(
        F.col("request_id").alias("_q"), F.col("run.part").alias("_p"), F.col("walked")[F.col("i")]["state"].alias("_enter"),
        F.col("walked")[F.col("i")]["amount"].alias("_stood"))
    ends = runs.select(F.col("request_id").alias("_q"), F.element_at("walked", -1)["state"].alias("_end"),
                       F.element_at("walked", -1)["amount"].alias("_last"))

    j = placed.join(enters, placed["request_id"].eqNullSafe(F.col("_q")) & (placed["part"] == F.col("_p")))
    state = _applied(F.col("before"), F.col("_enter"))
    j = j.withColumn("found", state).withColumn("stood", F.coalesce("quoted", "_stood"))
    outcome = (F.when(~F.col("exists"), "not_found").when(F.col("kind") == "quote", "quoted")
               .when(F.col("found") == _NONE, "not_found").when(~F.col("mine"), "forbidden")
               .when((F.col("kind") == "accept") & ~F.col("found").isin(_DRAFT, _SENT), "bad_state")
               .when(F.col("kind") == "accept", "accepted").when(F.col("kind") == "decline", "declined"))
    amount = F.when(F.col("kind") == "quote", F.col("amount_cents")).when(F.col("found") != _NONE, F.col("stood"))
    outcomes = j.select("seq", "request_id", "kind", "caller_id", "ts", outcome.alias("outcome"), amount.alias("amount_cents"))

    sent = placed.where(F.col("does") == "quote").groupBy(F.col("request_id").alias("_s")).agg(
        F.min_by(F.struct("seq", "ts"), "at").alias("_first"), F.max_by(F.struct("notes"), "at").alias("_note"))
    new = ends.where(F.col("_end") != _NONE).join(sent, F.col("_q") == F.col("_s"), "left")
    merged = quotes.join(new, quotes["service_request_id"] == new["_q"], "full")
    changed = F.col("_q").isNotNull()
    merged = merged.select(
        F.coalesce("id", "_first.seq").alias("id"), F.coalesce("service_request_id", "_q").alias("service_request_id"),
        F.when(changed, F.col("_last")).otherwise(F.col("amount_cents")).alias("amount_cents"),
        F.when(F.col("_s").isNotNull(), F.col("_note.notes")).otherwise(F.col("notes")).alias("notes"),
        F.when(changed, F.element_at(F.lit(list(STATES)), (F.col("_end") + 1).cast("int"))).otherwise(F.col("status")).alias("status"),
        F.coalesce("created_at", "_first.ts").alias("created_at"))
    return merged, outcomes
