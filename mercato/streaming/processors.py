"""Per-key stateful folds used by the Structured Streaming jobs.

Each factory returns a function for ``applyInPandasWithState`` (and each class
is a processor for ``transformWithStateInPandas``): it gets one key's rows of
one micro-batch (as pandas chunks) and its state, folds the rows in event order,
and yields output rows. State per key is O(1) (or the
k newest notifications of a bucket of users), never the key's history; the rows of one key in
one micro-batch are bounded by the trigger size (``maxFilesPerTrigger`` /
``maxBytesPerTrigger``). Event-time timeouts drop idle keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


def _concat(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [p for p in pdfs if len(p)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def _us(ts: pd.Series) -> np.ndarray:
    return pd.to_datetime(ts).astype("datetime64[us]").astype("int64").to_numpy()


def limiter_fold(limit: int, refill_us: int):
    """state (tokens, anchor_us); rows (key, id, ts) -> (key, id, ts, allowed, anchor_id)."""

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        df = _concat(pdfs)
        if df.empty:
            return
        df = df.sort_values(["ts", "id"], kind="stable")
        us, ids = _us(df["ts"]), df["id"].to_numpy()
        tokens, anchor, anchor_id = state.get if state.exists else (None, None, None)
        allowed = np.zeros(len(df), dtype=bool)
        anchors = np.zeros(len(df), dtype="int64")
        for i in range(len(df)):
            if anchor is None or us[i] - anchor > refill_us:
                tokens, anchor, anchor_id = limit, int(us[i]), int(ids[i])
            if tokens > 0:
                tokens -= 1
                allowed[i] = True
            anchors[i] = anchor_id
        state.update((int(tokens), int(anchor), int(anchor_id)))
        expire_ms = (anchor + refill_us) // 1000 + 1
        if expire_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expire_ms)
        yield pd.DataFrame({"key": df["key"].to_numpy(), "id": ids, "ts": df["ts"].to_numpy(),
                            "allowed": allowed, "anchor_id": anchors})

    return fn


class UnreadProcessor(StatefulProcessor):
    """Unread count among each user's newest ``k`` notifications.

    A key is a bucket of users, so that a call into Python, and a read and a write of
    state, serve many users. Two state variables per bucket: ``newest``, the k newest of
    each user, and ``early``, the reads whose notification has not come yet (with the
    watermark at their last arrival in ms), each one value of parallel arrays. While there
    are early reads a timer stands ``ttl_ms`` of event time after the oldest came, and
    forgets it. Rows: (bucket, user_id, kind 'n'|'r', id, created micros, is_read, all of
    them set; users without an id are bucket -1); out: (user_id, unread, n_latest) of the
    users with rows in the batch. All is merged, ranked and marked as whole columns."""

    def __init__(self, k: int, ttl_ms: int):
        self.k, self.ttl_ms = k, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState(
            "newest", "user array<bigint>, id array<bigint>, created array<bigint>, is_read array<boolean>")
        self.early = handle.getValueState("early", "user array<bigint>, id array<bigint>, at array<bigint>")

    @staticmethod
    def _held(state, **types) -> pd.DataFrame:
        values = state.get() or [[]] * len(types)
        return pd.DataFrame({c: pd.Series(v, dtype=t) for (c, t), v in zip(types.items(), values)})

    def _keep_early(self, early: pd.DataFrame) -> None:
        if len(early):
            self.early.update(tuple(early[c].tolist() for c in ("user", "id", "at")))
        else:
            self.early.clear()

    def _early(self) -> pd.DataFrame:
        return self._held(self.early, user="int64", id="int64", at="int64")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        df = _concat(rows)
        if df.empty:
            return

        def among(some: pd.DataFrame, others: pd.DataFrame) -> np.ndarray:
            return pd.MultiIndex.from_frame(some[one]).isin(pd.MultiIndex.from_frame(others[one]))

        one = ["user", "id"]
        df = df.rename(columns={"user_id": "user"}).astype({"user": "int64", "id": "int64", "created": "int64", "is_read": bool})
        fresh = df.loc[df["kind"] == "n", [*one, "created", "is_read"]]
        reads = df.loc[df["kind"] == "r", one].drop_duplicates()
        seen = pd.concat([self._held(self.newest, user="int64", id="int64", created="int64", is_read=bool), fresh])
        now = seen.groupby(one, as_index=False).agg({"created": "last", "is_read": "max"})
        now = now.sort_values(["user", "created", "id"], ascending=[True, False, False])
        now = now[now.groupby("user").cumcount() < self.k].reset_index(drop=True)
        early = self._early()
        now["is_read"] = now["is_read"].astype(bool) | among(now, reads) | among(now, early)

        left = early[~among(early, fresh)]  # its notification is here: no longer early
        ahead = reads[~among(reads, seen)]
        at = max(0, timerValues.getCurrentWatermarkInMs())
        if len(ahead) or len(left) < len(early):
            self._keep_early(pd.concat([left, ahead.assign(at=at)]).drop_duplicates(one, keep="last"))
        if len(ahead) and not len(early):
            self.handle.registerTimer(at + self.ttl_ms)
        if len(now):
            self.newest.update(tuple(now[c].tolist() for c in ("user", "id", "created", "is_read")))
        out = now[now["user"].isin(df["user"])].groupby("user")["is_read"].agg(["size", "sum"]).reset_index()
        if len(out):
            users = out["user"] if key[0] >= 0 else None
            yield pd.DataFrame({"user_id": pd.Series(users, out.index, "Int64"), "unread": out["size"] - out["sum"].astype("int64"), "n_latest": out["size"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now, early = timerValues.getCurrentWatermarkInMs(), self._early()
        early["at"] = early["at"].where(early["at"] > 0, now)  # of those that came before any watermark it starts now
        left = early[early["at"] + self.ttl_ms > now]
        self._keep_early(left)
        if len(left):
            self.handle.registerTimer(int(left["at"].min()) + self.ttl_ms)
        yield from ()

    def close(self) -> None:
        pass


def request_status_fold(remember_us: int):
    """state (status, updated_us, quote_status, paid json); rows (request_id,
    kind, status, order_id, ts, seq[, init_at]) in (ts, seq) order. Guards: accept
    only from sent/draft; an order pays once. ``paid`` holds the time of each
    order's last payment; those ``remember_us`` behind the newest event of the
    request are forgotten at the end of a batch. An init row (sorted first)
    seeds the state: status, quote status in ``order_id``, and the request's
    own updated_at in ``init_at``."""

    def fn(key, pdfs, state):
        df = _concat(pdfs)
        if df.empty:
            return
        df = df.sort_values(["ts", "seq"], kind="stable")
        if state.exists:
            status, updated, quote, paid = state.get
            paid = json.loads(paid)
        else:
            status, updated, quote, paid = None, None, None, {}
        at = _us(df["init_at"].fillna(df["ts"])) if "init_at" in df.columns else _us(df["ts"])
        for kind, st, order, u, a in zip(df["kind"], df["status"], df["order_id"], _us(df["ts"]), at):
            new = None
            if kind == "init":
                status, updated, quote = st, int(a), (order if isinstance(order, str) else None)
                continue
            if kind == "quote":
                quote, new = "sent", "quoted"
            elif kind == "accept":
                if quote in ("sent", "draft"):
                    quote, new = "accepted", "in_progress"
            elif kind == "decline":
                quote, new = "declined", "declined"
            elif kind == "pay":
                order = order if isinstance(order, str) else ""  # payments without an order are one order's
                if order not in paid:
                    new = "paid"
                paid[order] = max(int(u), paid.get(order, int(u)))
            elif kind == "deliver":
                new = "delivered"
            elif kind == "set":
                new = st
            if new is not None:
                status, updated = new, int(u)
        newest = max([int(_us(df["ts"]).max()), *paid.values()])
        paid = {o: u for o, u in paid.items() if u > newest - remember_us}
        state.update((status, updated, quote, json.dumps(paid, sort_keys=True)))
        yield pd.DataFrame({"request_id": [key[0]], "status": [status],
                            "updated_at": [pd.Timestamp(updated, unit="us") if updated is not None else pd.NaT],
                            "quote_status": [quote]})

    return fn


def session_fold(lifetime_us: int):
    """state (login_us, login_id); rows (user_id, kind 0 login | 1 event, id,
    ts) -> covered events (user_id, event_id, ts, login_id, login_ts)."""

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        df = _concat(pdfs)
        if df.empty:
            return
        df = df.sort_values(["ts", "kind", "id"], kind="stable")
        login_us, login_id = state.get if state.exists else (None, None)
        out_e, out_ts, out_l, out_lts = [], [], [], []
        for kind, i, ts, u in zip(df["kind"].to_numpy(), df["id"].to_numpy(), df["ts"], _us(df["ts"])):
            if kind == 0:
                if login_us is None or (u, i) >= (login_us, login_id):
                    login_us, login_id = int(u), int(i)
            elif login_us is not None and u < login_us + lifetime_us:
                out_e.append(int(i))
                out_ts.append(ts)
                out_l.append(login_id)
                out_lts.append(pd.Timestamp(login_us, unit="us"))
        if login_us is not None:
            state.update((login_us, login_id))
            expire_ms = (login_us + lifetime_us) // 1000 + 1
            if expire_ms > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(expire_ms)
        if out_e:
            yield pd.DataFrame({"user_id": [key[0]] * len(out_e), "event_id": out_e, "ts": out_ts,
                                "login_id": out_l, "login_ts": out_lts})

    return fn
