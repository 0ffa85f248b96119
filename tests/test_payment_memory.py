"""The status stream's payment memory: repeats are known across batches, and the state does not grow with payments."""

import datetime as dt
import json

import pandas as pd

from mercato.streaming.processors import request_status_fold

T = dt.datetime(2024, 1, 1)
DAY_US = 86_400_000_000


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def run(fold, state, rows):
    df = pd.DataFrame(rows, columns=["request_id", "kind", "status", "order_id", "ts", "seq"])
    return next(fold((1,), iter([df]), state)).iloc[0]


def test_state_stays_constant_over_a_thousand_payments():
    fold, state, sizes = request_status_fold(DAY_US), State(), []
    for batch in range(10):
        run(fold, state, [(1, "pay", None, f"o{i}", T + dt.timedelta(hours=i), i) for i in range(batch * 100, batch * 100 + 100)])
        sizes.append(len(json.loads(state.get[3])))
    assert sizes == [24] * 10


def test_a_repeat_is_known_in_later_batches_until_it_is_forgotten():
    fold, state = request_status_fold(DAY_US), State()
    hour = dt.timedelta(hours=1)
    assert run(fold, state, [(1, "pay", None, "a", T, 1), (1, "pay", None, None, T, 2)])["status"] == "paid"
    last = run(fold, state, [(1, "deliver", None, None, T + hour, 3), (1, "pay", None, "a", T + 2 * hour, 4),
                             (1, "pay", None, None, T + 2 * hour, 5)])
    assert last["status"] == "delivered" and last["updated_at"] == T + hour
    # the repeat renewed it; other events move time on and forget it
    assert run(fold, state, [(1, "pay", None, "a", T + 25 * hour, 6)])["status"] == "delivered"
    run(fold, state, [(1, "set", "completed", None, T + 50 * hour, 7)])
    assert json.loads(state.get[3]) == {}
    assert run(fold, state, [(1, "pay", None, "a", T + 51 * hour, 8)])["status"] == "paid"
