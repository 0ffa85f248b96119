"""Mixing: targets against the stepwise rule, the fit against all subsets, the whole against its contract."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mercato.llm import mixing


def stepwise(sizes, weights=(1, 2, 3), repeats=3):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if goal[s] > repeats * sizes[s]]
        if not over:
            return {**fixed, **goal}
        fixed |= {s: repeats * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_stepwise(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice((0, 1, 5, 100, 10_000)) for s in rng.sample(["a", "b", "é", "Z", "zz", "", "c", "d", None], rng.randint(1, 9))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(stepwise(sizes))


def test_fit_budget_equals_all_subsets():
    rng = random.Random(2)
    for _ in range(150):
        lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        # the knapsack fits what the shares leave, so it is compared over the same free documents
        share = np.array([c * budget // int((lengths * counts).sum()) for c in counts])
        best = min(abs(budget - int((lengths * (share + np.array(x))).sum()))
                   for x in itertools.product(*(range(c + 1) for c in counts - share)))
        assert abs(budget - int((lengths * take).sum())) == best


def test_mix_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())
    assert len(got) == docs.count()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, total = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
        total[source[r.doc_id]] += r.size
    goal = stepwise(total)
    for r in got:
        assert r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    rows = mixing.mixed(docs)
    assert rows.schema == docs.schema
    out = defaultdict(int)
    for r in rows.collect():
        out[r.doc_id] += size[r.doc_id]
    assert {k: v for k, v in out.items() if v} == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_edge_cases(spark):
    schema = "doc_id long, text string, source string, taken string, h int"
    rows = [(1, "a b c", "x", "t", 1), (1, "a b c", "x", "t", 1), (2, None, "x", "t", 1), (3, "", None, "t", 1),
            (None, "w " * 50_000, None, "t", 1), (4, "a", "only empty", "t", 1), (5, " ", "z", "t", 1)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 7 and all(r.taken <= 3 * r.size for r in got)
    assert {r.target for r in got if r.doc_id == 5} == {0.0}
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    hot = spark.createDataFrame([(i, "a b", "x", "", 0) for i in range(300)] + [(1000, "c " * 900, "y", "", 0)], schema)
    got = mixing.mix(hot).collect()
    assert sum(r.taken for r in got if r.doc_id < 1000) == 500  # 1500 words by 1 : 2


def test_rows_that_share_or_lack_an_id_stay_themselves(spark):
    schema = "doc_id long, text string, source string, h int"
    rows = [(None if i % 3 == 0 else i if i % 3 == 1 else 2, f"t{i} " * (1 + i % 4), "ab"[i % 2], i) for i in range(120)]
    docs = spark.createDataFrame(rows, schema)
    got = Counter(tuple(r) for r in mixing.mixed(docs).collect())
    assert set(got) <= set(rows) and max(got.values()) <= 3
    plan = Counter((r.doc_id, r.size) for r in mixing.mix(docs).collect() for _ in range(r.copies))
    assert plan == Counter((r[0], 1 + r[3] % 4) for r in got.elements())
    goal = stepwise({s: sum(1 + r[3] % 4 for r in rows if r[2] == s) for s in "ab"})
    assert all(abs(sum(1 + r[3] % 4 for r in got.elements() if r[2] == s) - goal[s]) <= 1 for s in "ab")
