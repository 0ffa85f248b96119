"""Exact top-k against all inner products."""

import math
import random

import numpy as np
import pytest

from mercato.llm import topk


def brute(rows, k, modulo):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, v), v)
    vec = {i: [math.floor(256 * x) for x in v] for i, v in best.items()}
    out = []
    for q in sorted(i for i in vec if i % modulo == 0):
        score = {c: max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(vec[q], vec[c], strict=False)))) for c in vec if c != q}
        out += [(q, r + 1, c, score[c]) for r, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:k])]
    return out


def found(df, **kw):
    return sorted(tuple(r) for r in topk.top_k(df, **kw).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert found(df, k=5, modulo=20) == brute(rows, 5, 20)


SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


@pytest.mark.parametrize("rows", [
    [(0, [1.0, 0.5]), (1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
     (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0]), (1, [0.5, 1.0]), (10, [-1.0, -0.001])],
    [(i, [1e300, float(i)]) for i in range(4)],
    [(i, [2.0**40, -(2.0**40)]) for i in range(4)],
    [(0, [1.0])],
    [],
    [(i, [0.25] * 40) for i in range(30)],
])
def test_edge_cases(spark, rows):
    df = spark.createDataFrame([(i, v, None, 0) for i, v in rows], SCHEMA)
    assert found(df, k=5, modulo=2) == brute(rows, 5, 2)


def test_bounds_drop_no_tie():
    rng = random.Random(4)
    c = np.array([[rng.choice((-3, 0, 3)) for _ in range(300)] for _ in range(48)], float)
    ids = np.arange(300)
    for i, j, s in topk.block_top(ids[:20], c[:, :20], ids, c, 5):
        assert s == int(c[:, i] @ c[:, j])
    got = [(i, j) for i, j, _ in topk.block_top(ids[:20], c[:, :20], ids, c, 5)]
    want = [(i, j) for i in range(20) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-(c[:, i] @ c[:, j]), j))[:5]]
    assert got == want


def test_no_block_goes_through_the_driver(spark, monkeypatch):
    """The packed queries are copied for each block of candidates: no plan may collect them for a broadcast."""
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 20)
    rows = [(i, [float(i % 7), float(-i % 11), 0.5]) for i in range(400)]
    df = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, modulo=10)
    assert sorted(tuple(r) for r in df.collect()) == brute(rows, 3, 10)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_mixed_vectors(spark, monkeypatch):
    """Lengths from 0 up, numbers of 16 bits to beyond doubles' whole ones, ties and copies, over several blocks."""
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "CELLS", 700)
    rng = random.Random(9)
    rows = [(i, [rng.choice((-1.0, 0.25, 1.0, rng.gauss(0, 1))) for _ in range(rng.choice((0, 1, 15, 16, 17, 40)))]) for i in range(150)]
    rows += [(i, [rng.choice((1.0, 1e3, 1e7, -1e12, 1e60, 0.0)) for _ in range(20)]) for i in range(150, 180)]
    rows += [(200 + i, [0.5] * 33) for i in range(40)] + [(3, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, k=4, modulo=5) == brute(rows, 4, 5)


@pytest.mark.parametrize("scale", [1, 2**9, 2**18])
def test_tiles_in_both_types(monkeypatch, scale):
    """Every way through a tile, in both widths of floating point, against all products."""
    for name, size in (("TILE_QUERIES", 13), ("TILE_CANDIDATES", 31), ("PROBE", 9)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(scale)
    ids = rng.permutation(400)[:170]
    for sparse in (0, 1 / 16, 0.5, 1):
        monkeypatch.setattr(topk, "SPARSE", sparse)
        for c in (rng.normal(0, 90, (70, 170)), rng.integers(-1, 2, (37, 170)), np.ones((5, 170)), np.zeros((0, 170)),
                  rng.normal(0, 90, (70, 170)) * 0.8 ** np.arange(70)[:, None]):
            c = np.floor(c) * scale
            scores = c[:, :50].T @ c
            want = [(i, j, scores[i, j]) for i in range(50)
                    for j in sorted((j for j in range(170) if j != i), key=lambda j: (-scores[i, j], ids[j]))[:6]]
            assert list(topk.block_top(ids[:50], c[:, :50], ids, c, 6)) == want
