"""Whitening against a direct eigendecomposition, rank-one updates against it too, and the contract's own identities."""

import math

import numpy as np
import pytest

from mercato.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def spread(name, rng):
    return {
        "plain": lambda: rng.integers(-20, 20, (400, 24)),
        "low rank": lambda: (rng.normal(size=(400, 5)) @ rng.normal(size=(5, 24)) * 50).astype(int),
        "repeated": lambda: np.repeat(rng.integers(-3, 3, (10, 12)), 20, axis=0),
        "axes": lambda: np.eye(20, dtype=int) * 5,
        "graded": lambda: (rng.normal(size=(800, 24)) * np.geomspace(10_000, 1, 24)).astype(int),
        "constant": lambda: np.full((6, 4), 3),
        "one dimension": lambda: rng.integers(-20, 20, (100, 1)),
        "huge": lambda: np.array([[2**50, 0], [-2**50, 1], [5, 7]]),
    }[name]()


NAMES = ["plain", "low rank", "repeated", "axes", "graded", "constant", "one dimension", "huge"]


def assert_spectrum(s, rows):
    off = rows - rows.mean(axis=0)
    scatter = off.T @ off
    size = max(np.abs(scatter).max(), 1)
    assert s.n == len(rows) and s.sums == [int(x) for x in rows.sum(axis=0)]
    assert np.abs(s.mean - rows.mean(axis=0)).max() <= 1e-10 * max(np.abs(rows).max(), 1)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(rows.shape[1])).max() < 1e-11
    assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-11 * size
    assert np.abs(s.values - np.linalg.eigvalsh(scatter)).max() < 1e-11 * size


@pytest.mark.parametrize("name", NAMES)
def test_updates_equal_a_direct_decomposition(name):
    rows = spread(name, np.random.default_rng(3)).astype(np.int64)
    s = whitening.Spectrum(rows.shape[1])
    s.add(rows)
    assert_spectrum(s, rows)
    # the same from three parts, one of them a single vector
    parts = [whitening.Spectrum(rows.shape[1]) for _ in range(3)]
    for p, r in zip(parts, (rows[:1], rows[1:len(rows) // 2], rows[len(rows) // 2:]), strict=True):
        p.add(r)
    whole = whitening.Spectrum.of({k: v[0] for k, v in parts[0].row(0).items()})
    for p in parts[1:]:
        whole.join(p)
    assert_spectrum(whole, rows)


def test_secular_roots():
    rng = np.random.default_rng(4)
    for k in (1, 2, 7, 40):
        poles = np.sort(rng.uniform(0, 10, k))
        z = rng.normal(size=k) * np.where(rng.random(k) < 0.3, 1e-6, 1)
        near, x = whitening.secular(poles, z)
        want = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
        assert np.abs(np.sort(poles[near] + x) - want).max() < 1e-12 * max(want.max(), 1)


def brute(rows, components):
    whole = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not whole or not (dims := max(len(v) for _, v in whole)):
        return []
    ints = [(i, [math.floor(min(max(64 * x, -2.0**50), 2.0**50)) + 1_000_000 for x in [*v, *[0.0] * (dims - len(v))]]) for i, v in whole]
    fit = sorted({tuple(v) for _, v in ints})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[(n * x - s) / n for x, s in zip(v, sums, strict=True)] for v in fit])
    cov = off.T @ off / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, v in ints:
        mine = np.array([(n * x - s) / n for x, s in zip(v, sums, strict=True)]) @ axes
        deviation = min(2**63 - 1, sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)))
        for c in range(min(components, dims)):
            some = values[c] > 1e-12 * max(np.trace(cov), 1e-300)
            out.append((i, c + 1, n, deviation, abs(mine[c]) / math.sqrt(values[c]) if some else None,
                        values[c] / np.trace(cov) if np.trace(cov) > 0 else 0.0))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3], r[1], r[4] or 0))


def assert_same(got, want, exact=1e-7):
    assert len(got) == len(want)
    for g, w in zip(order([(r.vec_id, r.component, r.n, r.deviation, None if r.whitened is None else abs(r.whitened), r.explained)
                           for r in got]), order(want), strict=True):
        assert g[:4] == w[:4]
        assert (g[4] is None) == (w[4] is None) and (w[4] is None or g[4] == pytest.approx(w[4], rel=exact, abs=exact))
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-12)
    errors = {r.identity_error for r in got}
    assert len(errors) <= 1 and all(0 <= e <= 1e-8 for e in errors)


def test_equals_direct_decomposition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 3)  # several rounds of joins
    monkeypatch.setattr(whitening, "FANOUT", 4)
    rng = np.random.default_rng(8)
    axes = rng.normal(size=(20, 20))
    rows = [(i, ((rng.normal(size=20) * np.geomspace(10, 0.5, 20)) @ axes).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert_same(whitening.whitened(df).collect(), brute(rows, 16))


@pytest.mark.parametrize("rows", [
    [(0, [1.0, 0.5]), (1, [0.5, 1.25]), (2, [0.5, 1.25]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
     (6, [float("inf"), 0.0]), (None, [1.0, 2.0]), (7, []), (8, [1.5]), (1, [0.5, 1.25])],
    [(0, [1.0, 2.0, 3.0])],
    [(i, [2.0] * 20) for i in range(30)],
    [(i, [1e300, float(i)]) for i in range(4)],
    [(i, []) for i in range(3)],
    [(0, None)],
    [],
])
def test_edge_cases(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert_same(whitening.whitened(df).collect(), brute(rows, 16))


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    got = whitening.whitened(df).collect()
    assert_same(got, brute(rows, 16), 1e-6)
    assert len(got) == 16 * len(rows)
