"""LM scoring against a plain count of every n-gram, and probabilities that sum to one."""

import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mercato.llm import exchange, ngram_lm

SCHEMA = "doc_id long, text string, block string, score string"


def toks(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + [" "]


def model(texts):
    """p(word), and weight(state, word) by discounting and backing off, from plain counts."""
    uni, bi = Counter(), Counter()
    for t in texts:
        w = toks(t)
        uni.update(w)
        bi.update(zip([" ", *w], w, strict=False))
    z = sum(uni.values()) + 0.5 * (len(uni) + 1)
    after = defaultdict(list)
    for h, w in bi:
        after[h].append(w)

    def p(w):
        return (uni[w] + 0.5) / z

    @functools.cache
    def backoff(h):
        if not uni[h]:
            return 1.0
        left = ngram_lm.DISCOUNT * len(after[h]) / uni[h]
        return left / (1 - sum(map(p, after[h])))

    def weight(h, w):
        return (bi[h, w] - ngram_lm.DISCOUNT) / uni[h] if bi[h, w] else backoff(h) * p(w)

    return uni, p, weight


def brute(rows):
    fold = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i, _ in rows}
    uni, p, weight = model([t for i, t in rows if fold[i] != 1])
    out = []
    for i, t in rows:
        w = toks(t)
        s = [weight(h, x) for h, x in zip([" ", *w], w, strict=False)]
        out.append((i, fold[i] == 1, len(w), sum(x in uni for x in w), sum(uni.values()),
                    sum(math.log10(p(x)) for x in w), sum(map(math.log10, s))))
    return sorted(out, key=str)


def scored(df):
    return sorted((tuple(r) for r in ngram_lm.lm_scores(df).collect()), key=str)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=2e-6)


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(exchange.blocked, "__defaults__", (20_000,))
    assert exchange.blocked(docs)[1] > 10
    same(scored(docs), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_edge_cases(spark):
    rows = [(1, "A b a B"), (1, "A b a B"), (2, None), (3, ""), (None, "a É"), (4, "x" * 100_000), (6, "b " * 30_000), (7, " c")]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    same(scored(docs), brute(rows))
    assert ngram_lm.lm_scores(docs.limit(0)).collect() == []


def test_every_arc_and_failure_arc_of_one_state(spark):
    """Every known word and one unknown word after the same word; the weights of a state sum to one."""
    train = [(i, t) for i, t in enumerate(["a b c a b", "b c c", "a c b a", "d"] * 3)
             if zlib.crc32(str(i).encode()) % 5 != 1]
    vocab = sorted({w for _, t in train for w in t.split()})
    held = [i for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 5 == 1]
    ends = [*vocab, "zzz"]
    probes = dict(zip(held, ["a", *[f"a {w}" for w in ends]], strict=False))
    docs = spark.createDataFrame([(i, t, "", "") for i, t in [*train, *probes.items()]], SCHEMA)
    got = {r.doc_id: r.score for r in ngram_lm.lm_scores(docs).collect()}
    want = {w[0]: w[6] for w in brute([*train, *probes.items()])}
    assert got == pytest.approx(want, abs=2e-6)
    uni, p, weight = model([t for _, t in train])
    assert sum(p(w) for w in [*uni, "zzz"]) == pytest.approx(1)
    for state in [*vocab, " "]:
        assert sum(weight(state, w) for w in [*uni, "zzz"]) == pytest.approx(1)
    # the arcs out of "a" as the operator walks them: score("a w") less that of "a" up to its end and of "w" to its end
    to_a, arcs = weight(" ", "a"), {}
    assert 10 ** got[held[0]] == pytest.approx(to_a * weight("a", " "), rel=1e-5)
    for i, w in zip(held[1:], ends, strict=False):
        arcs[w] = 10 ** got[i] / to_a / weight(w, " ")
    assert sum(arcs.values()) + weight("a", " ") == pytest.approx(1, rel=1e-5)


def test_backing_off_is_not_interpolating(spark):
    """A seen bigram does not get the root's share too, and an unseen one gets more than interpolation gives."""
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:6]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [*[(i, t) for i, t in zip(train, ["a b", "a b", "a b", "a b", "c d", "c d"], strict=True)],
            (held[0], "a b"), (held[1], "a d")]
    got = {r.doc_id: r.score for r in ngram_lm.lm_scores(
        spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()}
    d = ngram_lm.DISCOUNT
    uni, p, weight = model([t for i, t in rows if i in train])
    assert weight("a", "b") == (4 - d) / 4
    assert 10 ** got[held[0]] == pytest.approx(weight(" ", "a") * (4 - d) / 4 * weight("b", " "), rel=1e-5)
    left = d * 1 / 4
    assert 10 ** got[held[1]] == pytest.approx(weight(" ", "a") * left / (1 - p("b")) * p("d") * weight("d", " "), rel=1e-5)
    assert left / (1 - p("b")) * p("d") > 1.2 * left * p("d")


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = ngram_lm.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert row[0] / row[2] > row[1] / row[2] + 0.1


def test_no_row_for_an_empty_bucket(spark):
    """1000 buckets, few words: rows sent never exceed distinct keys, and totals cover all buckets."""
    table = pa.table({"doc_id": [1, 2], "text": ["a b a", "b"]})
    sent = ngram_lm._ask(1000)([pa.scalar(0)], table)
    assert sent.num_rows <= 3 + 6  # words and bigrams
    assert sum(len(exchange.unsteps(b.as_py())) for b in sent.column("words")) == 3


def test_no_training_text_at_all(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    docs = spark.createDataFrame([(held[0], "a b", "", ""), (held[1], None, "", "")], SCHEMA)
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.lm_scores(docs).collect()] == [(0, 0, 0, 0)] * 2


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (exchange.unsteps(exchange.steps(keys)) == keys).all()
    edge = exchange.bucket_edges(keys, 7)
    assert edge[0] == 0 and edge[-1] == len(keys) and (np.diff(edge) > 0).all()
    assert len(exchange.unsteps(exchange.steps(keys[:0]))) == 0
