"""The manifest against trees built in one list, over several heights, and against the oracle."""

import random
import zlib
from hashlib import sha256

import pytest

from mercato.llm import merkle
from tests.conftest import SF_SMALL
from tools.oracle_check import duck_con

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def h(s):
    return sha256(s.encode()).hexdigest()


def encoded(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """Levels of a tree from its leaves."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h("".join(rows[-1][i:i + 16])) for i in range(0, len(rows[-1]), 16)])
    return rows


def path(rows, i):
    for row in rows[:-1]:
        run = row[i // 16 * 16:i // 16 * 16 + 16]
        yield run[:i % 16], run[i % 16 + 1:]
        i //= 16


def brute(rows):
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(encoded([doc_id, source, lang, n_chars, text]))
        other = leaf
        if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0 and text is not None:
            other = h(encoded([doc_id, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)]))
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, other))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, (_, _, leaf, doc_id, other) in enumerate(sorted(by[s])):
            steps = [*path(trees[s], i), *path(top, place)]
            folded = other
            for left, right in steps:
                folded = h("".join([*left, folded, *right]))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in steps)), folded,
                        folded == top[-1][0]))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return [tuple(r) for r in merkle.manifest(df, **kw).collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def made(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        rows += [(rng.randint(0, 10**6), f"Text {rng.random()}", "en", s, 7) for _ in range(n)]
    rng.shuffle(rows)
    return rows


def test_heights(spark, monkeypatch):
    """Partitions of 16 leaves, so that sources take up to three rounds, with short last subtrees."""
    monkeypatch.setattr(merkle, "SORTED_ROWS", 500)
    rows = made({None: 1, "": 2, "a": 15, "b": 16, "c": 17, "d": 256, "e": 257, "é": 300, "z": 4097 + 16 * 3, "y": 16 * 16 * 7 + 5})
    got = found(spark, rows, levels=1)
    same(got, brute(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_many_sources(spark):
    """The tree over the sources takes rounds too."""
    rows = made({f"host{i}": 1 + i % 3 for i in range(600)})
    same(found(spark, rows, levels=1), brute(rows))


@pytest.mark.parametrize("rows", [
    [(5, "ABC", "en", "s", 3)],
    [(None, None, None, None, None)],
    [(None, "x", None, "s", 1), (None, "X", None, "s", 1), (1, None, "en", None, 0), (1, "", "en", None, 0), (1, "", "en", "", 0)],
    [(7, "Same", "en", "s", 4)] * 40 + [(7, "other", "en", "s", 5)] * 3,
    [(i, "É" * 100_000 + "A", "fr", "s", None) for i in range(5)],
])
def test_edge_cases(spark, rows):
    same(found(spark, rows), brute(rows))
    same(found(spark, rows, levels=1), brute(rows))


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents_and_oracle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    same([tuple(r) for r in merkle.manifest(docs).collect()], want)
    same(duck_con(SF_SMALL).execute(merkle.MERKLE_SQL).fetchall(), want)
