"""Exact dedup and MinHash near-dedup against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mercato.llm import exact_dedup, minhash
from mercato.llm.common import shingle_set, word_list
from mercato.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, None, "x") for i, t in rows], SCHEMA)


def word_shingles(text, k):
    w = word_list(text or "")
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute_components(docs, k, percent=80):
    """Smallest id reachable, from all pairs that share a shingle."""
    sets = {i: word_shingles(t, k) for i, t in docs}
    by, parent = defaultdict(set), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    for i, s in sets.items():
        share = defaultdict(int)
        for g in s:
            for j in by[g]:
                share[j] += 1
        for j, n in share.items():
            if j != i and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_of(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(df, **kw).collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_equal_brute_force(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert near_of(docs, k=k) == brute_components([(r.doc_id, r.text) for r in docs.collect()], k)


def test_near_links_missed_by_the_star_are_found(spark):
    """Chains of texts around one base: members of a bucket are similar to each other but not to its smallest id."""
    rng = random.Random(5)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice((0, 2, 4, 6, 8, 10))):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert near_of(frame(spark, rows), k=2) == brute_components(rows, 2)


def test_near_edge_cases(spark):
    rows = [(1, "A  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "ONE"), (8, "two"),
            (None, "a b c"), (None, "lone text here"), (9, "É b"), (10, "é b"), (11, "x y " * 50_000),
            (12, "x y " * 40_000), (2, "a b c")]
    got = sorted(minhash.near_groups(frame(spark, rows), k=2).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None] == [
        (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
        (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 10, True), (11, 2, 11, True),
        (12, 2, 11, False)]
    assert sorted((r.n_shingles, r.component_id or 0) for r in got if r.doc_id is None) == [(2, 0), (2, 1)]
    assert minhash.near_groups(frame(spark, []), k=2).collect() == []
    kept = minhash.keep_near(frame(spark, rows), k=2)
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 8, 9, 10, 11]


def test_signature_agreement_estimates_similarity():
    from mercato.llm.common import WordHashes

    h = WordHashes()
    a = shingle_set(h.of([b"%d" % i for i in range(1000)]), 1)
    b = shingle_set(h.of([b"%d" % i for i in range(111, 1111)]), 1)  # similarity 0.8
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 0.8) < 0.15
    one = shingle_set(h.of([b"one"]), 1)
    assert len(set(minhash.signature(one).tolist())) == 1


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 7), (60, 61), (61, 62), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(51), 0), 100: 0, 60: 60, 61: 60, 62: 60}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")]
        keep = min(g)[2] if min(g)[2] is not None else None
        out.append((i, keep, len(g), i == keep))
    return sorted(out, key=str)


EXACT_ROWS = [(5, "a b"), (3, "ab"), (4, "a  b"), (2, None), (1, ""), (6, " "), (7, "x"), (7, "x"), (None, "x y"),
              (None, "xy"), (8, "é"), (None, "ab"), (9, "long " * 100_000), (10, "long " * 100_000 + "!")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """With a constant hash every text collides; the bytes still tell them apart."""
    kw = {"hash_of": lambda c: F.lit(b"0")} if weak else {}
    got = exact_dedup.exact_groups(frame(spark, EXACT_ROWS), **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == exact_brute(EXACT_ROWS)


def test_keep_exact(spark):
    kept = exact_dedup.keep_exact(frame(spark, EXACT_ROWS))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in kept.collect()) == [
        (-1, 3), (1, 0), (4, 4), (6, 1), (7, 1), (8, 1), (9, 500_000), (10, 500_001)]
    assert exact_dedup.keep_exact(frame(spark, [])).collect() == []


def test_small_families_near_the_similarity(spark):
    """Pairs that share few bands: their bucket may hold just the two, while both met other centers more often."""
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(10):
            words = list(base)
            for at in rng.sample(range(120), rng.choice((3, 4))):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    assert near_of(frame(spark, rows), k=2) == brute_components(rows, 2)


def test_texts_that_share_an_id_or_have_none_are_not_lost(spark):
    """Each (id, text) is a document of its own, through both dedups."""
    rng = random.Random(13)
    text = lambda seed, edits=0: " ".join(
        f"w{seed}x{i}" if i >= edits else f"e{rng.randrange(10**6)}" for i in range(150))
    rows = [(3, text(1)), (7, text(1, 3)), (7, text(2)), (9, text(3)), (7, text(4)), (9, text(4, 2)), (None, text(5)),
            (None, text(5, 2)), (None, text(6)), (None, text(3, 2)), (12, text(6, 3)), (12, text(7)), (7, text(2)), (1, ""), (1, None)]
    # brute force over distinct (id, text), ids beyond all others for those that share or lack one
    distinct = list(dict.fromkeys((i, t or "") for i, t in rows))
    comp = brute_components(list(enumerate(t for _, t in distinct)), 2)
    least = {}
    for n, (i, _) in enumerate(distinct):
        c = comp[n][1]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted(((i, comp[distinct.index((i, t or ""))][0], least[comp[distinct.index((i, t or ""))][1]]) for i, t in rows), key=str)
    got = minhash.near_groups(frame(spark, rows), k=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)

    kept = {(r.doc_id, r.text or "") for r in minhash.keep_near(frame(spark, rows), k=2).collect()}
    groups = defaultdict(set)
    for n, d in enumerate(distinct):
        groups[comp[n][1]].add(d)
    assert all(len(g & kept) == 1 for g in groups.values()) and kept <= set(distinct)

    kept = [(r.doc_id, r.text or "") for r in exact_dedup.keep_exact(frame(spark, rows)).collect()]
    assert len(kept) == len({t for _, t in distinct}) and {t for _, t in kept} == {t for _, t in distinct}
    assert set(kept) <= set(distinct)


def test_own_ids_at_the_ends_of_long(spark):
    for big in (2**63 - 1, -2**63, 5):
        rows = [(big, "a b c"), (big, "d e f"), (None, "g h"), (None, "g h"), (4, "x")]
        got = minhash.own_ids(frame(spark, rows))[0].select("doc_id", "text", "__own").collect()
        assert len({r["__own"] for r in got}) == 4 and {r["__own"] for r in got if r.doc_id == 4} == {4}
