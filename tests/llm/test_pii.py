"""PII: base spans against the plain patterns, the field against all segmentations, and what it adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from mercato.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = {k: [] for k in PLAIN}
    for k, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or k == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits) or k == "phone" and 9 <= len(digits) <= 15):
                out[k].append(m.span())
    return out


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(2)
    odd = ["".join(rng.choice("a1@.-+ ()%_2é5\n0") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    odd += ["a@b.c@d.e", "@a.b", "x@y", "1.2.3.4.5.6.7.8", "0001.02.255.256", "4111-1111 1111 1111", "+1 (974) 555-3436 9"]
    odd += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t in odd:
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(t)


def test_field_equals_all_segmentations():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 6))
        segs = [(s, e, []) for s in range(n) for e in range(s + 1, n + 1) if rng.random() < 0.6]
        if not segs:
            continue
        scores = rng.normal(size=(len(segs), len(pii.KINDS)))
        every = []
        for r in range(len(segs) + 1):
            for xs in itertools.combinations(range(len(segs)), r):
                if all(segs[a][1] <= segs[b][0] or segs[b][1] <= segs[a][0] for a, b in itertools.combinations(xs, 2)):
                    every += [tuple(zip(xs, ks, strict=True)) for ks in itertools.product(range(len(pii.KINDS)), repeat=r)]
        weight = np.array([np.exp(sum(scores[x, k] for x, k in c)) for c in every])
        want = np.zeros_like(scores)
        for c, w in zip(every, weight / weight.sum(), strict=True):
            for x, k in c:
                want[x, k] += w
        field = pii.Field({})
        assert field.expectations(n, segs, scores) == pytest.approx(want)
        best = max(sum(scores[x, k] - pii.ODDS for x, k in c) for c in every)
        index = {(s, e): x for x, (s, e, _) in enumerate(segs)}
        assert sum(scores[index[s, e], k] - pii.ODDS for s, e, k in field.best(n, segs, scores)) == pytest.approx(best)


SCHEMA = "doc_id long, text string, spans string, n_email int"


def test_personal_data(spark):
    rng = random.Random(4)
    rows = [(i, f"Call me on +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or write a{i}.b@mail{i % 9}.example.com, "
                f"host 10.{i % 250}.3.{i % 200}. Nothing in {rng.randint(10**8, 10**9)} here.") for i in range(300)]
    rows += [(1000, "Call (974) 555-3436 now"), (1001, "clean words only"), (1002, None), (1003, ""), (None, "x@y.org"),
             (1002, None), (1004, "z" * 100_000 + " 1.2.3.4"), (1005, "number 473696257, year 2021, 12:30")]
    got = pii.personal_data(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows}
    for r in got:
        base = plain(text[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in base[k])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    by = {r.doc_id: r.spans for r in got}
    assert by[1000] == "phone:5:19"  # no country code: the field knows the shape
    assert by[1001] == by[1002] == by[1003] == by[1005] == ""
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
