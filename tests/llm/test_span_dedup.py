"""Substring dedup against a plain dictionary of runs."""

import random

import numpy as np
import pytest

from mercato.llm import exchange, span_dedup

SCHEMA = "doc_id long, text string, block string, one int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)


def brute(rows):
    docs = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    where = {}
    for d, (_, t) in enumerate(docs):
        full = [(k, p.encode().lower().split()) for k, p in enumerate(span_dedup.sentences(t)) if p.encode().split()]
        spans = set()
        for a in range(len(full)):
            for b in range(a + span_dedup.RUN_SENTENCES, len(full) + 1):
                if sum(len(w) for _, w in full[a:b]) >= span_dedup.RUN_WORDS:
                    spans.add((a, b))
                    break
        for b in range(len(full), 0, -1):
            for a in range(b - span_dedup.RUN_SENTENCES, -1, -1):
                if sum(len(w) for _, w in full[a:b]) >= span_dedup.RUN_WORDS:
                    spans.add((a, b))
                    break
        for a, b in sorted(spans):
            where.setdefault(tuple(b" ".join(w) for _, w in full[a:b]), []).append((d, full[a][0], full[b - 1][0] + 1))
    gone = [set() for _ in docs]
    for spots in where.values():
        for d, s, e in sorted(spots)[1:]:
            gone[d].update(range(s, e))
    out = []
    for (i, t), g in zip(docs, gone, strict=True):
        p = span_dedup.sentences(t)
        out.append((i, len(p), len(g), "".join(x for k, x in enumerate(p) if k not in g)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in span_dedup.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("each", [6_000_000, 30_000])
def test_equals_brute_force(spark, monkeypatch, each):
    monkeypatch.setattr(exchange.blocked, "__defaults__", (each,))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_planted_passage_goes_and_clean_text_stays(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + ". "
    passage = "".join(sentence(rng.randint(4, 14)) for _ in range(8))
    rows = [(i, "".join(sentence(9) for _ in range(6)) + passage.upper() * (i % 2) + passage * (1 - i % 2) + sentence(30)) for i in range(20)]
    got = found(frame(spark, rows))
    assert got == brute(rows)
    for i, _, removed, text in got:
        assert (removed > 0) == (i > 0)
        assert text == rows[i][1] if i == 0 else text == rows[i][1].replace(passage, "").replace(passage.upper(), "")


def test_sentences_make_up_the_text():
    for t in ("", "a", "A b. C d!  \nE\n\n f?", "w " * 100, " lead " + "w " * 40 + ". x", "\n\n", "a.b.c. d"):
        assert "".join(span_dedup.sentences(t)) == t


def test_edge_cases(spark):
    long = "Some words here stand. " * 20_000
    copy = "One two three four five six seven. Eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen " \
           "eighteen. Nineteen twenty twenty-one."
    rows = [(1, None), (2, ""), (3, "One."), (4, long), (None, copy), (5, copy), (5, copy), (None, copy), (6, "\n" + copy), (7, " . ")]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []


def test_passages_planted_in_mid_sentence_go(spark):
    """No sentence ends and every offset: read from the raw text, not from sentences()."""
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    passage = some(60)
    rows = [(i, " ".join(some(40 + i) + passage + some(50))) for i in range(32)]
    left = [r[3].split() for r in sorted(found(frame(spark, rows)))]
    assert left[0] == rows[0][1].split()
    runs = {tuple(passage[k:k + 30]) for k in range(31)}
    assert not [i for i, w in enumerate(left) if i and any(tuple(w[k:k + 30]) in runs for k in range(len(w)))]
    assert all(len(w) >= 90 + i for i, w in enumerate(left))


def test_packed_rows_are_no_more_than_runs(spark, monkeypatch):
    """A thousand tiny blocks: a block sends no row to a bucket it has nothing for."""
    sent = spark.sparkContext.accumulator(0)
    asked = exchange.ask_and_answer

    def counting(docs, buckets, ask, *rest):
        def ask_counted(table):
            out = ask(table)
            sent.add(len(out[0]))
            return out

        return asked(docs, buckets, ask_counted, *rest)

    monkeypatch.setattr(span_dedup, "ask_and_answer", counting)
    monkeypatch.setattr(exchange.blocked, "__defaults__", (200,))
    rows = [(i, f"Sentence {i} has words. " + "Another one has some more words in it for a run of twenty. " * 2) for i in range(1000)]
    assert found(frame(spark, rows)) == brute(rows)
    runs = sum(len(span_dedup.runs(span_dedup.Sentences([t.encode()]))[0]) for _, t in rows)
    assert 0 < sent.value <= 2 * runs  # each block asks at most twice: once in each plan of the shuffle


def test_sentences_over_many_texts_are_those_of_each():
    texts = ["", " ", "a", "\n\n", "A b. C d!  \nE\n\n f?", " x y", "\n lead. z", "w " * 100, "é ü. " * 5, "...", ". . ."]
    s = span_dedup.Sentences([t.encode() for t in texts])
    for d, t in enumerate(texts):
        own = span_dedup.sentences(t)
        assert len(own) == s.of_doc[d + 1] - s.of_doc[d] + s.lead[d], t
        assert s.kept(np.zeros(s.n, bool), d).decode() == t
