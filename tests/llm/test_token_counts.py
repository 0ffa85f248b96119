"""Token counts against the library's own encoding, over odd, random, very long and all given texts."""

import random
import time

import pytest

from mercato.llm import pieces, token_counts

sentencepiece = pytest.importorskip("sentencepiece")

ODD = ["", " ", "  ", "a", " a", "a ", "a  b\n\tc ", "▁ literal ▁▁mark", "<s>a</s><unk><0x0A>", "\U0001f600 emoji \t\r\n",
       "Ünïcödé straße 漢字かな", "\x00 control \x01", "x" + " " * 5000 + "y", "�", "ａｂ ﬁ é", "1234567890 3.14", "​  　 "]


@pytest.fixture(scope="module")
def merges():
    with open(pieces.MODEL, "rb") as f:
        return token_counts.Merges(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_odd_texts(merges, library):
    assert [merges.of_text(t) for t in ODD] == [len(library.encode(t)) for t in ODD]


def test_random_texts(merges, library):
    rng = random.Random(5)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    for _ in range(600):
        kind = rng.random()
        if kind < 0.4:
            text = "".join(rng.choice(names).replace("▁", " ") for _ in range(rng.randint(1, 40)))
        elif kind < 0.8:
            text = "".join(rng.choice("aeinorst  lhdu.,'-") for _ in range(rng.randint(1, 120)))
        else:
            text = "".join(chr(rng.choice((rng.randint(1, 0x24F), rng.randint(0x2500, 0x2600), rng.randint(0x4E00, 0x9FFF), 32)))
                           for _ in range(rng.randint(1, 60)))
        assert merges.of_text(text) == len(library.encode(text)), text


def test_one_word_of_a_million_characters(merges, library):
    rng = random.Random(6)
    for text in ("a" * 300_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "0123456789" * 100_000):
        began = time.time()
        n = merges.of_text(text)
        assert time.time() - began < 60
        assert n == len(library.encode(text))
    assert all(len(w) < merges.counts.limit // 100 for w in merges.counts)  # such words aren't kept


def test_dropping_the_cache_changes_nothing(merges, library):
    with open(pieces.MODEL, "rb") as f:
        small = token_counts.Merges(f.read(), limit=30_000)
    texts = [" ".join(f"word{i}x{i * i}" for i in range(k, k + 500)) for k in range(5)] + ODD
    assert [small.of_text(t) for t in texts] == [len(library.encode(t)) for t in texts]
    assert sum(4 * len(w) + 120 for w in small.counts) <= 30_000


def test_no_merge_reaches_across_the_first_cuts(merges, library):
    for a in sorted(merges.side_by_side)[::40]:
        for b in ("x", ".", "1", "", "▁", "é", "'"):
            for text in (a + b, b + a, a + b + a):
                assert merges.of_text(text) == len(library.encode(text)), text


def test_refuses_other_models():
    with pytest.raises(ValueError):
        token_counts.Merges(b"")


def test_frame(spark, library):
    schema = "doc_id long, text string, n_tokens int, n_bytes string"
    rows = [(i, t, None, "x") for i, t in enumerate(ODD)] + [(100, None, 1, None), (None, "no id", 1, None), (3, ODD[3], 0, None)]
    docs = spark.createDataFrame(rows, schema)
    got = token_counts.token_counts(docs, limit=3)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 3) for i, t, _, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 4096)
