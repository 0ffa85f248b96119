"""Pieces: exact round trips, the best segmentation against trying all, and against the library's own lattice."""

import random

import pytest

from mercato.llm import pieces

ODD = ["", " ", "  hello  world\n x", "▁ literal ▁▁mark", " private", "\U0001f600 emoji \t\r\n", "a" * 30_000,
       "Ünïcödé straße 漢字かな", "\x00 control \x01", "trailing ", "x" + " " * 5000 + "y", "�"]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def score(model, word, ids):
    total = 0.0
    scores = {e[1]: e[0] for e in model.ends if e}
    run = bytearray()
    for i in ids:
        if i in model.value:
            run.append(model.value[i])
        else:
            total += scores[i]
    return total + model.unknown * len(run.decode())


def every(model, word):
    """The best score over all segmentations."""
    scores = {model.names[e[1]]: e[0] for e in model.ends if e}
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            s = scores.get(word[start:end])
            if s is not None:
                best[end] = max(best[end], best[start] + s)
        best[end] = max(best[end], best[end - 1] + model.unknown)
    return best[-1]


def test_round_trip(model):
    ids, exact = model.encode_batch(ODD)
    assert all(exact) and [model.decode(x.tolist()) for x in ids] == ODD


def test_best_score_of_all_segmentations(model):
    rng = random.Random(3)
    words = [pieces.MARK * rng.randint(0, 3) + "".join(rng.choice("abcdeinorstth éß漢") for _ in range(rng.randint(1, 14))).replace(" ", "")
             for _ in range(400)]
    model.known.clear()
    model.learn(words)
    for w in words:
        assert score(model, w, model.known[w]) == pytest.approx(every(model, w))


def test_shared_prefixes_change_nothing(model):
    words = ["then", "the", "there", "them", "theme", "other", "otherwise"]
    model.known.clear()
    model.learn(words)
    together = dict(model.known)
    for w in words:
        model.known.clear()
        model.learn([w])
        assert model.known[w] == together[w]


def test_equals_library_lattice(model):
    """The same pieces and scores in the library, switched to its unigram search."""
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["The quick brown fox jumps over the lazy dog", "Geheit ungkeit schlich", "a  b   c", "émentelle tion"]
    scores = {e[1]: e[0] for e in model.ends if e}
    for t, ids in zip(texts, model.encode_batch(texts)[0], strict=True):
        theirs = lib.encode(t)
        assert sum(scores[i] for i in ids if i in scores) == pytest.approx(sum(scores[i] for i in theirs if i in scores))


def test_encode_and_decode_frames(spark):
    schema = "doc_id long, text string, ids string, n_pieces int"
    rows = [(i, t, None, 0) for i, t in enumerate(ODD)] + [(100, None, None, 0), (None, "no id", None, 0), (3, ODD[3], None, 0)]
    docs = spark.createDataFrame(rows, schema)
    got = pieces.encode(docs)
    out = got.collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_pieces == len(r.ids) for r in out)
    back = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert back == {i: t or "" for i, t, _, _ in rows}
    assert pieces.encode(docs.limit(0)).collect() == []
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in real.collect()}
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(real)).collect()} == texts
