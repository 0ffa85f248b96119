"""Toxicity: held-out accuracy on planted wording, and the defined edge cases."""

import random
import zlib

import pytest

from mercato.llm import toxicity

DOCS = "doc_id long, text string, score string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    bad = ["grumblefrotz", "vexwarble", "snidlock", "krangwit"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * (2 + len(words) // 30)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((2**60 + i, " ".join(words), "x", None))
        labels.append((2**60 + i, 1, toxic))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_reruns(planted):
    docs, labels = planted
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sorted(got) == sorted(toxicity.toxicity_scores(docs, labels).collect())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)


def test_held_out_labels_are_not_read(planted, spark):
    docs, labels = planted
    flipped = spark.createDataFrame(
        [(r.doc_id, 1, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels.collect()],
        labels.schema)
    assert sorted(toxicity.toxicity_scores(docs, labels).collect()) == sorted(
        toxicity.toxicity_scores(docs, flipped).collect())


def test_edge_cases(planted, spark):
    docs, labels = planted
    odd = spark.createDataFrame([(None, None, None, None), (1, "", None, 1), (2, "x" * 100_000, None, 1),
                                 (3, "vexwarble krangwit snidlock", None, 1), (3, "vexwarble krangwit snidlock", None, 1)], DOCS)
    got = toxicity.toxicity_scores(docs.union(odd), labels).where("doc_id < 10 or doc_id is null").collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (None, 1)}) == 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and all(r.predicted for r in got if r.doc_id == 3)
    none = toxicity.toxicity_scores(odd, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels.limit(0)).collect() == []
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == 5


def test_sampled_classes_keep_their_proportion(spark, monkeypatch):
    """Of the documents with the word 120 are toxic; a sample that cuts only the ordinary class must not raise their score."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    docs, labels, marked = [], [], set()
    for i in range(3000):
        toxic = int(i % 25 == 0)
        words = [rng.choice(vocab) for _ in range(30)]
        if toxic or rng.random() < 0.06:
            words[rng.randrange(30)] = "snidlock"
            marked.add(i)
        docs.append((i, " ".join(words), "x", None))
        labels.append((i, 1, toxic))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for most in (toxicity.TRAIN_DOCS, 200):
        monkeypatch.setattr(toxicity, "TRAIN_DOCS", most)
        got = [r for r in toxicity.toxicity_scores(docs, labels).collect() if r.doc_id in marked]
        assert abs(sum(r.score for r in got) / len(got) - 120 / len(got)) < 0.12  # with classes cut unevenly: over 0.3 off


def test_nothing_fitted_drops_nothing(planted):
    docs, labels = planted
    assert toxicity.drop_toxic(docs, labels.where("toxic = 1")).count() == docs.count()
