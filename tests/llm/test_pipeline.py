"""The pipeline's stages one by one, each against what its input says, and the driver contract without the subpackage."""

import os
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from mercato.llm import pieces, toxicity
from mercato.llm.common import read
from tests.llm.test_dedup import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = read(spark, SF, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash", "mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_of_documents_until_the_last(staged):
    assert all(s.columns == staged[0].columns for s in staged[:-1])


def test_each_stage_against_its_input(spark, staged):
    docs, clean, exact, near, mix, ids = ([r.asDict() for r in s.collect()] for s in staged)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(staged[0], read(spark, SF, "labels")).collect()}
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in docs if not scores[r["doc_id"]])
    groups = {}
    for r in clean:
        key = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
        best = (-len(r["text"] or ""), r["doc_id"])
        groups[key] = min(groups.get(key, best), best)
    assert sorted(r["doc_id"] for r in exact) == sorted(i for _, i in groups.values())
    comp = brute_components([(r["doc_id"], r["text"]) for r in exact], 5)
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, (_, c) in comp.items() if i == c)
    times = Counter(r["doc_id"] for r in mix)
    assert set(times) <= {r["doc_id"] for r in near} and max(times.values()) <= 3
    assert {r["doc_id"]: r for r in mix} == {r["doc_id"]: r for r in near if r["doc_id"] in times}
    assert Counter(r["doc_id"] for r in ids) == times and all(r["round_trip"] for r in ids)
    texts = {r["doc_id"]: r["text"] for r in mix}
    assert {r.doc_id: r.text for r in pieces.decode(staged[-1]).collect()} == texts


def test_run_agrees_with_itself(spark, staged):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_pieces").collect())
    assert got == sorted(tuple(r) for r in staged[-1].select("doc_id", "n_pieces").collect())


def test_stages_with_odd_rows(spark):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, "
              "size long, copies int, block int, h string, ids string")
    odd = [(1, None), (1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "x y z"), (None, "x y z"),
           (4, "w " * 30_000), (5, "a  b c d e f")]
    docs = spark.createDataFrame([(i, t, None, "s" if i else None, None, None, None, None, None, None, None, None) for i, t in odd],
                                 schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs, SF).count() >= 1
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(odd)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, None), (4, "w " * 30_000), (5, "a  b c d e f"), (None, "x y z")], key=str)


def test_entry_without_the_subpackage(tmp_path):
    """With corpus_pipeline and the subpackage out of reach the entry still imports, with the other queries only."""
    code = ("import sys; sys.modules['mercato.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e\nq = e.queries()\n"
            "assert len(q) > 90 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)\n"
            "assert set(e.oracle_sql()) <= set(q)")
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
