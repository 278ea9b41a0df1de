"""The registered queries against their SQL, and the pipeline against a plain version."""

import collections

import pytest
from conftest import SF001, SF01
from oracle import compare

import corpus_pipeline
from notewise.llm import catalog, near_text, quality, staging, toxicity

QUERIES, ORACLES = catalog.load()


def test_one_query_per_operator():
    import __spark_entry__
    numbers = collections.Counter(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == {n: 1 for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck01, name):
    problems, n, _ = compare(QUERIES[name](spark, SF01), ORACLES[name], duck01)
    assert not problems and n, problems


def test_pipeline_stages(spark):
    docs = staging.read_table(spark, SF001, "documents")
    labels = staging.read_table(spark, SF001, "labels")
    kept = {r.doc_id for r in quality.classify(docs, labels.where("quality = 1").select("doc_id")).collect() if r.kept}
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, now = now, staging.staged(stage(spark, now, SF001), "t")
        assert now.columns == docs.columns
        ids = {r.doc_id for r in now.collect()}
        if k == 0:
            assert ids == kept
        elif k == 1:
            known = labels.selectExpr("doc_id", "toxic as y")
            model = toxicity.fit(staging.id_and_text(before, "doc_id", "text"), known)
            scored = toxicity.score(staging.id_and_text(before, "doc_id", "text"), model)
            assert ids == {r.doc_id for r in scored.collect() if r.score < 0.5}
        else:
            assert ids == {r.doc_id for r in near_text.near_duplicates(before).collect() if r.kept}
    pieces = corpus_pipeline.run(spark, SF001)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids
