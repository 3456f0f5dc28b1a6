"""The corpus pipeline: contract of the stages and the whole run against single steps."""

import corpus_pipeline as P
from conftest import SF_CHECK, SF_SMALL
from test_decontamination import brute as overlap
from test_simhash import brute_roots, plain_fingerprint


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "simhash", "decontamination", "packing"]


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), docs.schema)
        after = {r["doc_id"] for r in docs.collect()}
        gone = [r for r in before if r["doc_id"] not in after]
        if name == "language":
            assert not [r for r in gone if len(r["text"] or "") > 40]
        if name == "simhash":
            assert len(after) == len(set(brute_roots([plain_fingerprint(r["text"]) for r in before], 3)))
        if name == "decontamination":
            longest = [i for i in items if len(i.split()) < 25][:6]
            for r in [x for x in before if len(x["text"]) < 1500][:40]:
                assert not (r["doc_id"] in after and any(overlap(r["text"], i) for i in longest))
    pieces = P.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {p["doc_id"] for p in pieces} == after


def test_run_keeps_clean_documents_and_drops_toxic_ones(spark):
    got = {r["doc_id"] for r in P.run(spark, SF_CHECK).select("doc_id").distinct().collect()}
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    # a third of the labelled ones hold no word that tells them from clean documents
    assert len(got & toxic) <= 0.4 * len(toxic) and len(got) > 750


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), docs.schema)
    assert P.STAGES[-1][1](spark, docs, SF_SMALL).count() == 0
