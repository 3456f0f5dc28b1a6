"""Cross-parsing against a plain greedy parse, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_CHECK
from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import langid as L


def plain_phrases(text, train):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at:at + k + 1] in train:
            k += 1
        n, at = n + 1, at + k
    return n


def test_phrases_equal_a_greedy_parse():
    rng = random.Random(2)
    make = lambda letters, n: bytes(rng.choices(letters, k=n))
    samples = (("a", make(b"abc ", 300)), ("b", make(b"bcd ", 500)))
    parser = L.CrossParser(samples)
    texts = [make(b"abcd ", n) for n in (1, 2, 17, 400)] + [b"", b"zzz", "é".encode() * 5]
    got = parser.phrases(texts)
    assert got.tolist() == [[plain_phrases(t, train) for t in texts] for _, train in samples]


def test_long_texts_end_a_phrase_at_each_segment():
    samples = (("a", b"the quick brown fox jumps over the lazy dog " * 3),)
    text = b"the lazy fox " * 1000
    parts = [text[i:i + L.SEGMENT] for i in range(0, len(text), L.SEGMENT)]
    assert L.CrossParser(samples).phrases([text])[0, 0] == sum(plain_phrases(p, samples[0][1]) for p in parts)


def test_edge_rows(spark, docs_of):
    samples = (("xx", b"the cat sat on the mat and the dog "), ("yy", b"der hund und die katze auf der matte "))
    docs = docs_of([(1, None), (2, ""), (3, "123 ... \n"), (4, "The CAT!"), (5, "Die Katze"), (6, "日本"), (None, "the the")]).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in L.identify(docs, samples).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, None)] == ["und"] * 3 + ["xx", "yy", "xx"]
    assert got[1]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[6]["lang_pred"] == "xx" and got[6]["phrases_per_byte"] > L.STRANGE  # a tie: the first language
    assert {r["lang_pred"] for r in L.identify(docs, ()).collect()} == {"und"}
    assert L.identify(docs.limit(0), samples).count() == 0


def test_learning_needs_text_and_label(spark, docs_of):
    assert L.learn(docs_of([])) == ()
    assert L.learn(docs_of([(1, None), (2, "abc", None), (3, "12", "zz")])) == ()
    assert [x for x, _ in L.learn(docs_of([(1, "only this one"), (1, "only this one")]))] == ["en"]


def test_copies_long_and_letterless_texts_leave_no_language_out(spark, docs_of):
    copies = [(i, f"kopie nummer {'abcde'[i % 5]} van de tekst", "nl") for i in range(4000)]
    long = [(i, "12 " * L.SAMPLE_DOC_CHARS + "der lange text " * 2000 + "abcdefgh"[i % 8], "de") for i in range(8)]
    digits = [(i, str(i), "fi") for i in range(4000)] + [(1, "ainoa kirjain", "fi")]
    samples = dict(L.learn(docs_of(copies + long + digits)))
    assert sorted(samples) == ["de", "fi", "nl"]
    assert all(f"nummer {c} van".encode() in samples["nl"] for c in "abcde")  # as a table of the five texts alone
    assert samples["de"].startswith(b"der lange text") and samples["fi"] == b"ainoa kirjain"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    samples = L.learn(L.training_rows(docs))
    assert all(len(t) <= L.SAMPLE_BYTES for _, t in samples)
    rows = L.op3_language_id(spark, SF_CHECK).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in rows])
    assert len(rows) > 100 and right >= 0.97
