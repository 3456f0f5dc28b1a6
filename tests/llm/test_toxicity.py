"""The conditional random field: messages against enumeration, learning, edge rows."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_CHECK
from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import toxicity as X


def enumerated(emission, trans):
    """Marginals and expected transitions of a short chain by all taggings."""
    n, total, node, pair = len(emission), 0.0, np.zeros(len(emission)), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(e for e, t in zip(emission, tags) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
        total += w
        node += w * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            pair[a, b] += w
    return node / total, pair / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(2, 2))
    lengths = np.array([3, 0, 7, 1, 7])
    emission = rng.normal(size=lengths.sum())
    got = X.Field(np.zeros(4), trans, np.zeros(3)).marginals(lengths, emission)
    want = [enumerated(e, trans)[0] for e in np.split(emission, np.cumsum(lengths)[:-1])]
    assert np.allclose(got, np.concatenate(want))


def test_expectations_equal_enumeration():
    rng = np.random.default_rng(2)
    trans, emission = rng.normal(size=(2, 2)), rng.normal(size=(2, 5))
    live = np.array([[True] * 5, [True] * 3 + [False] * 2])
    node, pair = X._expected(emission, trans, live)
    first, second = enumerated(emission[0], trans), enumerated(emission[1, :3], trans)
    assert np.allclose(node[0], first[0]) and np.allclose(node[1, :3], second[0])
    assert np.allclose(pair, first[1] + second[1])


def texts(rng, n, bad=()):
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ane", "oru", "ite", "ulo", "esa")]
    out = []
    for _ in range(n):
        w = rng.choices(words, k=rng.randint(20, 60))
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append(" ".join(w))
    return out


def test_learns_spans_from_document_labels():
    rng = random.Random(3)
    model = X.fit(texts(rng, 60, ["Zurkle", "vexnop", "gribbet"]), texts(rng, 120))
    held_bad, held_good = texts(rng, 30, ["zurkle", "vexnop", "gribbet"]), texts(rng, 60)
    assert X.fit(held_bad, []) is None and X.fit([], held_good) is None and X.fit(held_good[:30], held_good[30:]) is None
    got = model.score(held_bad + held_good)
    assert got["predicted"].tolist() == [1] * 30 + [0] * 60
    found = {t[s["start"]:s["end"]].lower() for t, spans in zip(held_bad, got["spans"]) for s in spans}
    assert found == {"zurkle", "vexnop", "gribbet"} and not any(got["spans"][30:])
    empty = model.score([None, "", " ... ", "é" * 10])
    assert empty["predicted"].tolist() == [0] * 4 and empty["score"].between(0, 1).all()
    long = model.score(["bane " * 30000 + "zurkle"])
    assert long["predicted"][0] == 1 and long["spans"][0][0]["start"] == 150000


def test_edge_tables(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    docs = docs_of([(1, "a b"), (None, None), (1, "a b")]).withColumn("score", F.lit("clash"))
    assert X.learn(docs, labels) is None and X.learn(docs.limit(0), labels.limit(0)) is None
    out = X.score(docs, None)
    assert [(r["score"], r["predicted"], r["spans"]) for r in out.collect()] == [(0.0, 0, [])] * 3
    rng = random.Random(4)
    model = X.fit(texts(rng, 40, ["zurkle"]), texts(rng, 80))
    assert X.score(docs.limit(0), model).count() == 0
    again = X.score(docs_of([(1, "zurkle now"), (None, None), (1, "zurkle now"), (2, "calm")]), model).collect()
    assert sorted((str(r["doc_id"]), r["predicted"]) for r in again) == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]


def test_held_out_documents(spark):
    rows = X.op9_toxicity(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(toxic) >= 10 and np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.02
