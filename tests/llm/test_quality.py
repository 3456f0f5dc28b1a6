"""Quality classifier: features by plain counting, trees by trying every cut, held-out accuracy, odd inputs."""

import itertools
import math
import random

import numpy as np
import pytest

from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import quality as Q
from territory_engine.llm import registry
from territory_engine.llm.common import table

SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = "".join(" " if Q.class_of(c) in (Q.SPACE, Q.LINE) else c for c in text).split(" ")
    words = [w for w in words if w]
    k = [sum(Q.class_of(c) == i for c in text) for i in range(7)]
    letters, solid = k[Q.LOWER] + k[Q.UPPER], len(text) - k[Q.SPACE] - k[Q.LINE]
    share = lambda a, b: a / max(b, 1)
    count = lambda f: sum(map(f, words))
    return [math.log1p(len(text)), share(solid, len(words)), share(letters, solid), share(k[Q.UPPER], letters), share(k[Q.DIGIT], solid),
            share(k[Q.PUNCTUATION], solid), share(k[Q.SYMBOL], solid), share(k[Q.SPACE], len(text)), share(len(set(words)), len(words)),
            share(sum(a == b for a, b in itertools.pairwise(words)), len(words)), math.log1p(len(words) / (k[Q.LINE] + 1)),
            share(count(lambda w: len(w) <= 3), len(words)), share(count(lambda w: Q.class_of(w[0]) == Q.UPPER), len(words)),
            share(count(lambda w: not any(Q.class_of(c) in (Q.LOWER, Q.UPPER) for c in w)), len(words)),
            share(count(lambda w: Q.class_of(w[-1]) == Q.SYMBOL), len(words))]


@pytest.mark.parametrize("portion", [3, 17, 1 << 20])
def test_features_equal_plain_counting(portion):
    rng = random.Random(3)
    alphabet = ["a", "É", " ", " ", "\n", "9", "$", ".", "汉", "　", "😀", "the", "the ", "퟿", "|"]
    texts = [None, "", " ", "\n\n", "x", "same same same", "x" * 300 + " " + "x" * 300]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    got = Q.describe(texts, portion)
    if portion > 16:  # a word is cut only where a portion holds no white space at all
        assert np.allclose(got, [plain(t) for t in texts])
    assert np.allclose(got[:, 0], [plain(t)[0] for t in texts])


def test_portions_do_not_change_features():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "B", "$$", "c.\n"]) for _ in range(n)) for n in (0, 1, 50, 400, 400, 3)]
    assert np.allclose(Q.describe(texts, 40), Q.describe(texts))


def test_trees_equal_trying_every_cut():
    rng = np.random.default_rng(1)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 1, size=9)
        gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + Q.RIDGE)
        best = max([(0.0, 0)] + [(gain(slice(0, i)) + gain(slice(i, 9)) - gain(slice(0, 9)), i) for i in range(1, 9)])
        want = np.full(9, g.sum() / (h.sum() + Q.RIDGE))
        if best[1]:
            for s in (slice(0, best[1]), slice(best[1], 9)):
                want[s] = g[s].sum() / (h[s].sum() + Q.RIDGE)
        assert np.allclose(Q.shallow_tree(g, h, 1, 0), want)
        g2, h2 = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, size=(4, 5))
        tried = [sum(g2[a, b].sum() ** 2 / (h2[a, b].sum() + Q.RIDGE) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5)))
                 for i in range(1, 4) for j in range(1, 5)]
        assert math.isclose(Q.cross_tree(g2, h2, 0)[0], max(tried) - g2.sum() ** 2 / (h2.sum() + Q.RIDGE), abs_tol=1e-9)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y, np.ones(len(x)))
    assert (0, 1) in [(a, b) for a, b, *_ in model.pairs]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    model = Q.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), np.ones(300))
    for row, got in zip(x[:20], model.scores(x[:20]), strict=True):
        total = model.bias + sum(t[sum(c <= v for c in cut)] for cut, t, v in zip(model.cuts, model.tables, row, strict=True))
        total += sum(t[sum(c <= row[a] for c in ca), sum(c <= row[b] for c in cb)] for a, b, ca, cb, t in model.pairs)
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_held_out_accuracy(spark):
    found = registry.QUERIES["op12_quality"](spark, SF)
    assert found.count() == table(spark, SF, "documents").count()
    judged = found.filter("held_out").join(table(spark, SF, "labels"), "doc_id").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert len(bad) > 50
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.9
    assert judged.score.between(0, 1).all()


def test_labels_without_sense_teach_nothing(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (4, 0), (4, 0)], "doc_id long, quality int")
    assert [(r["id"], r["label"]) for r in Q.training_labels(labels).collect()] == [(4, 0)]


@pytest.mark.parametrize("labels,low,high", [([], 0.5, 0.5), ([(1, 1), (2, 1)], 0.7, 1), ([(1, 0), (9, 1)], 0, 0.3), ([(77, 1)], 0.5, 0.5)])
def test_few_labels_and_odd_rows(spark, docs_of, labels, low, high):  # noqa: F811
    docs = docs_of([(1, "a b"), (2, None), (2, ""), (None, "x" * 5000), (1, "a b")]).withColumnRenamed("source", "row")
    docs = docs.withColumnRenamed("lang", "found").selectExpr("*", "1 as score", "'x' as predicted")
    model = Q.learn(docs, Q.training_labels(spark.createDataFrame(labels, "doc_id long, quality int")))
    got = Q.score(docs, model).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {*docs.columns}
    assert all(low <= r["score"] <= high and r["predicted"] == int(r["score"] >= Q.THRESHOLD) for r in got)
    assert Q.score(docs.limit(0), model).count() == 0
