"""Embedding near-duplicates against all pairs: links, groups, odd vectors, shards and dense cells."""

import time

import numpy as np
import pytest

from territory_engine.llm import embeddings as E
from territory_engine.llm.common import local_roots

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(seed, n=240, dims=24, copies=30, cluster=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    near = x[rng.integers(n, size=copies)] + rng.normal(size=(copies, dims)) * 0.03
    centre = rng.normal(size=dims)
    dense = centre + rng.normal(size=(cluster, dims)) * 0.09
    return np.concatenate([x, near, dense, x[:10], x[:1] * 3]).astype(np.float32)


def brute(rows, threshold=E.THRESHOLD):
    n = len(rows)
    fine = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    links = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(i + 1, n):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
                links[i, j] = links[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    root = local_roots(n, *np.nonzero(links))
    return links.sum(axis=1), root


@pytest.mark.parametrize("shard", [2048, 48])
def test_links_and_groups(spark, shard):
    x = made(5)
    rows = [(3 * i + 1, [float(c) for c in v], int(i % 3 == 0)) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0], [1e-30] * 24]
    rows += [(5000 + i, v, 1) for i, v in enumerate(odd)] + [(6000, rows[0][1], None), (6001, rows[0][1], None)]
    out = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=shard).collect()
    links, root = brute(rows)
    got = {r["id"]: r for r in out}
    assert len(out) == len(rows)
    if shard == 2048:
        assert [got[r[0]]["n_links"] for r in rows] == links.tolist()
    recall = sum(min(got[r[0]]["n_links"], n) for r, n in zip(rows, links)) / links.sum()
    assert recall >= 0.9 and all(got[r[0]]["n_links"] <= n for r, n in zip(rows, links))
    ids = np.array([r[0] for r in rows])
    least = {k: ids[root == k].min() for k in set(root)}
    same = [got[r[0]]["component_id"] == least[k] for r, k in zip(rows, root)]
    assert np.mean(same) >= 0.98
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in out)


def test_dense_cells_are_compared_in_portions(spark):
    """More vectors around one point than a shard holds: cutting does not thin them."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.02).astype(np.float32)
    rows = [(i, [float(c) for c in v], 7) for i, v in enumerate(x)]
    out = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=40).collect()
    links, _ = brute(rows)
    assert {r["id"]: r["n_links"] for r in out} == dict(enumerate(links.tolist())) and {r["component_id"] for r in out} == {0}


def test_repeated_null_and_missing_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(4, v, 1), (4, v, 1), (None, v, 1), (None, w, 1), (9, [float("nan"), 1.0], 1), (None, None, None)]
    out = sorted((str(r["id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == sorted([("4", 2, "4", True), ("4", 2, "4", True), ("None", 2, "4", False), ("None", 0, "None", False), ("9", 0, "9", True),
                          ("None", 0, "None", False)])
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_search_reaches_what_brute_force_finds():
    x = E.directions(__import__("pandas").Series(list(made(3, 400, 32, 60, 80))))
    a, b = E.range_search(x, E.padded(E.robust_graph(x, 1)), E.THRESHOLD)
    s = x @ x.T >= E.THRESHOLD
    np.fill_diagonal(s, False)
    assert len(a) >= 0.98 * s.sum() and s[a, b].mean() > 0.99


def test_a_search_that_misses_is_not_accepted(spark, monkeypatch):
    """Even at the last margin: shards are compared exactly if the graph search finds too little."""

    def nothing(x, edges, threshold):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(made(6))]
    monkeypatch.setattr(E, "range_search", nothing)
    out = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=96).collect()
    assert {r["id"]: r["n_links"] for r in out} == dict(enumerate(brute(rows)[0].tolist()))


def test_the_audit_grows_until_it_has_seen_links(spark):
    x = np.random.default_rng(4).normal(size=(300, 24)).astype(np.float32)
    reps = spark.createDataFrame([(i, 1, [float(c) for c in v], 1) for i, v in enumerate(x)], "rep long, label int, v array<float>, copies long")
    true, enough = E.true_links(reps, E.THRESHOLD, audited=20, most=60)
    assert not enough and 60 <= true.count() < 150
    true, enough = E.true_links(reps, E.THRESHOLD, audited=100)
    assert enough and true.count() == 300 and true.filter("n > 0").count() == 0


def test_a_shard_of_mutual_links_is_expanded_in_rounds():
    rng = np.random.default_rng(8)
    x = E.directions(__import__("pandas").Series(list(rng.normal(size=32) + rng.normal(size=(1500, 32)) * 0.01)))
    edges = E.padded(E.robust_graph(x, 1))
    start = time.monotonic()
    a, _ = E.range_search(x, edges, E.THRESHOLD)
    assert len(a) == 1500 * 1499 and time.monotonic() - start < 15


def test_doubles_keep_their_precision_and_recall_is_told(spark):
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, [1.0, 0.0], 1), (2, at(0.98 + 1e-9), 1), (3, [1.0, 0.0], 2), (4, at(0.98 - 1e-9), 2)]
    out = {r["id"]: r for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert [out[i]["n_links"] for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert {r["audited_recall"] for r in out.values()} == {1.0}
