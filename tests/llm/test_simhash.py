"""SimHash near-duplicates against brute force: fingerprints, links, groups, edge rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import simhash as S
from territory_engine.llm.common import local_roots
from territory_engine.llm.components import components


def plain_fingerprint(text, k=3):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    parts = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, bits):
    x = np.array(fps, dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits)
    return local_roots(len(x), a, b)


def some_texts(rng, n=60):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 120))) for _ in range(n)]
    for t in texts[:20]:  # near-copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts


def test_groups_equal_brute_force_and_edge_rows(spark, docs_of):
    rng = random.Random(1)
    texts = some_texts(rng) + ["", "   \t\n", None, "one", "ONE", "two words", "É accents Stay", "é accents stay", "x " * 5000]
    texts += texts[:5] + [None]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, texts[3]), (7, texts[3])]
    out = S.simhash_groups(docs_of(rows).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("clash")), 3, 3)
    got = sorted(((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in out.collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    root = brute_roots(fps, 3)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == sorted(((i, f, least[r]) for (i, _), f, r in zip(rows, fps, root)), key=str)


def clustered(rng, n):
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) < n:
        x = rng.choice([centre, rng.choice(list(out)[:50])])
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(out)


@pytest.mark.parametrize("node_rows,splits", [(8192, 2), (40, 2), (25, 0)])
def test_links_span_all_groups_whatever_the_node_size(spark, node_rows, splits):
    """Dense clusters, scattered prints and zero; nodes are split and cut into portions."""
    rng = random.Random(3)
    fps = list(dict.fromkeys(clustered(rng, 150) + clustered(rng, 60) + [rng.getrandbits(64) for _ in range(150)] + [0, 1, 7, 15]))
    table = spark.createDataFrame([(S.signed(x),) for x in fps], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in S.close_links(table, 3, node_rows, splits).collect()]
    at = {x: i for i, x in enumerate(fps)}
    got = local_roots(len(fps), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert np.array_equal(got, brute_roots(fps, 3))


def test_pairs_of_the_hierarchy_equal_brute_force():
    rng = random.Random(5)
    fps = np.array(list(dict.fromkeys(clustered(rng, 700) + [rng.getrandbits(64) for _ in range(900)])), dtype=np.uint64)
    fps = fps[np.argsort(S._gray_np(fps))]
    got = {(int(i), int(j)) for a, b in S.close_pairs(fps, 3, chunk=5000) for i, j in zip(a, b)}
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert got == set(zip(x.tolist(), y.tolist()))


def test_one_document_of_each_group_stays(spark, docs_of):
    rng = random.Random(2)
    texts = some_texts(rng, 25)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[0]), (3, texts[3]), (3, texts[3]), (None, texts[5]), (None, "alone here now ok")]
    docs = docs_of(rows)
    kept = S.simhash_dedup(docs, 3, 3)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    assert len(ids) == len(set(brute_roots(fps, 3))) and None in ids and 500 not in ids and ids.count(3) <= 1


def test_empty_tables(spark, docs_of):
    assert S.simhash_groups(docs_of([]), 3, 3).count() == 0
    assert S.simhash_dedup(docs_of([]), 3, 3).count() == 0


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300 + i, 300 + (i * 7) % 30) for i in range(30)]
    links += [(5, 5), (None, 3), (-4, 2), (2, -4)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for a, b in links if a is not None for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    root = local_roots(len(nodes), np.array([at[a] for a, b in links if a is not None]), np.array([at[b] for a, b in links if a is not None]))
    assert got == {x: nodes[r] for x, r in zip(nodes, root) if nodes[r] != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
