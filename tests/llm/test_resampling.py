"""Importance resampling against plain formulas; the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import radix
from territory_engine.llm import resampling as R


@pytest.mark.parametrize("block,bits,n", [(7, 3, 400), (16, 16, 60), (1 << 17, 11, 500), (5, 4, 1), (5, 4, 0)])
def test_radix_ranks_equal_sorted(spark, block, bits, n):
    rng = random.Random(n + block)
    # a hot digit: a third of all rows share the high part; keys above 2**63 and ties are there
    rows = [(i * 3, rng.choice([5, rng.randrange(1 << 9)]), rng.choice([1, 2, (1 << 64) - 1, rng.randrange(1 << 64)])) for i in range(n)]
    signed = [(r, a, b - (1 << 64) if b >= 1 << 63 else b) for r, a, b in rows]
    df = spark.createDataFrame(signed, "row long, a long, b long").repartition(3)
    got = {r["row"]: r["rank"] for r in radix.radix_ranks(df, [("a", 9), ("b", 64)], block, bits).collect()}
    assert sorted(got.values()) == list(range(1, n + 1))
    keys = sorted((a, b) for _, a, b in rows)
    assert all(keys[got[r] - 1] == (a, b) for r, a, b in rows)


def test_radix_is_stable(spark):
    rows = [(i, 0 if i % 3 else 1) for i in range(200)]
    got = radix.radix_ranks(spark.createDataFrame(rows, "row long, a long"), [("a", 1)], 16, 16).orderBy("rank").collect()
    assert [r["row"] for r in got] == [i for i, a in sorted(rows, key=lambda x: (x[1], x[0]))]


def plain(docs, bench, percent, least, seed, buckets, longest):
    def feats(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    cut = [(d, *feats(t)) for d, t in docs]
    s, t = Counter(b for *_, f in cut for b in f), Counter(b for x in bench for b in feats(x)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets)))) for b in range(buckets)}
    out = []
    for d, n, f in cut:
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(eligible[:percent * len(eligible) // 100])}
    return [(d, nf, w, sc, ranks.get(id(r))) for r in out for d, _, nf, w, sc in [r]]


TEXTS = [None, "", " ", "ÉCOLE école Ecole", "a1b2 c3", "x\x00y", "汉字 汉字", "A-B_C", "\x7f~`", "ſK K", "the The THE" * 9]


@pytest.mark.parametrize("longest,least", [(1, 2), (3, 4)])
def test_equals_plain_formulas(spark, docs_of, longest, least):
    rng = random.Random(5)
    words = ["the", "Of", "ouen", "thé", "x9", "汉"]
    docs = [(i * 7 - 500, t) for i, t in enumerate(TEXTS + [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(80)])]
    docs += [(None, "the of the of the"), (docs[-1][0], "x9 x9 x9 the ouen"), (-(1 << 63), "the of x9 ouen the"), ((1 << 63) - 1, "the of x9 ouen the")]
    bench = ["the ouen of", None, "", "x9 Of of"]
    target = spark.createDataFrame([(t, "c") for t in bench], "text string, bucket string")
    got = R.resample(docs_of(docs), target, 50, least, 7, 50, longest).collect()
    want = plain(docs, bench, 50, least, 7, 50, longest)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_words_and_runs_survive_portions(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", " ", "-", "é", "c", "9"]) for _ in range(400))
    whole = [R.bucket_ids(text, 10_000, k) for k in (1, 3)]
    monkeypatch.setattr(R.portions, "__defaults__", (5,))
    for (n, ids), k in zip(whole, (1, 3), strict=True):
        n2, ids2 = R.bucket_ids(text, 10_000, k)
        assert n == n2 and np.array_equal(np.sort(ids), np.sort(ids2))


def test_empty_tables(spark, docs_of):
    target = spark.createDataFrame([("the",)], "text string")
    assert R.resample(docs_of([]), target).count() == 0
    short = R.resample(docs_of([(1, "one two"), (2, None)]), target.limit(0)).collect()
    assert [(r["doc_id"], r["n_features"], r["weight"], r["rank"]) for r in sorted(short)] == [(1, 2, short[0]["weight"], None), (2, 0, 0, None)]
