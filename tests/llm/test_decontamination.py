"""Spaced seeds against a full comparison of every document with every item."""

import itertools
import random

import numpy as np

from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import decontamination as D


def corpus(rng):
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    items = [" ".join(rng.choices(words, k=n)) for n in (15, 20, 30, 45, 60, 6, 8, 5)]
    docs = [" ".join(rng.choices(words, k=rng.randint(5, 200))) for _ in range(60)]
    for k in range(30):  # whole, substituted, cut and hidden passages
        w = rng.choice(items).split()
        if k % 3 == 1:
            for i in range(2, len(w), 9):
                w[i] = "swap"
        if k % 3 == 2 and len(w) > 24:
            w = w[4:20]
        d = docs[k].split()
        p = rng.randrange(len(d) + 1)
        docs[k] = " ".join(d[:p] + [x.upper() for x in w] + ["..."] + d[p:])
    return docs, items


def brute(doc, item):
    """Longest stretch over all diagonals with the identity asked for, if it is long enough."""
    a, b = [D.WORD.findall((t or "").lower()) for t in (doc, item)]
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= i + shift < len(a) and a[i + shift] == b[i] for i in range(len(b))]
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        for s in range(lo, hi):
            for e in range(hi, s + best, -1):
                if same[s] and same[e - 1] and sum(same[s:e]) >= D.IDENTITY * (e - s) - 1e-9:
                    best = e - s
                    break
    return best if len(b) >= D.LEAST_ITEM and best >= min(D.LEAST_OVERLAP, int(np.ceil(D.IDENTITY * len(b)))) else 0


def test_overlaps_equal_full_comparison(spark, docs_of):
    rng = random.Random(7)
    texts, items = corpus(rng)
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, texts[0]), (902, texts[0]), (0, texts[0]), (903, "one")])
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(50, items[1], "x"), (51, None, "x"), (52, "too short", "x")],
                                  "item_id long, text string, seeds string")
    got = {(r["id"], r["item"]): r["n_words"] for r in D.overlaps(docs, bench).collect()}
    want = {(r["doc_id"], i): brute(r["text"], t) for r in docs.collect() for i, t in enumerate(items) if brute(r["text"], t)}
    assert got.items() <= want.items() and len(want) >= 30
    # only substituted items that hardly hold a mask may be missed
    missed = want.keys() - got.keys()
    assert all(len(items[i].split()) <= 8 and items[i] not in (texts[d] or "").lower() for d, i in missed)
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    leaked = {d for d, _ in got}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in leaked)


def test_longest_agreement_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randint(0, 40))], dtype=bool)
        s, e = D.longest_agreement(same)
        best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1)
                    if same[i] and same[j - 1] and same[i:j].sum() >= D.IDENTITY * (j - i) - 1e-9), default=0)
        assert e - s == best and (best == 0 or same[s] and same[e - 1])


def test_a_seed_ignores_the_masked_positions():
    a = np.arange(1, 30, dtype=np.uint64)
    b = a.copy()
    b[3] = 999
    mask = D.MASKS[0]
    hit = D.seeds(a, mask) == D.seeds(b, mask)
    assert mask[3] == "0" and hit[0] and not hit[1:4].any() and hit[4:].all()


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert D.overlaps(docs_of([]), bench).count() == 0
    assert D.overlaps(docs_of([(1, "alpha beta gamma delta epsilon zeta")]), bench.limit(0)).count() == 0
    assert D.decontaminate(docs_of([(1, "a"), (None, None)]), bench.limit(0)).count() == 2


def agreeing(n):
    """Words of an item of ``n`` that agree, for all stretches and substitutions that count as an overlap."""
    for length in range(min(D.LEAST_OVERLAP, int(np.ceil(D.IDENTITY * n))), n + 1):
        for gone in itertools.combinations(range(1, length - 1), int((1 - D.IDENTITY) * length + 1e-9)):
            yield set(range(length)) - set(gone)


def test_masks_leave_no_substitutions_out():
    for n in range(1, 23):
        ones = [{i for i, c in enumerate(m) if c == "1"} for m in D.masks_for(n)]
        assert all(any({i + k for i in m} <= same for m in ones for k in range(n)) for same in agreeing(n)), n


def test_short_items_and_scripts_without_spaces(spark, docs_of):
    items = [" ".join(f"item{n}x{i}" for i in range(n)) for n in range(1, 13)] + ["今日は天気がいいから公園を散歩しましょう", "ภาษาไทยไม่มีช่องว่างระหว่างคำ"]
    texts = []
    for n, item in enumerate(items, 1):
        words = D.words_of(item)
        for k, same in enumerate(list(agreeing(len(words)))[:60]):
            texts.append(" ".join(w if i in same else f"other{i}" for i, w in enumerate(words)) if n < 13 or k else "前文。" + item + "。後文")
    texts += ["item2x0 item2x1 " * 400, "item4x0 item4x1 item4x2", "今日は"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["id"], r["item"]): r["n_words"] for r in D.overlaps(docs_of(list(enumerate(texts))), bench).collect()}
    want = {(d, i): brute_any(t, x) for d, t in enumerate(texts) for i, x in enumerate(items) if brute_any(t, x)}
    assert got == want and {i for _, i in got} == set(range(len(items)))


def brute_any(doc, item):
    """As ``brute``, with items of any length: the shortest agree as a whole."""
    a, b = D.WORD.findall(doc), D.WORD.findall(item)
    if len(b) < D.LEAST_ITEM:
        return len(b) if any(a[i:i + len(b)] == b for i in range(len(a))) else 0
    return brute(doc, item)
