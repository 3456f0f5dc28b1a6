"""Alignment of two tokenizers against plain loops; the minimal perfect hash against its definition."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import alignment as A
from territory_engine.llm.minimalhash import MinimalHash

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "a", "the thing, it is", "  two  spaces \n\n tabs\t", "été à l'école ﬁ", "日本語 と emoji 🙂", "x▁y", "▁", "<s> </s><unk> <0x41>",
         "<|endoftext|> plain", "a\x00b", "\x85 　", "the thing, it is", "unhappiness internationalisation 12345678"]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_minimal_hash_is_a_bijection(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 40, size=n))
    found = MinimalHash.load(*MinimalHash.build(keys).dump())
    assert sorted(found.index(keys).tolist()) == list(range(len(keys)))
    assert found.index(keys + 1).max(initial=-1) < len(keys)


def plain(docs):
    t, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    t.encode_special_tokens = True
    a_of, b_of = A.a_bytes(PATHS[0]), A.b_bytes(PATHS[1])

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(of[i])))
            at += len(of[i])
        return out

    aligned = []
    for d, text in docs:
        a = b = []
        if text:
            a, b = spans(t.encode(" " + text, add_special_tokens=False).ids, a_of), spans(sp.encode(text), b_of)
            want = (" " + text).encode()
            if b"".join(a_of[i] for i, *_ in a) != want or b"".join(b_of[i] for i, *_ in b) != want:
                a = b = []
        links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, s, f in a if start <= s and f <= e) + "|" + ",".join(str(i) for i, s, f in b if start <= s and f <= e))
            start = e
        aligned.append((d, a, b, groups, links))
    counts = Counter(p for *_, links in aligned for p in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(d, len(a), len(b), len(g), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", ";".join(g)) for d, a, b, g, ls in aligned]


def texts():
    rng = random.Random(8)
    alphabet = ["the", "ing", " ", " ", "  ", "\n", "é", "汉", "🙂", ".", "'s", "12", "tion", "\t", "A", "▁", "un"]
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(120)]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_equals_plain_loops(spark, docs_of):  # noqa: F811
    docs = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "a"), ((1 << 63) - 1, "the")]
    got = A.align_tokens(docs_of(docs).withColumnRenamed("source", "row").repartition(5), *PATHS, spans=True)
    assert rows_of(got) == sorted(map(repr, plain(docs)))


def test_pieces_buckets_trees_and_parts_change_nothing(spark, docs_of, monkeypatch):  # noqa: F811
    docs = [(i, t) for i, t in enumerate(texts())]
    want = sorted(repr(r[:-1]) for r in plain(docs))
    a, b = A.sides(*PATHS), docs_of(docs).repartition(9)
    rows = A.written(A.encoded(b.selectExpr("doc_id as id", "true as known", "text"), *PATHS), "test").collect()
    pairs = [(bytes(r["a"]), bytes(r["b"])) for r in rows]
    monkeypatch.setattr(A, "PORTION", 7)
    cut = list(A.pieces(pairs, a))
    assert len(cut) > len([p for p in pairs if p[0]])
    for i, (x, y) in enumerate(pairs):
        assert b"".join(c[1].tobytes() for c in cut if c[0] == i) == x and b"".join(c[2].tobytes() for c in cut if c[0] == i) == y
    monkeypatch.undo()
    monkeypatch.setattr(A, "BUCKET", 40)
    monkeypatch.setattr(A, "FAN", 2)
    assert rows_of(A.align_tokens(b, *PATHS, part=100)) == want


def test_long_documents_in_pieces():
    """Counts of a document in pieces are those of the whole."""
    s = A.sides(*PATHS)
    text = "the unhappiness of internationalisation, 12345 été " * 40
    t = Tokenizer.from_file(PATHS[0])
    doc = (np.array(t.encode(" " + text, add_special_tokens=False).ids, dtype=s.kind).tobytes(),
           np.array(sentencepiece.SentencePieceProcessor(model_file=PATHS[1]).encode(text), dtype=s.kind).tobytes())
    whole = [x for *_, x, _ in A.portions([doc, doc], s)][0]
    keep, A.PORTION = A.PORTION, 50
    try:
        parts = list(A.portions([doc, doc], s))
    finally:
        A.PORTION = keep
    assert len(parts) > 10 and [p[3] for p in parts].count(True) == 2
    assert sum(len(p[2].link_a) for p in parts) == len(whole.link_a)
    assert b"".join(A.written_groups(p[2], s)[0] for p in parts) == A.written_groups(whole, s)[0]


@pytest.mark.parametrize("cut", [9, 1 << 19])
def test_b_equals_the_library(monkeypatch, cut):
    monkeypatch.setattr(A, "CUT_CHARS", cut)
    model, e = sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), A.PieceEncoder(PATHS[1])
    rng = random.Random(9)
    alphabet = ["the", "ing", " ", " ", "  ", "\n", "é", "汉", "🙂", ".", "12", "\t", "A", "▁", "\x00", "\u3000", "\xa0", "<s>", ";\r"]
    some = [t for t in texts() if t] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 25))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(some)] == [model.encode(t) for t in some]


def test_empty_table(spark, docs_of):  # noqa: F811
    assert A.align_tokens(docs_of([]), *PATHS).count() == 0
    assert [tuple(r) for r in A.align_tokens(docs_of([(1, None)]), *PATHS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
