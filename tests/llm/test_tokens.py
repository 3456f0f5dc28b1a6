"""Token ids, token files and packing against the library itself."""

import functools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import docs_of  # noqa: F401
from territory_engine.llm import packing as P
from territory_engine.llm import tokenfile as TF
from territory_engine.llm import tokens as T
from territory_engine.llm.common import shared_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "Hello world's", "a" * 200, "Été à l'école\n\n  x1 22", "<|endoftext|> is a token", "日本語 と emoji 🙂", "x\x1cy\x85z\xa0w", "½ ² ٣",
         "word " * 6000, "“quoted” – dash", "tab\t\tend  "]


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def plain(text):
    return library().encode(text or "", add_special_tokens=False).ids


SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|> 日本", "<|endoftext|", "<|endoftext|>" * 3]


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_equal_the_library(as_text):
    e, t = T.encoder(PATH, as_text), Tokenizer.from_file(PATH)
    if as_text:  # the library's default otherwise
        t.encode_special_tokens = True
    rng = random.Random(4)
    outside = re.compile(T.NOT_LATIN).search
    latin = [chr(i) for i in [*range(0x250), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)] if not outside(chr(i))]
    cases = SPECIAL + [t_ for t_ in TEXTS if t_] + [f"a{c}b {c}  {c}{c} 1{c}'s\n{c}" for c in latin]
    cases += ["".join(rng.choices(latin + [" "] * 60 + list("aeiou'sstrl019\n") * 6, k=rng.randint(0, 40))) for _ in range(1500)]
    mixed = latin + ["汉", "я", "é", "　", "\x85", "\x1c", "²", "٣", "🙂", "'re", "'ll", " '"] * 4 + [" ", "a", "'s"] * 30
    cases += ["".join(rng.choices(mixed, k=rng.randint(0, 40))) for _ in range(1500)]
    wanted = [w.ids for w in t.encode_batch(cases, add_special_tokens=False)]
    for c, got, want in zip(cases, e.encode_all(cases), wanted, strict=True):  # texts encoded together
        assert np.frombuffer(got, "<u4").tolist() == want, repr(c)
    for c, want in list(zip(cases, wanted, strict=True))[:100]:
        assert np.frombuffer(e.encode(c), "<u4").tolist() == want, repr(c)


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(T, "PORTION", 20)
    e = T.Encoder(PATH)
    for alphabet in (["ab", " ", "  ", "\n", "é", "'s", "1"], ["汉字", " ", "ab", "\u3000", "'s"]):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == [plain(x) for x in texts]


def test_kept_words_are_renewed(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 5)
    e = T.Encoder(PATH)
    for t in ["one two three four five six", "one two seven eight nine ten", "six one"] * 2:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == plain(t)


def test_files_round_trip(spark, docs_of):
    rows = [(1000 - 7 * i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id"), (5, "same"), (5, "same"), (5, "other")]
    path = shared_path(spark, "test-files")
    TF.write_token_files(docs_of(rows).withColumn("start", F.lit(1)), path, PATH, end_id=0)
    got = TF.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in [plain(t) + [0] for i, t in rows if i == r["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        at += len(ids)
    some = {r["doc_id"]: r["start"] for r in TF.read_token_files(spark, path, [1000, 5, 42]).collect()}
    assert some.keys() == {1000, 5} and some[1000] == next(r["start"] for r in got if r["doc_id"] == 1000)
    stored = spark.read.parquet(f"{path}/blocks").select("dictionary_hash").distinct().collect()
    assert [r[0] for r in stored] == [spark.read.parquet(f"{path}/dictionary").first()["hash"]]


def test_a_wrong_dictionary_is_refused(spark, docs_of):
    path = shared_path(spark, "test-files")
    TF.write_token_files(docs_of([(1, "a b c")]), path, PATH, end_id=0)
    spark.read.parquet(f"{path}/dictionary").withColumn("bytes", F.lit(b"other")).write.parquet(f"{path}-2/dictionary")
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{path}-2/blocks")
    with pytest.raises(ValueError, match="dictionary"):
        TF.read_token_files(spark, f"{path}-2")


def test_empty_table_gives_an_empty_file(spark, docs_of):
    path = shared_path(spark, "test-files")
    TF.write_token_files(docs_of([]), path, PATH, end_id=0)
    assert TF.read_token_files(spark, path).count() == 0


def check_pieces(rows, pieces, capacity, end_id=1):
    """Every id in exactly one piece, sequences gapless and within capacity."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(plain(t) + [end_id])
    for i, wanted in texts.items():
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == sum(map(len, wanted))
        if len(wanted) == 1:
            assert sum((np.frombuffer(p["ids"], "<u4").tolist() for p in own), []) == wanted[0]
            at = 0
            for p in own:
                assert (p["start"], p["doc_tokens"]) == (at, len(wanted[0]))
                at += p["length"]
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
    return by


def test_packing_is_exact_and_tight(spark, docs_of):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=int(rng.lognormvariate(5, 1))))) for i in range(900)]
    rows += [(9000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (9000, "again")]
    pieces = P.pack(docs_of(rows).coalesce(1), PATH, 1).collect()
    by = check_pieces(rows, pieces, P.CAPACITY)
    sizes = [sum(p["length"] for p in own) for own in by.values()]
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 0.01 * sum(sizes)
    spread = P.pack(docs_of(rows).repartition(5), PATH, 1, capacity=256, windows=8, planned=250).collect()
    check_pieces(rows, spread, 256)


def test_differencing_gives_near_equal_windows():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(400)]
    windows = P.difference(sizes, 16)
    assert sorted(i for w in windows for i in w) == list(range(400))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= 2
    assert P.difference([], 4) == [] and P.difference([5], 4) == [[0]]


def test_the_window_count_rises_when_capacity_is_exceeded():
    pieces = [("d", 0, 6)] * 5  # 30 ids in windows of 10: three would do, but only one piece fits a window
    assert len(P.windows_of(pieces, 10)) == 5


def test_powers_of_two_need_no_padding():
    windows = P.powers_of_two([("a", 0, 700), ("b", 3, 657)])
    sizes = [sum(p[2] for p in w) for w in windows]
    assert sum(sizes) == 1357 and all(s & (s - 1) == 0 for s in sizes) and len(set(sizes)) == len(sizes)


def test_packing_nothing(spark, docs_of):
    assert P.pack(docs_of([]), PATH, 1).count() == 0
    only = P.pack(docs_of([(1, None), (2, "")]).coalesce(1), PATH, 1).collect()
    assert sorted((p["doc_id"], p["length"], zlib.crc32(p["ids"])) for p in only) == [(i, 1, zlib.crc32(b"\1\0\0\0")) for i in (1, 2)]


def test_large_ids_beside_null_ids(spark, docs_of):
    big = (1 << 63) - 1
    docs = docs_of([(big, "a"), (None, "b c"), (big - 1, None), (-big, "d")])
    path = shared_path(spark, "test-files")
    TF.write_token_files(docs, path, PATH, end_id=0)
    read = TF.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None, -big, big - 1, big]
    assert {r["doc_id"] for r in P.pack(docs.coalesce(1), PATH, 1).collect()} == {None, -big, big - 1, big}
