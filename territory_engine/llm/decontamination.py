"""Benchmark decontamination by spaced-seed hashing (operator 1).

Words of test and training texts become 64-bit hashes. A mask of ones and zeros, laid at every
position, hashes the words under its ones and ignores those under its zeros, so a seed survives
substitutions at the ignored positions. Test and training seeds are joined on the hash; around
each hit the two texts are compared along the hit's diagonal, and the longest stretch in which at
least IDENTITY of the words agree is an overlap if it is long enough. An overlap is found if the words
under one mask agree somewhere in it. The masks of a test item are chosen by its length so that
substitutions, as many as IDENTITY allows, leave one such place wherever they fall; items of fewer
than LEAST_ITEM words allow none and are looked for as a whole. In scripts that put no spaces
between words each character is a word.

Training seeds are far more than test seeds, so they pass a Bloom filter of the test seeds while
the text is read; the filter has a bounded size and only spares work: the join decides. Only the
neighbourhoods of what passes leave the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import table, written

#: Masks over word positions; ones are hashed, zeros ignored. The last three find what the first leave.
MASKS = ("1110111", "110100111", "1100101011", "11111001", "10011111", "1111010001")
#: Masks of items of fewer words than the number.
SHORT_MASKS = ((8, ("1111", "10111", "11011", "11101")), (12, ("11111", "110111", "111011", "11010011")))
#: Share of agreeing words in an overlap, its words at least, and the words of an item that need not agree as a whole.
IDENTITY, LEAST_OVERLAP, LEAST_ITEM = 0.8, 12, 5
#: Words around seeds that are compared; seeds closer than this share a neighbourhood.
AROUND = 32
#: Bits of the filter for each test seed, and at most (32 MB).
FILTER_BITS, FILTER_MOST, FILTER_PROBES = 32, 1 << 28, 4
CHUNK_BITS = 1 << 16
KEPT = 150_000

# Thai, Lao, Burmese, Khmer, Tai Lue, Tai Tham, kana, Chinese characters.
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1980-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
            "\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
SPACED_WORD, WITHOUT_SPACES = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]")
ODD = np.random.default_rng(2024).integers(1 << 62, dtype=np.uint64, size=64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """As ``WORD.findall``, faster where no character is a word of its own."""
    return (SPACED_WORD if text.isascii() or not WITHOUT_SPACES.search(text) else WORD).findall(text)


class Words:
    """64-bit hashes of lower-cased words; each distinct word is hashed once and kept."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def hashes(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [words_of(t.lower()) if t else [] for t in texts]
        new = set().union(*words).difference(self.kept) if words else set()
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = set().union(*words)
        self.kept.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        get = self.kept.__getitem__
        return [np.fromiter(map(get, ws), dtype=np.uint64, count=len(ws)) for ws in words]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words at each position; none if the text is shorter than the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = np.full(n, xxhash.xxh64_intdigest(mask), dtype=np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            x += words[i:i + n] * ODD[i]
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def masks_for(length: int) -> tuple[str, ...]:
    """The masks of a test item: one over the whole of an item of fewer than LEAST_ITEM words."""
    if length < LEAST_ITEM:
        return ("1" * length,)
    return next((masks for below, masks in SHORT_MASKS if length < below), MASKS)


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(FILTER_PROBES)]


def longest_agreement(same: np.ndarray) -> tuple[int, int]:
    """Longest stretch [start, end) with at least IDENTITY agreeing that begins and ends with agreement."""
    if not same.any():
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(same - IDENTITY)]) + 1e-9 * np.arange(len(same) + 1)
    start = np.where(np.append(same, False), total, np.inf)  # a stretch may start or end only at agreement
    end = np.where(np.append(False, same), total, -np.inf)
    start_low = np.minimum.accumulate(start)
    end_high = np.maximum.accumulate(end[::-1])[::-1]
    best, i = (0, 0), 0
    for j in range(len(total)):  # the widest i < j with start_low[i] <= end_high[j]
        while i < j and start_low[i] > end_high[j]:
            i += 1
        if j - i > best[1] - best[0]:
            best = (i, j)
    return best


def test_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, seeds, masks) of the distinct test texts; equal word sequences keep the smallest id.

    Items without a word are left out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Words()
        for b in batches:
            rows = []
            for i, w in zip(b["item"].astype(object).where(b["item"].notna(), None), own.hashes(list(b["text"])), strict=True):
                if not len(w):
                    continue
                masks = masks_for(len(w))
                found = [(int(h), pos) for m in masks for pos, h in enumerate(seeds(w, m).view(np.int64))]
                rows.append((i, w.view(np.int64).tolist(), [{"seed": h, "at": p} for h, p in found], list(masks)))
            yield pd.DataFrame(rows, columns=["item", "words", "seeds", "masks"]).astype({"item": "Int64"})

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInPandas(
        read, "item long, words array<long>, seeds array<struct<seed: long, at: int>>, masks array<string>")
    return (rows.groupBy("words").agg(F.min("item").alias("item"), F.first("seeds").alias("seeds"), F.first("masks").alias("masks")))


def bloom(distinct_seeds: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Bits of a filter of all test seeds, made in pieces of CHUNK_BITS by Spark."""
    bits = CHUNK_BITS
    while bits < min(FILTER_MOST, FILTER_BITS * count):
        bits *= 2
    low, high = F.col("seed").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("seed", 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(low + F.lit(i) * high).bitwiseAND(F.lit(bits - 1)) for i in range(FILTER_PROBES)]))

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(CHUNK_BITS, dtype=bool)
        own[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    pieces = (distinct_seeds.select(at.alias("at")).distinct()
              .select((F.col("at") / CHUNK_BITS).cast("long").alias("chunk"), F.pmod("at", F.lit(CHUNK_BITS)).cast("int").alias("bit"))
              .groupBy("chunk").applyInPandas(piece, "chunk long, bits binary"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.collect():  # at most FILTER_MOST / CHUNK_BITS pieces of 8 KB
        out[r["chunk"] * CHUNK_BITS // 8:(r["chunk"] + 1) * CHUNK_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits, out


NEIGHBOURHOOD = "id long, t1 long, t2 long, first int, words array<long>, seeds array<struct<seed: long, at: int>>"


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text") -> DataFrame:
    """One row per training document and test item that overlap, with the longest overlap.

    Columns: id, t1 and t2 (hashes of the text), item, n_words (of the overlap), n_same (agreeing),
    doc_word and item_word (where it begins, in words). Null texts and texts without words overlap
    with nothing; rows repeated as a whole give one row; rows with a null id are kept by their text. An
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    items = written(test_items(benchmark, item_col, item_text_col), "decon-items")
    test = items.select("item", (F.size("words") < LEAST_ITEM).alias("whole"), F.explode("seeds").alias("s")).select(
        "item", "whole", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
    distinct = test.select("seed").distinct()
    bits, table_bits = bloom(distinct, distinct.count())
    masks = sorted(r[0] for r in items.select(F.explode("masks")).distinct().collect())  # of all lengths, fewer than 20
    filter_bits = spark.sparkContext.broadcast(table_bits)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Words()
        known = filter_bits.value
        for b in batches:
            for s in range(0, len(b), 512):
                rows = b.iloc[s:s + 512]
                words = own.hashes([None if t is None else t for t in rows["text"]])
                lengths = np.array([len(w) for w in words], dtype=np.int64)
                joined = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
                doc = np.repeat(np.arange(len(words)), lengths)
                at, seed = [], []
                for m in masks:
                    h = seeds(joined, m)
                    if not len(h):
                        continue
                    hit = doc[:len(h)] == doc[len(m) - 1:]
                    for p in probes(h, bits):
                        live = np.flatnonzero(hit)
                        p = p[live]
                        hit[live] = (known[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at.append(np.flatnonzero(hit))
                    seed.append(h[hit])
                if not at or not sum(map(len, at)):
                    continue
                at, seed = np.concatenate(at), np.concatenate(seed).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                starts = np.cumsum(lengths) - lengths
                cut = np.flatnonzero(np.append(True, (np.diff(at) > AROUND) | (np.diff(doc[at]) != 0)))
                out = []
                for x, y in zip(cut, np.append(cut[1:], len(at)), strict=True):
                    d = int(doc[at[x]])
                    lo = max(int(starts[d]), int(at[x]) - AROUND)
                    hi = min(int(starts[d] + lengths[d]), int(at[y - 1]) + len(max(masks, key=len)) + AROUND)
                    r = rows.iloc[d]
                    out.append((r["id"], r["t1"], r["t2"], lo - int(starts[d]), joined[lo:hi].view(np.int64).tolist(),
                                [{"seed": int(h), "at": int(p - starts[d])} for h, p in zip(seed[x:y], at[x:y], strict=True)]))
                yield pd.DataFrame(out, columns=["id", "t1", "t2", "first", "words", "seeds"]).astype({"id": "Int64"})

    text = F.col(text_col)
    read = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"),
                       F.xxhash64(F.lit(1), text).alias("t2")).filter("text is not null")
    near = written(read.mapInPandas(scan, NEIGHBOURHOOD).withColumn("place", F.xxhash64("id", F.isnull("id"), "t1", "t2", "first")), "decon-near")
    diagonal = F.col("at") - F.col("item_at")  # an item that agrees as a whole does so best where it comes first
    hits = (near.select("place", F.explode("seeds").alias("s")).select("place", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
            .join(test, "seed").groupBy("place", "item", F.when(~F.col("whole"), diagonal).alias("each"))
            .agg(F.min(diagonal).alias("diagonal")).drop("each"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                here, item = np.asarray(r.words), np.asarray(r.item_words)
                lo, hi = max(0, r.first - r.diagonal), min(len(item), r.first + len(here) - r.diagonal)
                shift = r.diagonal - r.first
                same = item[lo:hi] == here[lo + shift:hi + shift]
                s, e = longest_agreement(same)
                if e - s >= min(LEAST_OVERLAP, int(np.ceil(IDENTITY * len(item)))):
                    out.append((r.id, r.t1, r.t2, r.item, e - s, int(same[s:e].sum()), lo + s + r.diagonal, lo + s))
            yield pd.DataFrame(out, columns=["id", "t1", "t2", "item", "n_words", "n_same", "doc_word", "item_word"]).astype(
                {"id": "Int64", "item": "Int64"})

    candidates = hits.join(near.select("place", "id", "t1", "t2", "first", "words").dropDuplicates(["place"]), "place").join(
        items.select("item", F.col("words").alias("item_words")), "item")
    found = candidates.select("id", "t1", "t2", "first", "words", "item", "item_words", "diagonal").mapInPandas(
        verify, "id long, t1 long, t2 long, item long, n_words int, n_same int, doc_word int, item_word int")
    best = F.max(F.struct("n_same", "n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best")
    return found.groupBy("id", "t1", "t2", "item").agg(best).select(
        "id", "t1", "t2", "item", "best.n_words", "best.n_same", (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps a test item; columns as before."""
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col)
    leaked = written(found.select(F.struct("t1", "t2").alias("__leak")).distinct(), "decon-leaks")
    text = F.col(f"`{text_col}`")
    key = F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    return docs.withColumn("__text", key).join(leaked, F.col("__text") == F.col("__leak"), "left_anti").drop("__text")


# -- query ---------------------------------------------------------------------------------------

def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, with their longest overlap with each."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "n_same", "doc_word", "item_word").distinct()
