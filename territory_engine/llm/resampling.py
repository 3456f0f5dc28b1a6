"""Target-distribution importance resampling (operator 11).

Features are runs of words, hashed into buckets. Bucket counts of the whole corpus and of the whole
target give each bucket a gain, the logarithm of the ratio of its smoothed shares; a document's weight
is the sum of its features' gains, looked up in an array. Gumbel noise from a hash of the
id turns weights into scores, so that the highest scores are a sample without replacement in
proportion to the weights' exponentials. The ranks come from a distributed radix sort.

Words are cut and hashed once: the buckets of every document are written to the shared folder as packed
integers, counted there and read again for the weights. What reaches the driver are the counts, one
number per bucket.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import table, written
from territory_engine.llm.radix import radix_ranks

#: Fixed values of the features: bytes of words (after A-Z are lower-cased), buckets, words of a run.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
BUCKETS, LONGEST_RUN = 10_000, 1
#: Documents with fewer words are not drawn; percentage drawn; seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of a text whose words are held at a time.
PORTION = 1 << 20


def portions(text: bytes, size: int = PORTION) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that cut no word."""
    start = 0
    while start < len(text):
        cut = BREAK.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def bucket_ids(text: str | None, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every run of 1 to ``longest`` words, repeats included."""
    n, found, last = 0, [np.empty(0, dtype=np.uint32)], []
    for piece in portions((text or "").encode("utf-8", "surrogatepass").lower()):
        words = WORD.findall(piece)
        n += len(words)
        crcs = list(map(zlib.crc32, words))
        found.append(np.array(crcs, dtype=np.uint32))
        words = last + words
        runs = list(map(zlib.crc32, words))
        for k in range(2, longest + 1):
            # a run of k words: the run of k - 1 words before, then a space and the last word
            runs = [zlib.crc32(b" " + w, c) for c, w in zip(runs, words[k - 1:], strict=False)]
            found.append(np.array(runs[max(0, len(last) - k + 1):], dtype=np.uint32))
        last = words[-(longest - 1):] if longest > 1 else []
    return n, np.concatenate(found) % np.uint32(buckets)


def bucketed(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(row, id, known, n_words, n_features, buckets) of (id, known, text); buckets are packed unsigned integers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            cut = [bucket_ids(t, buckets, longest) for t in b["text"]]
            yield pd.DataFrame({"row": np.arange(row, row + len(b)), "id": b["id"], "known": b["known"], "n_words": [n for n, _ in cut],
                                "n_features": [len(f) for _, f in cut], "buckets": [f.astype(kind).tobytes() for _, f in cut]})
            row += len(b)

    return texts.mapInPandas(task, "row long, id long, known boolean, n_words long, n_features long, buckets binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all documents in every bucket: summed as an array in each task, then by bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for packed in b["buckets"]:
                total += np.bincount(np.frombuffer(packed, dtype=kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held.astype("int32"), "n": total[held]})

    summed = features.select("buckets").mapInPandas(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in summed.collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: the floored logarithm of its smoothed share in the target over the corpus's."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(row, id, known, n_words, n_features, weight, score) of bucketed documents."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            weight = [int(gain[np.frombuffer(p, dtype=kind)].sum()) for p in b["buckets"]]
            extra = [noise(i if known else None, seed) for i, known in zip(b["id"].tolist(), b["known"], strict=True)]
            yield b[["row", "id", "known", "n_words", "n_features"]].assign(weight=weight, score=np.array(weight, dtype=np.int64) + extra)

    return features.mapInPandas(task, "row long, id long, known boolean, n_words long, n_features long, weight long, score long")


def key_parts(rows: DataFrame) -> tuple[DataFrame, list[tuple[str, int]], int]:
    """The sort key of scored rows as unsigned columns: score downwards, null ids last, id upwards; and the number of rows."""
    known_id = F.when(F.col("known"), F.col("id"))
    m = rows.agg(F.count("*").alias("n"), F.min("score").alias("s0"), F.max("score").alias("s1"),
                 F.min(known_id).alias("i0"), F.max(known_id).alias("i1"), F.count_if(~F.col("known")).alias("nulls")).first()
    if not m["n"]:
        return rows, [], 0
    low, high = (0, 0) if m["i0"] is None else (m["i0"], m["i1"])
    span = high - low
    # a span of 63 bits can be subtracted; else the sign bit is turned, which keeps the order of unsigned values
    at = known_id - F.lit(low) if span < 1 << 63 else known_id.bitwiseXOR(F.lit(-(1 << 63)))
    keyed = rows.select("row", (F.lit(m["s1"]) - F.col("score")).alias("key_score"), (~F.col("known")).cast("long").alias("key_null"),
                        F.coalesce(at, F.lit(0)).alias("key_id"))
    parts = [("key_score", (m["s1"] - m["s0"]).bit_length()), ("key_null", 1 if m["nulls"] else 0),
             ("key_id", span.bit_length() if span < 1 << 63 else 64)]
    return keyed, [p for p in parts if p[1]], m["n"]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, longest: int = LONGEST_RUN, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Null and empty texts have no features and weight 0. Null ids share one noise and come after
    other ids of the same score; repeated ids keep a row each, in any order where scores are equal too.
    An empty target or corpus counts nothing (every bucket has its smoothed share). Texts are cut whole,
    a portion at a time. Other columns are not read, so their names cannot clash.
    """
    # pandas would turn a column of long integers with nulls into doubles, so nulls travel beside it
    doc_id = F.col(id_col).cast("long")
    features = written(bucketed(docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNotNull().alias("known"),
                                            F.col(text_col).alias("text")), buckets, longest), "features")
    wanted = bucketed(target.select(F.lit(0).cast("long").alias("id"), F.lit(False).alias("known"), F.col(target_text).alias("text")), buckets, longest)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    rows = written(scored(features, gain, seed), "scores")
    keyed, parts, n = key_parts(rows.filter(F.col("n_words") >= least_words))
    out = rows.select("row", F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_features", "weight", "score")
    if not n:
        return out.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    ranks = radix_ranks(keyed, parts).filter(F.col("rank") <= percent * n // 100)
    return out.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


# -- query ---------------------------------------------------------------------------------------

def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark, its score and its rank among those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by its definition (reflected polynomial 0xEDB88320), a table built from the rule.
ORACLE_SQL = r"""
WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (
       SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
       FROM range(256) r(i))),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
words AS (SELECT side, doc_id, rowid AS r, coalesce(regexp_extract_all(
       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
       FROM (SELECT *, row_number() OVER () AS rowid FROM texts)),
runs AS (SELECT side, r, unnest(w) AS f FROM words),
seen AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM runs),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
       [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(length(x) // 2)]),
       lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM seen, steps),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM runs JOIN hashed USING (f) GROUP BY bucket),
sizes AS (SELECT sum(s) AS sa, sum(t) AS ta FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((s + 1)::DOUBLE * (ta + 10000)::DOUBLE)))::BIGINT AS g
       FROM counts, sizes),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM runs JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scores AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
       (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
       FROM words LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS rk,
       count(*) FILTER (n_features >= 20) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN rk <= 10 * n // 100 THEN rk END::BIGINT AS rank FROM ranked
"""
