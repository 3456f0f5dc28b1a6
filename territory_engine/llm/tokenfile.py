"""Token-id files with a shared zstandard dictionary and per-document access (operator 6).

Format, a folder that any Spark-readable store can hold:

* ``dictionary`` - one row: hash (SHA-256, hex), bytes of the dictionary, bytes per id, format version.
* ``blocks`` - rows in ascending order of the documents. A block has its part and number, the ids in
  the part before it, the smallest and largest document id, and for each of its documents the id,
  the number of token ids and the end of its frame in ``payload`` (the offset index). Each
  document is one zstandard frame of its serialized ids, compressed with the shared dictionary
  named by ``dictionary_hash``; a reader refuses another dictionary.

Ids are serialized as little-endian unsigned integers, two bytes each if the vocabulary allows.
A short document is read by its block's index and one small frame, without its neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import nullable_longs, shared_path, table, written
from territory_engine.llm.tokens import encoder

VERSION = 1
#: The dictionary's size, and the documents and serialized bytes it is trained on at most.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 65_536, 2_000, 8_000_000
#: A block ends at so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
LEVEL = 3
#: Segment and d-mer bytes of the dictionary trainer; fixed, so it need not search for them.
COVER = (256, 8)

BLOCK = ("dictionary_hash string, part int, block int, ids_before long, least_id long, largest_id long, "
         "doc_ids array<long>, n_tokens array<long>, frame_ends array<long>, payload binary")


def serialize(ids: bytes, end_id: int, width: int) -> bytes:
    """The ids (little-endian 32-bit) and the end id in ``width`` bytes each."""
    return np.append(np.frombuffer(ids, dtype="<u4"), end_id).astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, id_col: str, text_col: str) -> bytes:
    """Dictionary from a bounded sample of documents (SAMPLE_DOCS, SAMPLE_BYTES), chosen by a hash."""
    total = docs.count()
    if not total:
        return b""
    share = min(1.0, 2 * SAMPLE_DOCS / total)
    chosen = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ids": [serialize(i, end_id, width) for i in encoder(tokenizer_path).encode_all(b["text"])]})

    sampled = docs.filter(chosen).select(F.col(text_col).alias("text")).limit(SAMPLE_DOCS)
    samples, size = [], 0
    for row in sampled.mapInPandas(arrays, "ids binary").toLocalIterator():
        if size + len(row.ids) > SAMPLE_BYTES:
            continue
        samples.append(bytes(row.ids))
        size += len(row.ids)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=COVER[0], d=COVER[1]).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve as dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode whole texts and write them under ``path`` in ascending order of the id.

    Null texts are documents without ids before the end id. Null ids sort first; equal ids are
    ordered by a hash of the text. Other columns are not read. An empty table gives an empty file.
    """
    spark = docs.sparkSession
    vocabulary = encoder(tokenizer_path).tokenizer.get_vocab_size()
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, end_id, width, id_col, text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    # one small row
    spark.createDataFrame([(digest, bytearray(dictionary), width, VERSION)], "hash string, bytes binary, width int, version int") \
        .coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            arrays = [serialize(i, end_id, width) for i in encoder(tokenizer_path).encode_all(b["text"])]
            yield b[["id", "known", "tie"]].assign(n_tokens=[len(a) // width for a in arrays], frame=[packer.compress(a) for a in arrays])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        ids_before, number = 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []
        size = 0

        def block() -> pd.DataFrame:
            known = [i for i in ids if i is not None]
            return pd.DataFrame([{
                "dictionary_hash": digest, "part": part, "block": number, "ids_before": ids_before,
                "least_id": min(known, default=None), "largest_id": max(known, default=None), "doc_ids": ids, "n_tokens": counts,
                "frame_ends": np.cumsum([len(f) for f in held]).tolist(), "payload": b"".join(held)}])

        for b in batches:
            for doc_id, known, n, frame in zip(b["id"].tolist(), b["known"], b["n_tokens"].tolist(), b["frame"], strict=True):
                ids.append(doc_id if known else None)
                counts.append(n)
                held.append(frame)
                size += len(frame)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    ids_before, number, size = ids_before + sum(counts), number + 1, 0
                    ids, counts, held = [], [], []
        if ids:
            yield block()

    # texts are encoded where they lie; only frames are written, ordered and moved. Null ids travel as a
    # flag, as pandas would turn long integers with nulls into doubles.
    doc_id = F.col(id_col).cast("long")
    encoded = written(docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNotNull().alias("known"), F.col(text_col).alias("text"),
                                  F.xxhash64(F.col(text_col)).alias("tie"))
                      .mapInPandas(frames, "id long, known boolean, tie long, n_tokens long, frame binary"), "frames")
    order = ["known", "id", "tie"]
    # frames are compressed already
    (encoded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(blocks, BLOCK)
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, or of the listed ones only.

    ``ids`` are little-endian unsigned 32-bit; ``start`` counts the ids of all documents before.
    With ``doc_ids``, blocks are chosen by their smallest and largest id and only the frames of
    those documents are decompressed.
    """
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, width, digest = bytes(row["bytes"]), row["width"], row["hash"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"{path}: the dictionary does not have its recorded hash")
    stored = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # one row for each part file, of which there are as many as shuffle partitions
    totals = stored.groupBy("part").agg(F.max(F.col("ids_before") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x))
                                        .alias("n")).collect()
    before, so_far = {}, 0
    for t in sorted(totals, key=lambda t: t["part"]):
        before[t["part"]] = so_far
        so_far += t["n"]
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | F.col("least_id").__le__(i) & F.col("largest_id").__ge__(i)
        stored = stored.filter(near)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for x in b.itertuples(index=False):
                if x.dictionary_hash != digest:
                    raise ValueError(f"{path}: block {x.part}/{x.block} needs dictionary {x.dictionary_hash}")
                starts = before[x.part] + x.ids_before + np.cumsum(x.n_tokens) - x.n_tokens
                at = np.append(0, x.frame_ends[:-1])
                doc_ids = [i if k else None for i, k in zip(x.doc_ids.tolist(), x.known, strict=True)]
                out = [(i, int(s), int(n),
                        np.frombuffer(reader.decompress(x.payload[a:e]), dtype=f"<u{width}").astype("<u4").tobytes())
                       for i, s, n, a, e in zip(doc_ids, starts, x.n_tokens, at, x.frame_ends, strict=True)
                       if wanted is None or i in wanted]
                if out:
                    ids, *rest = zip(*out, strict=True)
                    yield pd.DataFrame({"doc_id": nullable_longs(ids), **{n: list(c) for n, c in zip(("start", "n_tokens", "ids"), rest, strict=True)}})

    stored = stored.withColumns({"known": F.transform("doc_ids", F.isnotnull), "doc_ids": F.transform("doc_ids", lambda i: F.coalesce(i, F.lit(0)))})
    return stored.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids binary")


# -- query ---------------------------------------------------------------------------------------

def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token-id files (end id 0) and digest what is read back from them."""
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
