"""Packing of documents into sequences by Karmarkar-Karp multiway differencing (operator 8).

Documents longer than a sequence first fill whole sequences. The remainders are dealt into groups
of WINDOWS sequences' worth of ids; the smallest remainders of a group are cut into short pieces
that can even out differences. Differencing starts with one partial partition for each piece (one
window holds it, the others are empty) and again and again merges the two partitions with the
widest spread, the fullest windows of one with the emptiest of the other, until one partition with
near-equal windows is left. If its fullest window exceeds the capacity, the number of windows
rises by one and the group is differenced again.

Groups are made inside a task from the rows of its partition, so no shuffle is needed and memory
is bounded by one group and one Arrow batch, whatever the size of the table or of a source. The ids that
are left at the end of a partition, less than one sequence, are cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import nullable_longs, table
from territory_engine.llm.tokens import encoder

#: Ids in a sequence at most; sequences of a group; ids of a sequence that a group plans with.
CAPACITY, WINDOWS, PLANNED = 2048, 64, 2044
#: Shares of a group's ids that are cut into short pieces, and their lengths; smallest pieces first.
FINE = ((0.005, 8), (0.15, 64))

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Members (indexes of ``sizes``) of each of ``k`` windows with near-equal sums.

    A partial partition lists its non-empty windows, fullest first, as (sum, members); members are
    nested pairs until the end.
    """
    tie = itertools.count()
    heap = [(-s, next(tie), [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - k)  # so many windows get something from both
        alone = len(a) - over
        b = b[::-1]
        both = [(x + y, (m, n)) for (x, m), (y, n) in zip(a[alone:], b[:over], strict=True)]
        merged = sorted(a[:alone] + both + b[over:], key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, next(tie), merged))
    windows = []
    for _, nested in heap[0][2] if heap else []:
        members, todo = [], [nested]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                members.append(x)
        windows.append(sorted(members))
    return windows


def fine_cut(pieces: list[tuple], tiers: tuple = FINE) -> list[tuple]:
    """The smallest pieces (doc, start, length), up to each tier's share of all ids, cut to its length."""
    total, out, left = sum(p[2] for p in pieces), [], list(tiers)
    budget = left[0][0] * total if left else 0
    for doc, start, length in sorted(pieces, key=lambda p: (p[2], p[1])):
        if not left:
            out.append((doc, start, length))
            continue
        fine = left[0][1]
        out += [(doc, start + i, min(fine, length - i)) for i in range(0, length, fine)]
        budget -= length
        if budget <= 0:
            left.pop(0)
            budget = left[0][0] * total if left else 0
    return out


def windows_of(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Windows of at most ``capacity`` ids; their number rises until differencing keeps to it."""
    sizes = [p[2] for p in pieces]
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return [[pieces[i] for i in w] for w in dealt]
        k += 1


def powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """All pieces in sequences whose lengths are different powers of two."""
    left, total, out = list(pieces), sum(p[2] for p in pieces), []
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        window = []
        while room:
            doc, start, length = left.pop()
            take = min(room, length)
            window.append((doc, start, take))
            if take < length:
                left.append((doc, start + take, length - take))
            room -= take
        out.append(window)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, windows: int = WINDOWS,
         planned: int = PLANNED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary).

    Null texts are empty documents of the end id alone; null and repeated ids keep their rows
    apart. ``ids`` are little-endian unsigned 32-bit. Sequence ids are unique, the offsets of a
    sequence run from zero without gaps. Other columns are not read; an empty table gives none.
    """
    if not 0 < planned <= capacity:
        raise ValueError("planned must be positive and at most capacity")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (document, start, length) of the open group
        size = 0
        rows: list[tuple] = []

        def place(dealt: list[list[tuple]]) -> None:
            nonlocal sequence
            for window in dealt:
                offset = 0
                for (doc_id, ids), start, length in window:
                    rows.append((doc_id, start, length, len(ids) // 4, sequence, offset, ids[4 * start:4 * (start + length)]))
                    offset += length
                sequence += 1

        def frame() -> pd.DataFrame:
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            out = pd.DataFrame({n: nullable_longs(c) if n == "doc_id" else list(c) for n, c in zip(names, columns, strict=True)})
            rows.clear()
            return out

        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for doc_id, known, raw in zip(b["id"].tolist(), b["known"], encoder(tokenizer_path).encode_all(b["text"]), strict=True):
                doc = (doc_id if known else None, raw + end)
                n = len(doc[1]) // 4
                whole = n // capacity * capacity
                place([[(doc, i, capacity)] for i in range(0, whole, capacity)])
                while whole < n:
                    take = min(n - whole, windows * planned - size)
                    held.append((doc, whole, take))
                    whole, size = whole + take, size + take
                    if size == windows * planned:
                        place(windows_of(fine_cut(held), capacity))
                        held, size = [], 0
                if len(rows) >= 4096:
                    yield frame()
        # the open group: as many planned windows as it fills, then powers of two
        full, body = size // planned * planned, []
        while held and full:
            doc, start, length = held.pop(0)
            take = min(full, length)
            body.append((doc, start, take))
            full -= take
            if take < length:
                held.insert(0, (doc, start + take, length - take))
        if body:
            place(windows_of(fine_cut(body), capacity))
        place(powers_of_two(held))
        yield frame()

    # null ids travel as a flag, as pandas would turn long integers with nulls into doubles
    doc_id = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNotNull().alias("known"), F.col(text_col).alias("text")).mapInPandas(
        task, PIECE)


# -- query ---------------------------------------------------------------------------------------

def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents (end id 1) in sequences of at most 2048 ids."""
    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
