"""SimHash near-duplicates with a Gray-order hierarchical index (operator 7).

Fingerprints: one bit per position of the XXH64 hashes of all word shingles of a text, set if it
is set in more than half of them. Equal fingerprints collapse to one node before any search.

Search: two fingerprints that differ in at most ``d`` bits agree on at least one of ``d + 1``
disjoint bit blocks. A top node of the index is a pair (mask, pattern): the fingerprints that
share the masked bits. Every fingerprint enters the node of each block mask; a node that is too
large is split by masks of the remaining bits in the same way, and what is still too large after
the last split is compared portion by portion (every two portions meet in a task of their own), so
no node ever has to fit into one task whole and no pair is lost. Inside a node the fingerprints
are sorted by Gray rank, consecutive ones form groups with their shared bits factored out into
(mask, pattern), those form larger groups, and two groups are compared by the differing bits that
their masks have in common: these accumulate downwards, so as soon as they exceed ``d`` all
pairs below are pruned at once.

What leaves a task is a spanning forest of the links it found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from territory_engine.llm.common import local_roots, table, written
from territory_engine.llm.components import components

BITS = 64
#: Fingerprints of a node that one task compares.
NODE_ROWS = 8192
#: Splits of too large nodes before portions are compared.
SPLITS = 2
#: Fingerprints of the lowest groups, and groups under one upper node.
LEAF, FANOUT = 32, 8


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a text; zero for null or no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [h(b" ".join(words), seed)]
    else:
        hashes = [h(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i:i + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    """Fingerprint of a text column as long, in Arrow batches."""

    @F.pandas_udf(T.LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, shingle) for t in s], dtype="int64")

    return fp(text)


def split_mask(rest: int, parts: int) -> list[int]:
    """The set bits of ``rest`` dealt into ``parts`` masks of neighbouring bits."""
    bits = [i for i in range(BITS) if rest >> i & 1]
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[cut[k]:cut[k + 1]]) for k in range(parts)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def gray_rank(x: Column) -> Column:
    """Position of a bit pattern in the Gray code sequence (signed long, same order of groups)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def group_level(first: np.ndarray, mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper nodes of groups of ``size``: the bits that are known and equal in all of a group."""
    at = np.arange(0, len(first), size)
    differ = np.bitwise_or.reduceat(first ^ np.repeat(first[at], np.diff(np.append(at, len(first)))), at)
    known = np.bitwise_and.reduceat(mask, at) & ~differ
    return first[at] & known, known


def close_pairs(fps: np.ndarray, bits: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of ``fps`` (sorted by Gray rank) that differ in at most ``bits`` bits, in portions.

    Descends from the top of the hierarchy with pairs of groups; a pair of groups goes on only if
    the differences in the bits that both fix have not exceeded ``bits``.
    """
    full = np.full(len(fps), ~np.uint64(0))
    levels, sizes = [(fps, full)], [1]
    while len(levels[-1][0]) > 1:
        size = LEAF if len(levels) == 1 else FANOUT
        levels.append(group_level(*levels[-1], size))
        sizes.append(size)
    stack = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        k, a, b = stack.pop()
        if k == 0:
            keep = a < b
            yield a[keep], b[keep]
            continue
        below, width = levels[k - 1], sizes[k]
        n, step = len(below[0]), max(1, chunk // (width * width))
        if len(a) > step:
            stack += [(k, a[i:i + step], b[i:i + step]) for i in range(0, len(a), step)]
            continue
        inner = np.arange(width)
        ca = (a[:, None, None] * width + inner[None, :, None] + np.zeros((1, 1, width), dtype=np.int64)).ravel()
        cb = (b[:, None, None] * width + inner[None, None, :] + np.zeros((1, width, 1), dtype=np.int64)).ravel()
        ok = (ca < n) & (cb < n) & (ca <= cb)
        ca, cb = ca[ok], cb[ok]
        pattern, known = below
        near = np.bitwise_count((pattern[ca] ^ pattern[cb]) & known[ca] & known[cb]) <= bits
        if near.any():
            stack.append((k - 1, ca[near], cb[near]))


def forest(fps: np.ndarray, part: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one node's fingerprints; only pairs of different portions if there are two."""
    order = np.argsort(_gray_np(fps), kind="stable")
    fps, part = fps[order], part[order]
    root = np.arange(len(fps))
    two = part.min() != part.max()
    for a, b in close_pairs(fps, bits):
        if two:
            cross = part[a] != part[b]
            a, b = a[cross], b[cross]
        root = local_roots(len(fps), a, b, root)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved].view(np.int64), fps[root[moved]].view(np.int64)


def _gray_np(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def search_sorted(bits: int):
    """mapInPandas function over rows (node, pair, part, fp) sorted by node and pair."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def search(rows: pd.DataFrame) -> pd.DataFrame:
            fps = rows["fp"].to_numpy().view(np.uint64)
            part, node, pair = rows["part"].to_numpy(), rows["node"].to_numpy(), rows["pair"].to_numpy()
            starts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (pair[1:] != pair[:-1])))
            length = np.diff(np.append(starts, len(fps)))
            run = np.repeat(np.arange(len(starts)), length)
            small = length <= LEAF
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for i in np.flatnonzero(~small):
                s = slice(starts[i], starts[i] + length[i])
                out.append(forest(fps[s], part[s], bits))
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            row = np.flatnonzero(small[run])
            for d in range(1, int(length[small].max(initial=1))):
                x, y = row[:-d], row[d:]
                near = (run[x] == run[y]) & (np.bitwise_count(fps[x] ^ fps[y]) <= bits)
                a.append(x[near])
                b.append(y[near])
            root = local_roots(len(fps), np.concatenate(a), np.concatenate(b))
            moved = np.flatnonzero(root != np.arange(len(fps)))
            out.append((fps[moved].view(np.int64), fps[root[moved]].view(np.int64)))
            return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = batch.iloc[-1]
            open_run = (batch["node"].to_numpy() == last["node"]) & (batch["pair"].to_numpy() == last["pair"])
            if open_run.all():
                continue  # the node goes on; at most two portions of NODE_ROWS are held
            rows = pd.concat(held)
            tail = int(open_run.sum())
            yield search(rows.iloc[:-tail])
            held = [rows.iloc[-tail:]]
        if held:
            yield search(pd.concat(held))

    return runs


def close_links(fps: DataFrame, bits: int, node_rows: int = NODE_ROWS, splits: int = SPLITS) -> DataFrame:
    """Links (a, b) between the distinct longs of column ``fp`` that span all groups within ``bits``.

    Two fingerprints are connected through the links exactly if a chain of pairs differing in at
    most ``bits`` bits joins them. ``fps`` is scanned more than once and should be a written table.
    """
    spark = fps.sparkSession
    blocks = bits + 1

    def node(mask: Column) -> Column:
        return F.xxhash64(mask, F.col("fp").bitwiseAND(mask))

    masks = split_mask((1 << BITS) - 1, blocks)
    level = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    done: list[DataFrame] = []
    for depth in range(splits + 1):
        level = level.withColumn("node", node(F.col("mask")))
        crowded = (level.groupBy("node").count().filter(F.col("count") > node_rows)
                   .select("node", (F.col("count") / node_rows + 1).cast("int").alias("portions")))
        crowded = written(crowded, "simhash-crowded")
        if crowded.isEmpty():
            done.append(level.select("node", F.lit(0).alias("pair"), F.lit(0).alias("part"), "fp"))
            break
        marked = level.join(crowded, "node", "left")
        done.append(marked.filter("portions is null").select("node", F.lit(0).alias("pair"), F.lit(0).alias("part"), "fp"))
        rest = marked.filter("portions is not null")
        if depth == splits:
            # portion p meets every portion q in the task (min(p, q), max(p, q)); p = q included
            part = F.pmod(F.xxhash64("fp"), F.col("portions")).cast("int")
            cut = rest.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
            done.append(cut.select("node", (F.least("part", "with") * F.col("portions") + F.greatest("part", "with") + 1)
                                   .cast("int").alias("pair"), "part", "fp"))
            break
        children = spark.createDataFrame(
            [(signed(m), signed(m | c)) for m in masks for c in split_mask(((1 << BITS) - 1) & ~m, blocks)], "mask long, child long")
        # a fixed table of at most (bits + 1) ** 3 masks
        level = rest.select("fp", "mask").join(F.broadcast(children.distinct()), "mask").select("fp", F.col("child").alias("mask"))
        masks = sorted({m | c for m in masks for c in split_mask(((1 << BITS) - 1) & ~m, blocks)})
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    dealt = rows.repartition("node", "pair").sortWithinPartitions("node", "pair", gray_rank(F.col("fp")))
    return dealt.mapInPandas(search_sorted(bits), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int, bits: int, id_col: str = "doc_id", text_col: str = "text",
                   node_rows: int = NODE_ROWS, splits: int = SPLITS) -> DataFrame:
    """Per row: id, fingerprint (long) and the smallest id of its group of near-duplicates.

    Null and word-less texts have fingerprint zero and are linked like any other; repeated ids and
    rows each give a row; rows with a null id take part, and the group's id is the smallest
    non-null one (null if there is none). An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "simhash-fp")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-distinct")
    roots = components(close_links(distinct, bits, node_rows, splits), "simhash")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = written(member.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-member")
    return rows.join(member, "fp").select("id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id, then the smallest row hash.

    Columns, their order and extra columns are kept. Rows that are repeated as a whole count as
    one group like any other copies.
    """
    names = docs.columns
    cols = [F.col(f"`{c}`") for c in names]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in cols])  # hashes skip nulls
    keyed = docs.select(F.struct(*cols).alias("row"), F.xxhash64(nulls, *cols).alias("h1"), F.xxhash64(F.lit(1), nulls, *cols).alias("h2"))
    rows = written(keyed.select(F.col(f"row.`{id_col}`").alias("id"), "h1", "h2",
                                fingerprint_column(F.col(f"row.`{text_col}`"), shingle).alias("fp")), "simhash-fp")
    distinct = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")).alias("first")),
                       "simhash-distinct")
    roots = components(close_links(distinct, bits), "simhash")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    stays = written(member.groupBy("root").agg(F.min("first").alias("first")).select("first.h1", "first.h2"), "simhash-stays")
    return keyed.join(stays, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


# -- query ---------------------------------------------------------------------------------------

def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, fingerprints at 3 or fewer bits."""
    out = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
