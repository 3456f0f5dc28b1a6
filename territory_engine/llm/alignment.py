"""Cross-tokenizer alignment (operator 13).

Every text is encoded by a byte-level BPE (A, with a space before the text) and by a piece BPE with byte
fallback (B, which adds that space itself). Both cut the same bytes, so tokens are aligned by byte
offsets: offsets where tokens of both end cut them into groups, and a pair of overlapping tokens is a
link. Between two neighbouring token ends of either side lies exactly one link.

Ids are written once. A first pass over them aligns the documents and gathers, task by task, how many
documents hold each distinct (A id, B id) pair. The distinct pairs get a minimal perfect hash, built in
buckets of bounded size; each bucket's counts are dense vectors indexed by the hash, summed in a tree of
at most FAN vectors at a time, beside the vector of its keys. A second pass aligns the documents again and
looks every link up: its index, the key stored there to verify it, its count. The index goes to the
tasks in parts of at most PART pairs; if there are more, the second pass runs once for each part and its
sums are added up, so nothing of unbounded size is ever broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from territory_engine.llm.common import nullable_longs, table, written
from territory_engine.llm.minimalhash import MinimalHash, mixed
from territory_engine.llm.tokens import WordIds, byte_alphabet, encoder, first_characters, of_texts, words_at

#: Pairs of a bucket on average, vectors summed at a time, pairs of the index that a task holds (and a bucket more).
BUCKET, FAN, PART = 24_000, 16, 4_000_000
#: A pair's cell, by a hash that no level of the minimal hash uses; buckets are runs of cells.
CELLS, CELL_SEED = 1 << 16, 1 << 20
#: Tokens of one side aligned at a time, and pairs that a task gathers before it emits them.
PORTION, GATHERED = 1 << 16, 1_000_000
#: Characters of a text that B encodes at a time, cut before a single space where pieces never join.
CUT_CHARS = 1 << 19
CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")

ENCODED = "row long, id long, known boolean, a binary, b binary"
RESULT = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
          "groups string")


def a_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    tokenizer = Tokenizer.from_file(path)
    level = {c: b for b, c in byte_alphabet().items()}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(level[c] for c in token) if all(c in level for c in token) else token.encode()
    for i, t in tokenizer.get_added_tokens_decoder().items():
        out[i] = t.content.encode()
    return out


def b_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: U+2581 is a space, <0xHH> a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]


@dataclass
class Sides:
    """Both vocabularies as tables, kept by a worker."""

    a: list[bytes]
    b: list[bytes]

    def __post_init__(self):
        self.a_length, self.b_length = (np.array([len(t) for t in side], dtype=np.int64) for side in (self.a, self.b))
        most = max(len(self.a), len(self.b))
        self.kind = "<u2" if most <= 1 << 16 else "<u4"  # of packed ids
        self.digits = np.zeros((most, len(str(most))), dtype=np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(most)])
        for i in range(most):
            self.digits[i, :self.n_digits[i]] = np.frombuffer(str(i).encode(), dtype=np.uint8)


@functools.cache
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_bytes(a_path), b_bytes(b_path))


class PieceEncoder:
    """B's ids of texts (little-endian unsigned 32-bit).

    Merges never join across the border between a character and a space, as no piece has a space behind another
    character, so each distinct run of spaces and what follows it is encoded once, and its ids are kept. The model
    adds a space before what it encodes: that is the run's first one, for a text's first run the one it
    adds to the text. Texts with U+2581, which the model takes for a space, are encoded as they are.
    """

    def __init__(self, path: str):
        self.model, self.words = sentencepiece.SentencePieceProcessor(model_file=path), WordIds()
        self.space = [self.model.piece_to_id("▁")]

    def _new(self, words: list[bytes]) -> Iterator[list[int]]:
        for i in range(0, len(words), 512):
            texts = [w[1:].decode() for w in words[i:i + 512]]
            for text, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
                yield ids if text else self.space  # a space alone at the end of a text

    def _together(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        blank = codes == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        starts = np.flatnonzero(begins | first_characters(texts))
        ids, size = self.words.gather(words_at(joined, codes, starts), self._new)
        return of_texts(texts, starts, ids, size)

    def _pieces(self, text: str) -> Iterator[str]:
        """A long text, a space before it, in pieces that begin with a space behind another character."""
        start = 0
        while len(text) - start > CUT_CHARS:
            cut = CUT.search(text, start + CUT_CHARS)
            if not cut:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that are not empty."""
        group, held = [], 0
        for text in texts:
            if "▁" in text or len(text) >= CUT_CHARS:
                yield from self._together(group)
                group, held = [], 0
                if "▁" in text:
                    yield np.array(self.model.encode(text), dtype="<u4").tobytes()
                else:
                    yield b"".join(x for p in self._pieces(" " + text) for x in self._together([p]))
                continue
            group.append(" " + text)
            held += len(text)
            if held >= CUT_CHARS:
                yield from self._together(group)
                group, held = [], 0
        yield from self._together(group)


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, id, known, a, b) of (id, known, text): packed unsigned ids; empty if the bytes are not those of the text."""

    def both(texts: list[str | None], s: Sides) -> Iterator[tuple[bytes, bytes]]:
        join = b"".join
        all_a = encoder(a_path, True).encode_all(" " + t for t in texts if t)
        all_b = piece_encoder(b_path).encode_all([t for t in texts if t])
        for text in texts:
            if not text:
                yield b"", b""
                continue
            want, a, b = b" " + text.encode(), np.frombuffer(next(all_a), dtype="<u4"), np.frombuffer(next(all_b), dtype="<u4")
            same = want == join(map(s.b.__getitem__, b.tolist())) and want == join(map(s.a.__getitem__, a.tolist()))
            yield (a.astype(s.kind).tobytes(), b.astype(s.kind).tobytes()) if same else (b"", b"")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, s = TaskContext.get().partitionId() << 33, sides(a_path, b_path)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i:i + 500]
                a, b = zip(*both(part["text"].tolist(), s), strict=True)
                yield pd.DataFrame({"row": np.arange(row, row + len(part)), "id": part["id"].to_numpy(), "known": part["known"].to_numpy(),
                                    "a": list(a), "b": list(b)})
                row += len(part)

    return texts.mapInPandas(task, ENCODED)


@dataclass
class Aligned:
    """Pieces of documents that follow each other, aligned: tokens, links (indexes of both sides' tokens) and groups."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    a_closes: np.ndarray  # does the token end its group
    b_closes: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


def align(a: np.ndarray, b: np.ndarray, s: Sides) -> Aligned:
    """Both sides must cover the same bytes."""
    a_ends, b_ends = np.cumsum(s.a_length[a]), np.cumsum(s.b_length[b])
    size = int(a_ends[-1]) + 1 if len(a) else 1
    a_mark, b_mark = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    a_mark[a_ends], b_mark[b_ends] = True, True
    at = np.flatnonzero(a_mark | b_mark)
    in_a, in_b = a_mark[at], b_mark[at]
    shared = in_a & in_b
    group = np.cumsum(shared) - shared
    return Aligned(a, b, np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, b_mark[a_ends], a_mark[b_ends], group[in_a], group[in_b])


def written_groups(x: Aligned, s: Sides) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;`` one after the other, and the end of each A token's group in it (bytes)."""
    a_last, b_last = np.flatnonzero(x.a_closes), np.flatnonzero(x.b_closes)
    b_before = np.append(0, b_last + 1)[x.a_group]
    a_place = np.arange(len(x.a)) + b_before
    b_place = np.arange(len(x.b)) + (a_last + 1)[x.b_group]
    ids = np.empty(len(x.a) + len(x.b), dtype=np.int64)
    sign = np.empty(len(ids), dtype=np.uint8)
    ids[a_place], ids[b_place] = x.a, x.b
    sign[a_place] = np.where(x.a_closes, ord("|"), ord(","))
    sign[b_place] = np.where(x.b_closes, ord(";"), ord(","))
    length = s.n_digits[ids]
    wide = s.digits.shape[1]
    cells = np.empty((len(ids), wide + 1), dtype=np.uint8)
    cells[:, :wide] = s.digits[ids]
    cells[np.arange(len(ids)), length] = sign
    text = cells[np.arange(wide + 1) <= length[:, None]].tobytes()
    ends = np.cumsum(length + 1)
    return text, ends[b_place[b_last]]


def pieces(docs: Iterable[tuple[bytes, bytes]], s: Sides) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, bool]]:
    """(index, a, b, first, last) of each document with tokens; long ones are cut at shared token ends."""
    for i, (raw_a, raw_b) in enumerate(docs):
        a, b = np.frombuffer(raw_a, dtype=s.kind), np.frombuffer(raw_b, dtype=s.kind)
        if len(a) <= PORTION:
            if len(a):
                yield i, a, b, True, True
            continue
        a_ends, b_ends = np.cumsum(s.a_length[a]), np.cumsum(s.b_length[b])
        shared = np.flatnonzero(np.isin(a_ends, b_ends, assume_unique=True))  # the last token is among them
        cuts = np.unique(np.append(shared[np.searchsorted(shared, np.arange(PORTION, len(a), PORTION))], len(a) - 1))
        b_cuts = np.searchsorted(b_ends, a_ends[cuts])
        a_from = b_from = 0
        for a_to, b_to in zip((cuts + 1).tolist(), (b_cuts + 1).tolist(), strict=True):
            yield i, a[a_from:a_to], b[b_from:b_to], a_from == 0, a_to == len(a)
            a_from, b_from = a_to, b_to


def portions(docs: Iterable[tuple[bytes, bytes]], s: Sides) -> Iterator[tuple[np.ndarray, np.ndarray, Aligned, bool]]:
    """(documents, their A tokens, alignment, last) of portions that hold whole documents or a piece of one."""

    def flush(held: list) -> tuple[np.ndarray, np.ndarray, Aligned, bool]:
        docs, a, b, _, last = zip(*held, strict=True)
        return np.array(docs), np.array([len(x) for x in a]), align(np.concatenate(a), np.concatenate(b), s), last[-1]

    held, size = [], 0
    for piece in pieces(docs, s):
        part = not (piece[3] and piece[4])
        if held and (part or size + len(piece[1]) > PORTION):
            yield flush(held)
            held, size = [], 0
        if part:
            yield flush([piece])
        else:
            held.append(piece)
            size += len(piece[1])
    if held:
        yield flush(held)


def merged(gathered: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in gathered]), return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in gathered]))
    return keys, total


def pairs_of(x: Aligned, s: Sides) -> np.ndarray:
    """The pair of every link as one integer."""
    return x.a[x.link_a].astype(np.int64) * len(s.b) + x.b[x.link_b]


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """First pass: (task, cell, pair, n), the documents of a task that hold a link of each pair."""
    bits = (len(sides(a_path, b_path).a) * len(sides(a_path, b_path).b)).bit_length()
    if bits > 40:
        raise ValueError("a document's number in its portion and a pair must fit 63 bits")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, number = sides(a_path, b_path), TaskContext.get().partitionId()
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        open_pairs = np.empty(0, dtype=np.int64)  # of a document that has more pieces

        def frame() -> pd.DataFrame:
            keys, n = merged(gathered)
            gathered.clear()
            cell = (mixed(keys, CELL_SEED) % np.uint64(CELLS)).astype("int32")
            return pd.DataFrame({"task": np.full(len(keys), number, dtype="int32"), "cell": cell, "pair": keys, "n": n})

        for batch in batches:
            for docs_here, lengths, x, last in portions(zip(batch["a"], batch["b"], strict=True), s):
                pair = pairs_of(x, s)
                if not last or len(open_pairs):
                    open_pairs = np.union1d(open_pairs, pair)
                    if last:
                        gathered.append((open_pairs, np.ones(len(open_pairs), dtype=np.int64)))
                        open_pairs = open_pairs[:0]
                    continue
                place = np.repeat(np.arange(len(docs_here)), lengths)[x.link_a]
                once = np.unique((place << bits) | pair) & ((1 << bits) - 1)
                gathered.append(np.unique(once, return_counts=True))
                if sum(len(k) for k, _ in gathered) > GATHERED:
                    gathered[:] = [merged(gathered)]
                    if len(gathered[0][0]) > GATHERED // 2:
                        yield frame()
        if gathered:
            yield frame()

    return docs.select("a", "b").mapInPandas(task, "task int, cell int, pair long, n long")


def build_index(partial: DataFrame) -> DataFrame:
    """(bucket, buckets, sizes, bits, keys, counts): of each bucket of distinct pairs its minimal perfect hash, and
    keys and counts in the order of the hash."""
    totals = partial.agg(F.approx_count_distinct("pair", 0.02).alias("n"), F.max("task").alias("task")).first()
    buckets = min(CELLS, max(1, math.ceil((totals["n"] or 0) / BUCKET)))
    slices = max(1, math.ceil(((totals["task"] or 0) + 1) / FAN))
    rows = partial.withColumn("bucket", F.floor(F.col("cell").cast("long") * buckets / CELLS).cast("int"))

    def hashed(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["pair"].to_numpy()
        found = MinimalHash.build(keys)
        ordered = np.empty(len(keys), dtype="<i8")
        ordered[found.index(keys)] = keys
        sizes, bits = found.dump()
        return pd.DataFrame([{"bucket": int(group["bucket"].iloc[0]), "sizes": sizes, "bits": bits, "keys": ordered.tobytes()}])

    hashes = written(rows.select("bucket", "pair").distinct().groupBy("bucket").applyInPandas(
        hashed, "bucket int, sizes array<int>, bits binary, keys binary"), "pairs")

    def dense(group: pd.DataFrame, hash_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"bucket": [], "slice": [], "counts": []})
        h, pair = hash_rows.iloc[0], group["pair"].to_numpy()
        keys = np.frombuffer(h["keys"], dtype="<i8")
        at = MinimalHash.load(h["sizes"].tolist(), h["bits"]).index(pair)
        if not np.array_equal(keys[at], pair):
            raise ValueError("a pair is not at its index")
        vector = np.zeros(len(keys), dtype="<i8")
        np.add.at(vector, at, group["n"].to_numpy())
        return pd.DataFrame([{"bucket": int(h["bucket"]), "slice": int(h["slice"]), "counts": vector.tobytes()}])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = functools.reduce(np.add, (np.frombuffer(v, dtype="<i8") for v in group["counts"]))
        return pd.DataFrame([{"bucket": int(group["bucket"].iloc[0]), "slice": int(group["slice"].iloc[0]), "counts": total.tobytes()}])

    layout = "bucket int, slice int, counts binary"
    each = hashes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = rows.withColumn("slice", F.pmod("task", F.lit(slices)))
    vectors = sliced.groupBy("bucket", "slice").cogroup(each.groupBy("bucket", "slice")).applyInPandas(dense, layout)
    while slices > 1:
        slices = math.ceil(slices / FAN)
        vectors = vectors.withColumn("slice", F.pmod("slice", F.lit(slices))).groupBy("bucket", "slice").applyInPandas(add, layout)
    joined = hashes.join(vectors.select(F.col("bucket").alias("of"), "counts"), F.col("bucket") == F.col("of"))
    return written(joined.select("bucket", F.lit(buckets).alias("buckets"), "sizes", "bits", "keys", "counts"), "pair-index")


def highest_counts(index: DataFrame, a_path: str, b_path: str) -> np.ndarray:
    """The highest count of each A id's pairs: one number for each id of the vocabulary."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sides(a_path, b_path)
        most = np.zeros(len(s.a), dtype=np.int64)
        for b in batches:
            for keys, counts in zip(b["keys"], b["counts"], strict=True):
                np.maximum.at(most, np.frombuffer(keys, dtype="<i8") // len(s.b), np.frombuffer(counts, dtype="<i8"))
        held = np.flatnonzero(most)
        yield pd.DataFrame({"a": held, "n": most[held]})

    out = np.zeros(len(sides(a_path, b_path).a), dtype=np.int64)
    for r in index.select("keys", "counts").mapInPandas(task, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect():
        out[r["a"]] = r["n"]
    return out


class PairTable:
    """Some buckets of the index as arrays: a link's pair to its count."""

    def __init__(self, rows: list, buckets: int):
        self.buckets = buckets
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), dtype="<i8")
        self.counts = np.frombuffer(b"".join(r["counts"] for r in rows), dtype="<i8")
        hashes = [MinimalHash.load(r["sizes"], r["bits"]) for r in rows]
        depth = max((len(h.levels) for h in hashes), default=0)
        # of each level: places of a bucket (one that is never taken where it has none), the first of them, and the
        # index of the key in each place
        self.sizes, self.firsts = np.ones((depth, buckets), dtype=np.uint64), np.zeros((depth, buckets), dtype=np.int64)
        self.slots = []
        before = np.cumsum([0, *[h.size for h in hashes]])
        for level in range(depth):
            slots, at = [np.full(1, -1, dtype=np.int64)], 1
            for r, h, first in zip(rows, hashes, before, strict=False):
                if level < len(h.levels):
                    taken = h.levels[level]
                    self.sizes[level, r["bucket"]], self.firsts[level, r["bucket"]] = len(taken), at
                    slots.append(np.where(taken, first + h.firsts[level] + h.ranks[level], -1))
                    at += len(taken)
            self.slots.append(np.concatenate(slots).astype(np.int32))

    def count(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair; 0 for pairs that these buckets do not hold."""
        bucket = (mixed(pairs, CELL_SEED) % np.uint64(CELLS)).astype(np.int64) * self.buckets // CELLS
        out, at = np.zeros(len(pairs), dtype=np.int64), np.arange(len(pairs))
        for level, slots in enumerate(self.slots):
            if not len(at):
                break
            place = self.firsts[level][bucket[at]] + (mixed(pairs[at], level) % self.sizes[level][bucket[at]]).astype(np.int64)
            slot = slots[place]
            hit = slot >= 0
            out[at[hit]] = self.counts[slot[hit]] * (self.keys[slot[hit]] == pairs[at[hit]])
            at = at[~hit]
        return out


def second_pass(docs: DataFrame, a_path: str, b_path: str, known: PairTable, highest: np.ndarray, sums_only: bool = False,
                spans: bool = False) -> DataFrame:
    """Aligned documents, and what the links whose pairs are ``known`` add up to; with ``sums_only`` the rest is 0 or ''."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sides(a_path, b_path)
        for batch in batches:
            n = len(batch)
            n_a, n_b, n_groups, n_links, n_best, total = np.zeros((6, n), dtype=np.int64)
            digests = [hashlib.sha256() for _ in range(n)]
            texts: list[list[bytes]] = [[] for _ in range(n)]
            for docs_here, lengths, x, last in portions(zip(batch["a"], batch["b"], strict=True), s):
                doc = np.repeat(docs_here, lengths)
                of = doc[x.link_a]
                count = known.count(pairs_of(x, s))
                np.add.at(n_best, of[(count > 0) & (count == highest[x.a[x.link_a]])], 1)
                first = np.flatnonzero(np.diff(of, prepend=-1))
                total[of[first]] += np.add.reduceat(count, first)
                if sums_only:
                    continue
                closing = doc[x.a_closes]  # each group's document
                for counter, at in ((n_a, doc), (n_b, closing[x.b_group]), (n_groups, closing), (n_links, of)):
                    counter += np.bincount(at, minlength=n)
                text, ends = written_groups(x, s)
                start = 0
                for i, end in zip(docs_here.tolist(), ends[np.cumsum(x.a_closes)[np.cumsum(lengths) - 1] - 1].tolist(), strict=True):
                    piece = text[start:end - 1] if last else text[start:end]
                    digests[i].update(piece)
                    if spans:
                        texts[i].append(piece)
                    start = end
            yield pd.DataFrame({
                "row": batch["row"], "doc_id": nullable_longs(i if k else None for i, k in zip(batch["id"].tolist(), batch["known"], strict=True)),
                "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": n_best, "count_sum": total,
                "groups_sha256": [d.hexdigest() if c else "" for d, c in zip(digests, n_a, strict=True)],
                "groups": [b"".join(t).decode() if spans else None for t in texts]})

    return docs.mapInPandas(task, RESULT)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False,
                 part: int = PART) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with ``spans``, groups.

    ``count_sum`` adds up, over the document's links, how many documents hold a link of that pair of ids;
    ``n_best`` counts the links whose pair has the highest such number of its A id, ties included. Null
    and empty texts, and texts whose tokens are not their bytes, have no tokens: zeros and ''. Repeated
    rows and ids are documents of their own, null ids stay null; an empty table gives no rows. Other columns
    are not read, so their names cannot clash.
    """
    doc_id = F.col(id_col).cast("long")
    # null ids travel as a flag, as pandas would turn long integers with nulls into doubles
    rows = written(encoded(docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNotNull().alias("known"), F.col(text_col).alias("text")),
                           a_path, b_path), "encoded")
    index = build_index(written(pair_counts(rows, a_path, b_path), "pair-counts"))
    highest = highest_counts(index, a_path, b_path)
    sizes = index.select("bucket", "buckets", (F.length("keys") / 8).cast("long").alias("n")).orderBy("bucket").collect()  # at most CELLS rows
    parts, held = [[]], 0
    for r in sizes:
        if held >= part:
            parts.append([])
            held = 0
        parts[-1].append(r["bucket"])
        held += r["n"]
    buckets = sizes[0]["buckets"] if sizes else 1
    results = []
    for i, wanted in enumerate(parts):
        # at most PART pairs and one bucket
        here = index.filter(F.col("bucket").between(wanted[0], wanted[-1])).collect() if wanted else []
        results.append(second_pass(rows, a_path, b_path, PairTable(here, buckets), highest, sums_only=i > 0, spans=spans))
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if spans else [])]
    if len(results) == 1:
        return results[0].select(out)
    # sums of several parts: one row of a few numbers a document and part
    more = functools.reduce(DataFrame.unionByName, results[1:]).groupBy(F.col("row").alias("of")).agg(
        F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    joined = results[0].join(more, F.col("row") == F.col("of"))
    return joined.withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")}).select(out)


# -- query ---------------------------------------------------------------------------------------

def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the byte-level and the piece vocabulary, with corpus-wide pair counts."""
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("piece_bpe_32k.model"))
