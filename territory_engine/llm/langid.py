"""Language identification by cross-parsing (operator 3).

For each language a suffix automaton is built over labelled text. A text is parsed against an
automaton by longest matches: follow transitions as long as there is one, else a phrase ends and
the next starts at the root. A language's normalised phrase count is its phrases times the bits
that point into its training text (log2 of its length), per byte parsed; the smallest wins.

Texts are lower-cased, everything but letters becomes one space, and the UTF-8 bytes are parsed, so
any script has at most 256 symbols. A text is parsed whole, in segments of SEGMENT bytes that end
a phrase; the segments of many texts advance together through the automata of all languages as
numpy arrays.

The labelled sample is bounded by SAMPLE_BYTES a language, out of the first SAMPLE_DOC_CHARS
characters of documents; it is the only thing that is gathered.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import fold_of, table

#: Labelled text of one language at most, and the most that is taken of one document (from its first letter on).
SAMPLE_BYTES, SAMPLE_DOC_CHARS = 40_000, 20_000
#: Distinct texts of one language that are looked at for the sample (about; chosen by a hash).
SAMPLE_DOCS = 200
#: Sampled texts that a task remembers, to hand on one of many copies.
REMEMBERED = 100_000
#: Bytes of the parts of labelled text that are checked against their label.
CHECKED = 256
#: Bytes of a segment; segments that advance together.
SEGMENT, TOGETHER = 1024, 4096
#: Languages whose sampling shares (a few bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000
UNKNOWN = "und"
#: Above so many phrases a byte in the best language, a text is in none that was learned.
STRANGE = 0.6

NOT_LETTERS = re.compile(r"[\W\d_]+")
RESULT = "lang_pred string, score double, phrases_per_byte double"


def normal(text: str | None) -> bytes:
    """Lower-case letters with single spaces, as UTF-8; empty if there is no letter."""
    if not text:
        return b""
    kept = NOT_LETTERS.sub(" ", text.lower()).strip()
    return kept.encode("utf-8", "surrogatepass") if any(map(str.isalpha, kept)) else b""


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``text``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class CrossParser:
    """Phrase counts of many texts in all languages."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in samples]
        used = sorted(set().union(*(set(t) for _, t in samples)))
        self.symbol = np.full(256, len(used), dtype=np.int64)  # the last symbol has no transitions
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        tables, self.roots, first = [], [], 0
        for _, text in samples:
            states = suffix_automaton(text)
            dense = np.full((len(states), self.width), -1, dtype=np.int32)
            for s, out in enumerate(states):
                for c, to in out.items():
                    dense[s, self.symbol[c]] = to + first
            tables.append(dense)
            self.roots.append(first)
            first += len(states)
        self.next = np.concatenate(tables).ravel()
        roots = np.array(self.roots, dtype=np.int64)
        self.restart = np.stack([np.where(t[0] < 0, r, t[0]) for t, r in zip(tables, roots, strict=True)])
        self.bits = np.array([math.log2(len(t) + 1) for _, t in samples])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(language, text) phrase counts."""
        out = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        owner, pieces = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), SEGMENT):
                owner.append(i)
                pieces.append(t[at:at + SEGMENT])
                if len(pieces) == TOGETHER:
                    np.add.at(out, (slice(None), np.array(owner)), self._parse(pieces))
                    owner, pieces = [], []
        if pieces:
            np.add.at(out, (slice(None), np.array(owner)), self._parse(pieces))
        return out

    def _parse(self, pieces: list[bytes]) -> np.ndarray:
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")
        width = int(size.max())
        joined = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), dtype=np.uint8)
        symbols = self.symbol[joined].reshape(len(pieces), width).T.copy()
        active = np.searchsorted(-size[order], -np.arange(width), side="left")
        roots = np.array(self.roots, dtype=np.int64)[:, None]
        state = np.repeat(roots, len(pieces), axis=1)
        count = np.zeros(state.shape, dtype=np.int64)
        for j in range(width):
            n = active[j]
            c = symbols[j, :n]
            to = self.next.take(state[:, :n] * self.width + c)
            ends = to < 0
            count[:, :n] += ends | (state[:, :n] == roots)  # a phrase begins; a foreign byte is one of its own
            state[:, :n] = np.where(ends, self.restart.take(c, axis=1), to)
        back = np.empty_like(count)
        back[:, order] = count
        return back

    def classify(self, texts: list[str | None]) -> pd.DataFrame:
        plain = [normal(t) for t in texts]
        size = np.array([len(t) for t in plain], dtype=np.float64)
        known = (size > 0) & (len(self.langs) > 0)
        phrases = self.phrases(plain) / np.maximum(size, 1)
        cost = phrases * self.bits[:, None]
        order = np.argsort(cost, axis=0, kind="stable")
        at = np.arange(len(plain))
        best = cost[order[0], at]
        second = cost[order[min(1, len(order) - 1)], at]
        score = np.where(known, second / np.maximum(best + second, 1e-300), 0.0)
        return pd.DataFrame({"lang_pred": np.where(known, np.array(self.langs, dtype=object)[order[0]], UNKNOWN),
                             "score": score, "phrases_per_byte": np.where(known, phrases[order[0], at], 0.0)})


@functools.lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, bytes], ...]) -> CrossParser:
    """The worker's automata."""
    return CrossParser(samples)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, bytes], ...]:
    """Bounded labelled text of each language, as (language, normal text), in order of the language.

    Texts are chosen by a hash, at a share of the language's distinct texts, so copies change
    nothing. Rows with a null text or language or without a letter are left out; of long texts the
    first SAMPLE_DOC_CHARS characters from the first letter on are taken. Every language with a
    labelled letter is learned.
    """
    own = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["count"] for r in own.select("lang", "h").distinct().groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return ()
    shares = docs.sparkSession.createDataFrame(
        [(lang, int(min(1.0, SAMPLE_DOCS / n) * (1 << 30))) for lang, n in counts.items()], "lang string, share long")
    part = F.when(F.length("text") > SAMPLE_DOC_CHARS, F.substring(F.regexp_replace("text", r"\A\P{L}++", ""), 1, SAMPLE_DOC_CHARS)).otherwise(F.col("text"))

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            new = []
            for key in zip(b["lang"], b["h"], strict=True):
                new.append(key not in seen)
                seen.add(key)
            yield b[np.array(new, dtype=bool)]

    picked = (own.join(F.broadcast(shares) if len(counts) <= MOST_BROADCAST else shares, "lang").filter(F.pmod("h", F.lit(1 << 30)) <= F.col("share"))
              .select("lang", "h", part.alias("text")).mapInPandas(once, "lang string, h long, text string")
              .groupBy("lang", "h").agg(F.min("text").alias("text")))
    taken: dict[str, list[bytes]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"])):
        had = taken.setdefault(r["lang"], [])
        if sum(map(len, had)) < 2 * SAMPLE_BYTES:
            had.append(normal(r["text"]))
    return agreed(taken)


def agreed(taken: dict[str, list[bytes]]) -> tuple[tuple[str, bytes], ...]:
    """Samples without the parts of documents that are in another language than their label.

    The documents of each language are dealt into two halves; the parts of one half stay if
    automata of the other half give their label. Where nothing stays, all is kept.
    """
    parts = {lang: [[t[i:i + CHECKED] for t in texts[h::2] for i in range(0, len(t), CHECKED)] for h in (0, 1)]
             for lang, texts in sorted(taken.items())}
    samples = []
    for lang, halves in parts.items():
        kept = []
        for h in (0, 1):
            other = [(x, b" ".join(p[1 - h])[:SAMPLE_BYTES]) for x, p in parts.items()]
            if not halves[h] or not all(t.strip() for _, t in other):
                kept += halves[h]
                continue
            judge = parser(tuple(other))
            cost = judge.phrases(halves[h]) * judge.bits[:, None]
            right = cost.argmin(axis=0) == judge.langs.index(lang)
            kept += [t for t, ok in zip(halves[h], right, strict=True) if ok]
        text = b" ".join(kept or halves[0] + halves[1])[:SAMPLE_BYTES]
        if text.strip():
            samples.append((lang, text))
    return tuple(samples)


def identify(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and phrases_per_byte added (replaced if present).

    ``und`` with score 0 for null texts, texts without a letter, or if no language was learned. The
    score is the runner-up's share of the two smallest normalised phrase counts (0.5 on a tie, which
    the first language in order wins). Every row gives one row.
    """

    @F.pandas_udf(RESULT)
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            if samples:
                yield pd.concat([parser(samples).classify(list(s.iloc[i:i + 512])) for i in range(0, max(1, len(s)), 512)], ignore_index=True)
            else:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(s), "score": 0.0, "phrases_per_byte": 0.0})

    added = ("lang_pred", "score", "phrases_per_byte")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    found = docs.select(*kept, classify(F.col(f"`{text_col}`")).alias("__found"))
    return found.select(*kept, *[F.col(f"__found.{c}").alias(c) for c in added])


# -- query ---------------------------------------------------------------------------------------

def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return docs.filter(fold_of(F.col("doc_id"), 5) != 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    samples = learn(training_rows(docs))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
