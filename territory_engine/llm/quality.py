"""Quality classifier: a generalised additive model with pairwise interactions (operator 12).

A document is described by numbers that are ratios of counts over its whole text. Each feature has a
lookup table over quantile bins, and each chosen pair of features one over their joint bins. Cyclic
boosting fills them: round after round, every feature in turn gets a shallow tree fitted to the
logistic loss's gradient on its bins, whose leaf values are added to the table at a small rate; then the
pairs that explain most of what is left are boosted in the same way with trees of one cut an axis. A
score is the logistic function of the sum of a document's table entries, gathered for all documents of
a batch at once.

What is gathered for fitting are the features of at most SAMPLE labelled documents of each class,
chosen by a hash of the id and weighted back to the classes' true shares. Scoring is one pass without a
shuffle; a text is counted in portions, so its length does not bound the memory.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import fold_of, table

#: Labelled documents of each class that the model is fitted on at most.
SAMPLE = 4_000
#: Bins of a feature, bins of it in a pair, pairs, rounds of features and of pairs, leaves by depth, rate, ridge.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, DEPTH, RATE, RIDGE = 48, 12, 6, 150, 40, 2, 0.1, 1.0
#: A leaf's share of the sample at least.
LEAST_LEAF = 0.002
#: A document is of good quality from this score on.
THRESHOLD = 0.7
#: Characters counted at a time.
PORTION = 1 << 20

FEATURES = ("log_chars", "word_length", "letters", "upper", "digits", "punctuation", "symbols", "spaces", "distinct_words",
            "repeated_neighbours", "log_line_words", "short_words", "capitalised_words", "words_without_letter", "words_ending_in_symbol")
#: Classes of characters.
SYMBOL, LOWER, UPPER, DIGIT, SPACE, LINE, PUNCTUATION = range(7)
RESULT = "score double, predicted int"


def class_of(char: str) -> int:
    if char == "\n":
        return LINE
    if char.isspace():
        return SPACE
    kind = unicodedata.category(char)
    if kind in ("Lu", "Lt"):
        return UPPER
    if kind[0] in "LM":
        return LOWER
    if kind[0] == "N":
        return DIGIT
    return PUNCTUATION if char in ".,;:'\"?!-()’“”«»…。、，" else SYMBOL


@functools.cache
def classes() -> np.ndarray:
    """The class of every character of the first planes of scripts."""
    return np.array([class_of(chr(c)) for c in range(0x3000)], dtype=np.uint8)


def classified(codes: np.ndarray) -> np.ndarray:
    known = classes()
    out = known[np.minimum(codes, len(known) - 1)]
    rare = codes >= len(known)
    if rare.any():
        distinct, at = np.unique(codes[rare], return_inverse=True)
        out[rare] = np.array([class_of(chr(c)) for c in distinct.tolist()], dtype=np.uint8)[at]
    return out


def pieces(texts: list[str | None], size: int) -> Iterator[list[tuple[int, str]]]:
    """(index, text) in groups of at most ``size`` characters; longer texts are cut, at white space where there is any."""
    group, held = [], 0
    for i, text in enumerate(texts):
        text, start = text or "", 0
        while len(text) - start > size:
            if group:
                yield group
                group, held = [], 0
            gap = re.compile(r"\s").search(text, start + size)
            end = gap.end() if gap else len(text)
            yield [(i, text[start:end])]
            start = end
        rest = text[start:] if start else text
        if held + len(rest) > size and group:
            yield group
            group, held = [], 0
        group.append((i, rest))
        held += len(rest)
    if group:
        yield group


def describe(texts: list[str | None], portion: int = PORTION) -> np.ndarray:
    """The features of each text, one row a text; a null text is an empty one."""
    n = len(texts)
    kinds = np.zeros((n, 7))
    words, short, capital, bare, ending, distinct, repeated = np.zeros((7, n))
    open_words: dict[int, list[np.ndarray]] = {}  # distinct words of texts that lie in several groups
    last = (-1, 0)
    for group in pieces(texts, portion):
        codes = np.frombuffer("".join(p for _, p in group).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if not len(codes):
            continue
        doc = np.repeat([i for i, _ in group], [len(p) for _, p in group])
        kind = classified(codes)
        kinds += np.bincount(doc * 7 + kind, minlength=7 * n).reshape(n, 7)
        inside = (kind != SPACE) & (kind != LINE)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
        stops = np.flatnonzero(ends)
        length, of = stops - starts + 1, doc[starts]
        at = np.arange(len(codes))
        place = at - np.maximum.accumulate(np.where(begins, at, 0))  # of a character in its word
        power = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))
        value = (codes.astype(np.uint64) + np.uint64(1)) * power[place & 255] * inside
        word = np.add.reduceat(value, starts)
        lettered = np.add.reduceat(((kind == LOWER) | (kind == UPPER)).astype(np.int64), starts) > 0

        def per_doc(mask: np.ndarray, of: np.ndarray = of) -> np.ndarray:
            return np.bincount(of[mask], minlength=n)

        words += np.bincount(of, minlength=n)
        short += per_doc(length <= 3)
        capital += per_doc(kind[starts] == UPPER)
        bare += per_doc(~lettered)
        ending += per_doc(kind[stops] == SYMBOL)
        same = np.zeros(len(word), dtype=bool)
        same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        same[0] = (int(of[0]), int(word[0])) == last
        last = (int(of[-1]), int(word[-1]))
        repeated += per_doc(same)
        ordered = np.lexsort((word, of))
        w, o = word[ordered], of[ordered]
        first = np.ones(len(w), dtype=bool)
        first[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        distinct += np.bincount(o[first], minlength=n)
        if len(group) == 1:  # may go on in the next group
            open_words.setdefault(group[0][0], []).append(w[first])
        elif group[0][0] in open_words:
            open_words[group[0][0]].append(w[first & (o == group[0][0])])
    for i, found in open_words.items():
        distinct[i] = len(np.unique(np.concatenate(found)))
    chars = kinds.sum(axis=1)
    letters = kinds[:, LOWER] + kinds[:, UPPER]
    solid = chars - kinds[:, SPACE] - kinds[:, LINE]

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    return np.column_stack([
        np.log1p(chars), ratio(solid, words), ratio(letters, solid), ratio(kinds[:, UPPER], letters), ratio(kinds[:, DIGIT], solid),
        ratio(kinds[:, PUNCTUATION], solid), ratio(kinds[:, SYMBOL], solid), ratio(kinds[:, SPACE], chars), ratio(distinct, words),
        ratio(repeated, words), np.log1p(words / (kinds[:, LINE] + 1)), ratio(short, words), ratio(capital, words), ratio(bare, words),
        ratio(ending, words)])


@dataclass
class Additive:
    """Fitted tables: a bias, cuts and a table per feature, and (feature, feature, cuts, cuts, table) per pair."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cut, x[:, f], side="right")]
        for a, b, cut_a, cut_b, values in self.pairs:
            total += values[np.searchsorted(cut_a, x[:, a], side="right"), np.searchsorted(cut_b, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at most ``bins`` - 1, near the quantiles."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf value of every bin, of a tree that cuts ordered bins where the gain is largest.

    ``g`` and ``h`` are the bins' sums of gradients and curvatures.
    """
    value = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE), -1.0)
        at = int(np.argmax(gain))
        if gain[at] > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
            value[:at + 1] = shallow_tree(g[:at + 1], h[:at + 1], depth - 1, least)
            value[at + 1:] = shallow_tree(g[at + 1:], h[at + 1:], depth - 1, least)
    return value


def cross_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut on each axis of a joint table (four leaves)."""
    g2, h2 = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(s: np.ndarray) -> tuple[np.ndarray, ...]:
        low = s[:-1, :-1]
        left, top, both = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return low, left - low, top - low, both - left - top + low

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    for gq, hq in zip(quarters(g2), quarters(h2), strict=True):
        gain += np.where(hq >= least, gq ** 2 / (hq + RIDGE), 0.0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.zeros_like(g)
    for rows, cols in itertools.product((slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None))):
        if h[rows, cols].sum() >= least:
            value[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + RIDGE)), value


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Additive:
    """Cyclic boosting on features ``x``, labels 0 or 1 and row weights (which should add up to the rows).

    Without rows every score is 0.5; with labels of one class all scores are near that label.
    """
    count = x.shape[1]
    if not len(x):
        return Additive(0.0, [np.empty(0)] * count, [np.zeros(1)] * count, [])
    share = (weight @ y + 0.5) / (weight.sum() + 1)
    bias, least = float(np.log(share / (1 - share))), LEAST_LEAF * weight.sum() / 4
    cuts = [quantile_cuts(x[:, f], BINS) for f in range(count)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    if y.min() == y.max():
        return Additive(bias, cuts, tables, [])
    logit = np.full(len(x), bias)

    def steps() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(count):
            g, h = steps()
            size = len(tables[f])
            value = RATE * shallow_tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), DEPTH, 0.01 * least)
            tables[f] += value
            logit += value[bins[f]]
    coarse = [quantile_cuts(x[:, f], PAIR_BINS) for f in range(count)]
    cell = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def joint(a: int, b: int) -> tuple[float, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at, size = cell[a] * shape[1] + cell[b], shape[0] * shape[1]
        g, h = steps()
        return cross_tree(np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape), 0.01 * least)

    ranked = sorted(itertools.combinations(range(count), 2), key=lambda p: (-joint(*p)[0], p))[:PAIRS]
    pair_tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for a, b in ranked:
            value = RATE * joint(a, b)[1]
            pair_tables[a, b] += value
            logit += value[cell[a], cell[b]]
    return Additive(bias, cuts, tables, [(a, b, coarse[a], coarse[b], v) for (a, b), v in pair_tables.items()])


def training_labels(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, label) of ids with one label, 0 or 1, in ``labels``; null and contradictory ones are left out."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label in (0, 1)")
    return named.groupBy("id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("most")).filter(
        "label = most").select("id", "label")


def described(docs: DataFrame) -> DataFrame:
    """(label, x) of rows with a label and a text."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": list(describe(b["text"].tolist()))})

    return docs.select("label", "text").mapInPandas(task, "label int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on at most ``sample`` labelled documents of each class; ``labels`` as from ``training_labels``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.join(rows.select("id").distinct(), "id", "left_semi")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in sorted(sizes)]
    if not chosen:
        return fit(np.empty((0, len(FEATURES))), np.empty(0), np.empty(0))
    ids = functools.reduce(DataFrame.unionByName, chosen)  # at most 2 * sample rows
    # an id may have many rows: as many rows as ids are enough
    found = described(rows.join(F.broadcast(ids), "id")).orderBy(F.xxhash64("x", "label")).limit(2 * sample).toPandas()
    x, y = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), found["label"].to_numpy(dtype=float)
    taken = {c: max(1, int((y == c).sum())) for c in sizes}
    weight = np.array([sizes[int(c)] / taken[int(c)] for c in y])
    return fit(x, y, weight * len(y) / max(weight.sum(), 1e-9))


def score(docs: DataFrame, model: Additive, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted; columns of these names are replaced, others stay.

    Null and empty texts are scored as texts of length 0. Equal texts get equal scores, whatever the
    rest of their rows; an empty table gives no rows.
    """

    @F.pandas_udf(RESULT)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            found = model.scores(describe(t.tolist()))
            yield pd.DataFrame({"score": found, "predicted": (found >= THRESHOLD).astype("int32")})

    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(F.struct("*").alias("row"), judged(F.col(text_col)).alias("found")).select(*kept, "found.score", "found.predicted")


# -- query ---------------------------------------------------------------------------------------

def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels whose fold of the id is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    labels = training_labels(table(spark, sf_dir, "labels").filter(~held_out))
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
