"""Toxic spans by a linear-chain conditional random field (operator 9).

Labels are known for documents, the field tags tokens, so the training sample is labelled first:
a token of a toxic document is toxic if its word, or a prefix of it, is found in far more toxic than
clean documents of the sample (near-copies among them count once). The field has two
states (clean, toxic), features of the word, its prefixes and its suffix, and a transition matrix;
it is fitted on windows around toxic tokens and on clean windows by stochastic gradient ascent of
the conditional likelihood. Of every whole text, forward-backward marginals give each token's
probability of being toxic; a logistic model of their maximum and of the expected number of toxic tokens, fitted
on the sample's document labels, gives the score, and the tokens above one half the offsets.

What is gathered is the sample alone: SAMPLE documents a class of at most SAMPLE_DOC_CHARS
characters, chosen by a hash of the id. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import fold_of, table
from territory_engine.llm.simhash import fingerprint

#: Documents of each class in the sample at most, and the longest that is taken.
SAMPLE = {1: 1500, 0: 2500}
SAMPLE_DOC_CHARS = 20_000
#: A word marks toxic tokens at so many times its rate in clean documents, if that is no chance: the
#: log-likelihood ratio of its document counts (twice the logarithm) is at least that of one chance
#: find among all words tested, and this more.
LEAST_RATIO, EVIDENCE_MARGIN = 12.0, 2.0
#: Documents that a tested word is in at least.
TESTED_DOCS = 3
#: Bits between fingerprints of sampled documents that count as one.
COPY_BITS = 8
WINDOW, DIMENSIONS, EPOCHS, RATE, RIDGE = 10, 1 << 18, 4, 0.5, 1e-4
#: A document is toxic from this score on, a token from this marginal on.
THRESHOLD, TOKEN_THRESHOLD = 0.7, 0.5
#: Distinct words whose emission a worker keeps.
KEPT = 150_000

WORD = re.compile(r"\w+")
RESULT = "score double, predicted int, spans array<struct<start: int, end: int, p: double>>"


def marks(word: str) -> list[str]:
    """The strings of a word that can mark it as toxic: itself and its prefixes."""
    w = word.lower()
    return [f"w{w}"] + [f"p{w[:n]}" for n in (4, 5) if len(w) > n]


def features(word: str) -> list[int]:
    w = word.lower()
    named = ["bias", f"w{w}", f"a{w[:4]}", f"b{w[:5]}", f"s{w[-4:]}"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in named]


@dataclass
class Field:
    """Fitted parameters; emission and transitions are log ratios to the clean state."""

    weights: np.ndarray
    transitions: np.ndarray  # [from, to] logs
    logistic: np.ndarray  # bias, maximum, expected number
    kept: dict = field(default_factory=dict)

    def emissions(self, words: list[list[str]]) -> np.ndarray:
        """Emission of every word, documents one after the other."""
        new = set().union(*words).difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = set().union(*words)
        for w in new:
            self.kept[w] = min(30.0, max(-30.0, float(self.weights[features(w)].sum())))
        return np.fromiter(map(self.kept.__getitem__, itertools.chain.from_iterable(words)), dtype=np.float64)

    def marginals(self, lengths: np.ndarray, emission: np.ndarray) -> np.ndarray:
        """Toxic probability of each token of documents that follow each other in ``emission``.

        Forward and backward messages of a two-state chain are ratios toxic : clean; all documents
        advance together, longest first, so each step is one operation on those still running.
        """
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max(initial=0))
        running = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
        first = np.concatenate([[0], np.cumsum(running)])
        starts = np.cumsum(lengths) - lengths
        t = np.arange(len(emission)) - np.repeat(starts, lengths)
        place = first[t] + np.repeat(rank, lengths)  # step-major position of each token
        e = np.empty(len(emission))
        e[place] = np.exp(emission)
        (oo, ot), (to, tt) = np.exp(self.transitions)
        forward, backward = np.empty_like(e), np.ones_like(e)
        for k in range(longest):
            s = slice(first[k], first[k + 1])
            if k == 0:
                forward[s] = e[s]
            else:
                r = forward[first[k - 1]:first[k - 1] + running[k]]
                forward[s] = e[s] * (ot + r * tt) / (oo + r * to)
        for k in range(longest - 2, -1, -1):
            n = running[k + 1]
            x = e[first[k + 1]:first[k + 1] + n] * backward[first[k + 1]:first[k + 1] + n]
            backward[first[k]:first[k] + n] = (to + tt * x) / (oo + ot * x)
        odds = forward * backward
        return (odds / (1 + odds))[place]

    def gathered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: words, maximum marginal, expected toxic tokens; and the marginals of all tokens."""
        words = [WORD.findall(t) if t else [] for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        p = self.marginals(lengths, self.emissions(words))
        top, expected = np.zeros(len(texts)), np.zeros(len(texts))
        some = lengths > 0
        if some.any():
            at = (np.cumsum(lengths) - lengths)[some]
            top[some], expected[some] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
        return lengths, top, expected, p

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        lengths, top, expected, p = self.gathered(texts)
        score = _sigmoid(self.logistic[0] + self.logistic[1] * top + self.logistic[2] * np.log1p(expected))
        spans: list[list[dict]] = [[] for _ in texts]
        ends = np.cumsum(lengths)
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(p >= TOKEN_THRESHOLD), side="right")):
            spans[i] = [{"start": m.start(), "end": m.end(), "p": float(q)}
                        for m, q in zip(WORD.finditer(texts[i]), p[ends[i] - lengths[i]:ends[i]], strict=True) if q >= TOKEN_THRESHOLD]
        return pd.DataFrame({"score": score, "predicted": (score >= THRESHOLD).astype("int32"), "spans": spans})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _apart(texts: list[str]) -> list[str]:
    """One of each group of near-copies: fingerprints close to an earlier one are left out."""
    prints = np.array([fingerprint(t, 3) for t in texts], dtype=np.int64).view(np.uint64)
    kept: list[int] = []
    for i, x in enumerate(prints):
        if not kept or np.bitwise_count(prints[kept] ^ x).min() > COPY_BITS:
            kept.append(i)
    return [texts[i] for i in kept]


def _evidence(k1: int, n1: int, k2: int, n2: int) -> float:
    """Log-likelihood ratio of two rates, k1 of n1 and k2 of n2, against one common rate."""

    def logs(k: int, n: int, q: float) -> float:
        return (k * np.log(q) if k else 0.0) + ((n - k) * np.log(1 - q) if n > k else 0.0)

    return 2 * (logs(k1, n1, k1 / n1) + logs(k2, n2, k2 / n2) - logs(k1, n1, (k1 + k2) / (n1 + n2)) - logs(k2, n2, (k1 + k2) / (n1 + n2)))


def fit(toxic: list[str], clean: list[str], seed: int = 7) -> Field | None:
    """The field of a labelled sample; None if a class is missing or no word tells them apart."""
    toxic, clean = _apart(toxic), _apart(clean)
    if not toxic or not clean:
        return None
    in_toxic, in_clean = Counter(), Counter()
    for texts, counter in ((toxic, in_toxic), (clean, in_clean)):
        for t in texts:
            counter.update({m for w in set(WORD.findall(t)) for m in marks(w)})
    tested = sum(n + in_clean[m] >= TESTED_DOCS for m, n in in_toxic.items())
    least = 2 * np.log(max(1, tested)) + EVIDENCE_MARGIN
    odd = {m for m, n in in_toxic.items() if n + in_clean[m] >= TESTED_DOCS and _evidence(n, len(toxic), in_clean[m], len(clean)) >= least
           and n / len(toxic) >= LEAST_RATIO * in_clean[m] / len(clean)}
    if not odd:
        return None
    rng = np.random.default_rng(seed)
    width = 2 * WINDOW + 1
    windows: list[tuple[list[str], list[int]]] = []
    for texts, is_toxic in ((toxic, True), (clean, False)):
        for t in texts:
            words = WORD.findall(t)
            tags = [int(is_toxic and any(m in odd for m in marks(w))) for w in words]
            marked = [i for i, tag in enumerate(tags) if tag]
            spots = [max(0, i - WINDOW) for i in (marked if len(marked) <= 6 else rng.choice(marked, 6, replace=False))]
            spots += list(rng.integers(0, max(1, len(words) - width), size=4))
            windows += [(words[s:s + width], tags[s:s + width]) for s in spots if words[s:s + width]]
    index = np.zeros((len(windows), width, 5), dtype=np.int64)
    tag = np.zeros((len(windows), width), dtype=np.int64)
    live = np.zeros((len(windows), width), dtype=bool)
    cache: dict[str, list[int]] = {}
    for i, (ws, ts) in enumerate(windows):
        for j, w in enumerate(ws):
            if w not in cache:
                cache[w] = features(w)
            index[i, j] = cache[w]
        tag[i, :len(ts)], live[i, :len(ts)] = ts, True
    weights, trans = np.zeros(DIMENSIONS), np.zeros((2, 2))
    g_w, g_t = np.full(DIMENSIONS, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 256):
            b = order[at:at + 256]
            node, pair = _expected(weights[index[b]].sum(axis=2), trans, live[b])
            both = live[b][:, 1:] & live[b][:, :-1]
            observed = np.zeros((2, 2))
            np.add.at(observed, (tag[b][:, :-1][both], tag[b][:, 1:][both]), 1)
            step = np.zeros(DIMENSIONS)
            np.add.at(step, index[b][live[b]].ravel(), np.repeat((tag[b] - node)[live[b]], 5))
            used = np.unique(index[b][live[b]])
            grad = step[used] / len(b) - RIDGE * weights[used]
            g_w[used] += grad * grad
            weights[used] += RATE * grad / np.sqrt(g_w[used])
            grad_t = (observed - pair) / len(b) - RIDGE * trans
            g_t += grad_t * grad_t
            trans += RATE * grad_t / np.sqrt(g_t)
    made = Field(weights, trans, np.zeros(3))
    _, top, expected, _ = made.gathered(toxic + clean)
    x = np.stack([np.ones(len(top)), top, np.log1p(expected)], axis=1)
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    for _ in range(25):  # Newton steps with a ridge
        p = _sigmoid(x @ made.logistic)
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 0.05 * np.eye(3)
        made.logistic = made.logistic + np.linalg.solve(h, x.T @ (y - p) - 0.05 * made.logistic)
    made.kept = {}
    return made


def _expected(emission: np.ndarray, trans: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected toxic tags and expected transitions of windows; dead positions are at the end."""
    n, width = emission.shape
    psi = np.exp(trans)
    e = np.ones((n, width, 2))
    e[:, :, 1] = np.where(live, np.exp(np.clip(emission, -30, 30)), 1.0)
    forward, backward = np.zeros((n, width, 2)), np.ones((n, width, 2))
    forward[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        f = (forward[:, t - 1] @ psi) * e[:, t]
        forward[:, t] = np.where(live[:, t, None], f / f.sum(axis=1, keepdims=True), forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        b = (e[:, t + 1] * backward[:, t + 1]) @ psi.T
        backward[:, t] = np.where(live[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    node = forward * backward
    node /= node.sum(axis=2, keepdims=True)
    pair = forward[:, :-1, :, None] * psi * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return node[:, :, 1], pair[live[:, 1:]].sum(axis=0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field | None:
    """Fit on a bounded sample of the labelled documents given.

    Rows with a null id or label are left out; an id with several labels counts as toxic if one is
    1. Ids are chosen by a hash; None is returned if a class is missing.
    """
    spark = docs.sparkSession
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(label_col).alias("label"))
    there = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if len(there) < 2:
        return None
    share = {k: min(1 << 30, int((1 << 30) * SAMPLE[k] / n) + 1) for k, n in there.items()}
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # about SAMPLE ids a class, so the list of ids is small whatever the size of the tables
    ids = own.filter(chance < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).collect()
    chosen = F.broadcast(spark.createDataFrame([(r["id"], r["label"]) for r in ids], "id long, label int"))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_DOC_CHARS))
            .join(chosen, "id").groupBy("label", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).collect())
    rows = sorted(rows, key=lambda r: (r["label"], r["h"]))
    return fit([r["text"] for r in rows if r["label"] == 1], [r["text"] for r in rows if r["label"] == 0])


def score(docs: DataFrame, model: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (0 or 1) and spans of toxic tokens added (replaced if present).

    Spans are character offsets into the text with their marginal. Null and empty texts and texts
    without a word have no toxic token and score as such; without a model all score zero.
    """
    added = ("score", "predicted", "spans")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                           F.array().cast("array<struct<start: int, end: int, p: double>>").alias("spans"))
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # DIMENSIONS weights, 2 MB

    @F.pandas_udf(RESULT)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(packed.value)
        for s in batches:
            yield pd.concat([own.score(list(s.iloc[i:i + 512])) for i in range(0, max(1, len(s)), 512)], ignore_index=True)

    found = docs.select(*kept, tag(F.col(f"`{text_col}`")).alias("__found"))
    return found.select(*kept, *[F.col(f"__found.{c}").alias(c) for c in added])


# -- query ---------------------------------------------------------------------------------------

def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return labels.filter(fold_of(F.col("doc_id"), 3) != 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, training_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
