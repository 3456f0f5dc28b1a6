"""Embedding near-duplicates with a robust-pruned flat graph on overlapping shards (operator 5).

1. Equal vectors of a label collapse to one representative with a count.
2. The vectors of a label are clustered into shards: a cell that is too large is cut at the bisectors of
   centroids of a bounded sample, and a vector within ``margin`` of a bisector joins both sides, so
   shards overlap. Cells of vectors so dense that cutting does not thin them are compared in
   portions, every two portions in a task of their own, exactly.
3. In each shard every vector gets edges to near and random members by robust pruning: the nearest
   candidate stays, and candidates that are closer to it by a factor than to the vector go.
4. The adjacency lists of a vector from all its shards are united.
5. In each shard a greedy beam search runs from the medoid for every member; around what lies in
   range it goes on expanding until nothing in range is unexpanded.
6. What was found is verified by its cosine in double precision. A pair that shares several shards
   counts in the smallest of them, where such vectors are compared exactly, so that it is not lost
   if only another shard's search finds it. Only counts and a spanning forest leave a task.
7. An audit compares the links of a hash sample of vectors with brute force over all vectors in
   blocks, until enough of the sample have a link; if recall falls short, the margin is doubled and
   the search repeated. At half the chord of the threshold the shards cover every pair. If recall
   falls short there too, or if the audit sees too few links to judge by, these shards are compared
   exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import local_roots, table, written
from territory_engine.llm.components import components

THRESHOLD = 0.98
#: Vectors of a shard at most; centroids of a cell that is cut, and sampled vectors for each.
SHARD, CENTROIDS, SAMPLED = 2048, 16, 64
#: A part with more than this share of its cell shows that cutting does not thin it.
DENSE = 0.8
#: First margin around bisectors. In many dimensions a near pair's difference is small along any one direction.
MARGIN = 0.03
#: Out-edges, near and random candidates, pruning factor, beam width, queries that advance together.
DEGREE, NEAR, RANDOM, ALPHA, BEAM, TOGETHER = 24, 48, 16, 1.2, 32, 256
#: Vectors of a block of the audit about, vectors with a link that it has to see, and the recall it asks for.
AUDITED, LINKED, RECALL = 1024, 200, 0.95
#: Vectors the audit looks at before it gives up seeing so many: a number, or a share of all if that is more.
AUDITED_MOST, AUDITED_SHARE = 8192, 0.02


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# -- shards --------------------------------------------------------------------------------------

def centroids_of(rows: pd.DataFrame) -> pd.DataFrame:
    """A few rounds of k-means over the sampled vectors of one cell."""
    rows = rows.sort_values("rep")
    x = directions(rows["v"])
    k = int(rows["k"].iloc[0])
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(6):
        own = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "centroids": [c.ravel().tolist()], "k": [len(c)]})


def sides(x: np.ndarray, c: np.ndarray, margin: float) -> np.ndarray:
    """(vector, centroid): the nearest centroid, and those whose bisector with it is within the margin."""
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) if len(x) * c.size < 1 << 22 else \
        (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]
    first = d.argmin(axis=1)
    apart = np.sqrt(((c[first][:, None, :] - c[None, :, :]) ** 2).sum(axis=2)) if len(x) * c.size < 1 << 22 else \
        np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))[first]
    with np.errstate(invalid="ignore", divide="ignore"):
        distance = (d - d[np.arange(len(x)), first][:, None]) / (2 * apart)
    near = distance <= margin
    near[np.arange(len(x)), first] = True
    return near & ~((apart == 0) & (np.arange(len(c))[None, :] != first[:, None]))


def shards(reps: DataFrame, margin: float, shard: int = SHARD) -> DataFrame:
    """(rep, cell, v, dense) for every shard that a representative is a member of."""
    kind = reps.schema["v"].dataType.simpleString()
    level = written(reps.select("rep", F.xxhash64("label", F.size("v")).alias("cell"), "v", F.lit(1 << 62).alias("parent_n")), "embed-cells")
    done: list[DataFrame] = []
    while True:
        counts = written(level.groupBy("cell").agg(F.count("*").alias("n"), F.max("parent_n").alias("parent_n"))
                         .filter(F.col("n") > shard).withColumn("dense", F.col("n") > DENSE * F.col("parent_n")).drop("parent_n"), "embed-large")
        marked = level.join(counts, "cell", "left")
        done.append(marked.filter("n is null or dense").select("rep", "cell", "v", F.coalesce("dense", F.lit(False)).alias("dense")))
        large = marked.filter("n is not null and not dense")
        if counts.filter("not dense").isEmpty():
            break
        k = F.least(F.lit(CENTROIDS), F.ceil(F.col("n") * 2 / shard)).cast("int")
        sampled = large.withColumn("k", k).filter(F.pmod(F.xxhash64("rep", F.lit(len(done))), F.lit(1 << 20)) < F.col("k") * SAMPLED * (1 << 20) / F.col("n"))
        centroids = written(sampled.select("rep", "cell", "v", "k").groupBy("cell").applyInPandas(
            centroids_of, "cell long, centroids array<double>, k int"), "embed-centroids")
        # a cell is dealt out in portions of about a shard, each of which meets the cell's centroids
        portions = F.ceil(F.col("n") / shard).cast("int")
        dealt = large.withColumn("portion", F.pmod(F.xxhash64("rep"), portions).cast("int")).select("rep", "cell", "v", "n", "portion")
        placed = centroids.join(counts, "cell").select("cell", "centroids", "k", F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"))

        def cut(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            names = ["rep", "cell", "part", "v", "parent_n"]
            if not len(rows):
                return pd.DataFrame({n: [] for n in names})
            if not len(own):  # no vector of the cell was sampled: it stays whole
                return rows.assign(part=0, parent_n=rows["n"])[names]
            c = np.asarray(own["centroids"].iloc[0]).reshape(int(own["k"].iloc[0]), -1)
            i, j = np.nonzero(sides(directions(rows["v"]), c, margin))
            return pd.DataFrame({"rep": rows["rep"].to_numpy()[i], "cell": rows["cell"].to_numpy()[i], "part": j,
                                 "v": rows["v"].to_numpy()[i], "parent_n": rows["n"].to_numpy()[i]})

        parts = dealt.groupBy("cell", "portion").cogroup(placed.groupBy("cell", "portion")).applyInPandas(
            cut, f"rep long, cell long, part int, v {kind}, parent_n long")
        level = written(parts.select("rep", F.xxhash64("cell", "part").alias("cell"), "v", "parent_n"), "embed-cells")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return written(out, "embed-shards")


# -- graph ---------------------------------------------------------------------------------------

def robust_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Out- and in-edges of every vector after robust pruning, out-edges at most DEGREE."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    near = min(NEAR, n - 1)
    by_near = np.argpartition(-s, near - 1, axis=1)[:, :near]
    far = np.random.default_rng(seed).integers(n, size=(n, RANDOM))
    cand = np.concatenate([by_near, far], axis=1)
    own = np.arange(n)[:, None]
    sim = s[own, cand]
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = cand[own, order], sim[own, order]
    alive = cand != own
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * sim))
    picked_a, picked_b = [], []
    for _ in range(DEGREE):
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            break
        at = alive[some].argmax(axis=1)
        star = cand[some, at]
        picked_a.append(some)
        picked_b.append(star)
        between = np.sqrt(np.maximum(0.0, 2 - 2 * s[star[:, None], cand[some]]))
        gone = (ALPHA * between <= dist[some]) | (cand[some] == star[:, None])
        alive[some] &= ~gone
    a, b = np.concatenate(picked_a), np.concatenate(picked_b)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return [np.unique(e) for e in np.split(b, np.searchsorted(a, np.arange(1, n)))]


def padded(edges: list[np.ndarray]) -> np.ndarray:
    """Adjacency lists as rows filled up with the vector itself."""
    width = max((len(e) for e in edges), default=0)
    out = np.repeat(np.arange(len(edges))[:, None], max(1, width), axis=1)
    for i, e in enumerate(edges):
        out[i, :len(e)] = e
    return out


def range_search(x: np.ndarray, edges: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) with cosine of at least the threshold, reached from the medoid.

    What lies in range is expanded a round at a time: one product of the vectors in range of each query with the
    adjacency matrix of the shard gives all that they reach.
    """
    n = len(x)
    adjacent = np.zeros((n, n), dtype=np.float32)
    adjacent[np.arange(n)[:, None], edges] = 1
    start = int((x @ x.mean(axis=0)).argmax())
    out_q, out_f = [], []
    low = threshold - 1e-6
    for first in range(0, n, TOGETHER):
        q = np.arange(first, min(n, first + TOGETHER))
        rows = np.arange(len(q))
        beam = np.full((len(q), BEAM), start)
        sim = np.full((len(q), BEAM), -2.0)
        sim[:, 0] = x[q] @ x[start]
        done = sim < -1.5
        seen = np.zeros((len(q), n), dtype=bool)
        seen[:, start] = True
        in_range = np.zeros((len(q), n), dtype=bool)
        in_range[:, start] = sim[:, 0] >= low
        expanded = np.zeros((len(q), n), dtype=bool)
        while True:
            open_sim = np.where(done, -3.0, sim)
            at = open_sim.argmax(axis=1)
            live = np.flatnonzero(open_sim[rows, at] > -1.5)
            if not len(live):
                break
            node = beam[live, at[live]]
            done[live, at[live]] = True
            expanded[live, node] = True
            nb = edges[node]
            fresh = ~seen[live[:, None], nb]
            seen[live[:, None], nb] = True
            got = np.einsum("qd,qkd->qk", x[q[live]], x[nb])
            hit_q, hit_k = np.nonzero(fresh & (got >= low))
            in_range[live[hit_q], nb[hit_q, hit_k]] = True
            got = np.where(fresh, got, -2.0)
            all_sim, all_id = np.concatenate([sim[live], got], axis=1), np.concatenate([beam[live], nb], axis=1)
            all_done = np.concatenate([done[live], got < -1.5], axis=1)
            best = np.argpartition(-all_sim, BEAM - 1, axis=1)[:, :BEAM]
            pick = np.arange(len(live))[:, None]
            sim[live], beam[live], done[live] = all_sim[pick, best], all_id[pick, best], all_done[pick, best]
        while True:  # expand whatever is in range
            frontier = in_range & ~expanded
            nodes = np.flatnonzero(frontier.any(axis=0))
            if not len(nodes):
                break
            expanded |= frontier
            fresh = (frontier[:, nodes].astype(np.float32) @ adjacent[nodes] > 0) & ~seen
            seen |= fresh
            some, reached = np.flatnonzero(fresh.any(axis=1)), np.flatnonzero(fresh.any(axis=0))
            block = np.ix_(some, reached)
            in_range[block] |= fresh[block] & (x[q[some]] @ x[reached].T >= low)
        in_range[rows, q] = False
        a, b = np.nonzero(in_range)
        out_q.append(q[a])
        out_f.append(b)
    return np.concatenate(out_q), np.concatenate(out_f)


def close_pairs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (smaller, larger position) with cosine of about the threshold at least."""
    out = [np.nonzero(x[s:s + 512] @ x.T >= threshold - 1e-6) for s in range(0, len(x), 512)]
    a = np.concatenate([np.zeros(0, dtype=np.int64), *(i + 512 * k for k, (i, _) in enumerate(out))])
    b = np.concatenate([np.zeros(0, dtype=np.int64), *(j for _, j in out)])
    return a[a < b], b[a < b]


def verified(v: pd.Series, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair, in double precision, reaches the threshold."""
    x = np.stack([np.asarray(y, dtype=np.float64) for y in v])
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where((top > 1e100) | (top < 1e-100), top, 1.0)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), 1 << 18):
        i, j = a[s:s + (1 << 18)], b[s:s + (1 << 18)]
        out[s:s + (1 << 18)] = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
    return out


def settled(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links of found pairs: per member the vectors linked (counted in one shard only) and its local root."""
    n = len(rows)
    pair = np.unique(np.concatenate([np.minimum(a, b) * np.int64(n) + np.maximum(a, b)]))
    a, b = pair // n, pair % n
    ok = verified(rows["v"], a, b, threshold)
    a, b = a[ok], b[ok]
    root = local_roots(n, a, b)
    cell = int(rows["cell"].iloc[0])
    lists = [np.asarray(c) for c in rows["cells"]]
    earlier = [set(c[c < cell].tolist()) for c in lists]  # other shards that come first
    counted = np.array([not (earlier[i] and earlier[j] and earlier[i] & earlier[j]) for i, j in zip(a, b, strict=True)], dtype=bool) \
        if any(earlier) else np.ones(len(a), dtype=bool)
    copies = rows["copies"].to_numpy()
    links = np.zeros(n, dtype=np.int64)
    np.add.at(links, a[counted], copies[b[counted]])
    np.add.at(links, b[counted], copies[a[counted]])
    rep = rows["rep"].to_numpy()
    some = np.flatnonzero((links > 0) | (root != np.arange(n)))
    return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[root[some]]})


FOUND = "rep long, links long, root long"


def find_links(reps: DataFrame, margin: float, threshold: float, shard: int = SHARD, exact: bool = False) -> DataFrame:
    """(rep, links, root): numbers of linked vectors and spanning links, by shard; ``exact`` compares without a graph."""
    members = shards(reps, margin, shard)
    lists = members.groupBy("rep").agg(F.collect_set("cell").alias("cells"))  # the shards of one vector
    full = written(members.join(lists, "rep").join(reps.select("rep", "copies"), "rep"), "embed-members")
    if exact:
        full = full.withColumn("dense", F.lit(True))
    sparse = full.filter("not dense")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        rep = rows["rep"].to_numpy()
        edges = robust_graph(directions(rows["v"]), seed=int(rep[0]) & 0xFFFFFFFF)
        return pd.DataFrame({"rep": rep, "edges": [rep[e].tolist() for e in edges]})

    graph = sparse.select("rep", "cell", "v").groupBy("cell").applyInPandas(build, "rep long, edges array<long>")
    united = written(graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "embed-graph")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep").reset_index(drop=True)
        rep = rows["rep"].to_numpy()
        edges = []
        for e in rows["edges"]:
            e = np.asarray(e, dtype=np.int64)
            at = np.minimum(np.searchsorted(rep, e), len(rep) - 1)
            edges.append(at[rep[at] == e])  # neighbours in other shards only are searched there
        x = directions(rows["v"])
        a, b = range_search(x, padded(edges), threshold)
        shared = np.flatnonzero(rows["cells"].map(len) > 1)
        more_a, more_b = close_pairs(x[shared], threshold)
        a, b = np.concatenate([a, shared[more_a]]), np.concatenate([b, shared[more_b]])
        return settled(rows, a, b, threshold)

    searched = sparse.join(united, "rep").select("rep", "cell", "v", "cells", "copies", "edges").groupBy("cell").applyInPandas(search, FOUND)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep").reset_index(drop=True)
        x, part = directions(rows["v"]), rows["part"].to_numpy()
        two = part.min() != part.max()
        if not two and rows["pair_a"].iloc[0] != rows["pair_b"].iloc[0]:
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        out_a, out_b = [], []
        for s in range(0, len(x), 512):
            a, b = np.nonzero(x[s:s + 512] @ x.T >= threshold - 1e-6)
            a += s
            keep = (a < b) & ((part[a] != part[b]) | (not two))
            out_a.append(a[keep])
            out_b.append(b[keep])
        return settled(rows, np.concatenate(out_a), np.concatenate(out_b), threshold)

    dense = full.filter("dense")
    sizes = dense.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("portions"))
    cut = dense.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("portions")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    blocks = cut.select("rep", "cell", "v", "cells", "copies", "part", F.least("part", "other").alias("pair_a"), F.greatest("part", "other").alias("pair_b"))
    compared = blocks.groupBy("cell", "pair_a", "pair_b").applyInPandas(compare, FOUND)
    return written(searched.unionAll(compared), "embed-found")


def true_links(reps: DataFrame, threshold: float, audited: int = AUDITED, most: int = AUDITED_MOST) -> tuple[DataFrame, bool]:
    """(rep, n) of a hash sample of representatives with their true links, and whether it is enough to judge by.

    The sample grows by about ``audited`` until LINKED of it have a link, or to all representatives:
    either is enough. A sample of more than ``most`` and AUDITED_SHARE of all is not made larger.
    """
    total = reps.count()
    step, most = max(1, int(audited * (1 << 30) / max(1, total)) + 1), max(most, AUDITED_SHARE * total)
    place = F.pmod(F.xxhash64("rep", F.lit("audit")), F.lit(1 << 30))
    out, asked_all, linked, at = reps.select("rep", F.lit(0).cast("long").alias("n")).limit(0), 0, 0, 0
    while at < 1 << 30 and linked < LINKED and asked_all < most:
        sample = reps.filter((place >= at) & (place < at + step)).select("rep", "label", "v").collect()  # about ``audited`` rows
        at, asked_all = at + step, asked_all + len(sample)
        if sample:
            some = written(true_links_of(reps, sample, threshold), "embed-true")
            linked += some.filter("n > 0").count()
            out = out.unionAll(some)
    return out, at >= 1 << 30 or linked >= LINKED


def true_links_of(reps: DataFrame, sample: list, threshold: float) -> DataFrame:
    """(rep, n): links of the sampled representatives, by brute force over all."""
    groups: dict[tuple, tuple] = {}
    for r in sample:
        groups.setdefault((r["label"], len(r["v"])), ([], []))
        groups[r["label"], len(r["v"])][0].append(r["rep"])
        groups[r["label"], len(r["v"])][1].append(r["v"])
    asked = {k: (np.array(i), directions(pd.Series(v))) for k, (i, v) in groups.items()}

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, rows in b.groupby([b["label"], b["v"].map(len)]):
                if k in asked:
                    ids, q = asked[k]
                    n = np.zeros(len(ids), dtype=np.int64)
                    for s in range(0, len(rows), 2048):
                        part = rows.iloc[s:s + 2048]
                        near = (q @ directions(part["v"]).T >= threshold) & (ids[:, None] != part["rep"].to_numpy()[None, :])
                        n += near @ part["copies"].to_numpy()
                    yield pd.DataFrame({"rep": ids, "n": n})

    return reps.select("rep", "label", "v", "copies").mapInPandas(exact, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def audit(true: DataFrame, found: DataFrame) -> float:
    """Share of the true links of the sample that were found."""
    got = found.groupBy("rep").agg(F.sum("links").alias("links"))
    row = true.join(got, "rep", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0))))).first()
    return 1.0 if not row[0] else row[1] / row[0]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept, audited_recall) for every row.

    Rows link if their labels are equal and not null and their cosine reaches the threshold. Null,
    empty and zero vectors, vectors with null or non-finite components, and vectors of different
    lengths link with nothing. A row that links with nothing is its own component. Rows with a null
    id have a component like any other but are not kept; an empty table gives an empty result.
    ``audited_recall`` is the share of the audited vectors' links that the graph search found, the same in
    every row; it is null where shards were compared exactly instead.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v"))
    linkable = F.col("label").isNotNull() & usable(F.col("v"))
    rows = written(rows.select("id", "label", "v", F.when(linkable, F.xxhash64("label", "v")).alias("rep")), "embed-rows")
    reps = written(rows.filter("rep is not null").groupBy("rep", "label").agg(
        F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("least_id")), "embed-reps")
    exact_cover = math.sqrt(2 - 2 * threshold) / 2
    margin = min(MARGIN, exact_cover)
    true, enough = true_links(reps, threshold)
    recall = None
    while enough:
        found = find_links(reps, margin, threshold, shard)
        recall = audit(true, found)
        if recall >= RECALL:
            break
        enough = margin < exact_cover
        margin = min(2 * margin, exact_cover)
    if not enough:
        found = find_links(reps, exact_cover, threshold, shard, exact=True)
    roots = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "embed")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = (reps.select("rep", "copies", "least_id").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
           .select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least_id", F.coalesce("root", "rep").alias("root")))
    least = own.groupBy("root").agg(F.min("least_id").alias("component_id"))
    own = written(own.join(least, "root").select("rep", "n_links", "component_id"), "embed-own")
    component = F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select("id", "rep").join(own, "rep", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        F.lit(recall if enough else None).cast("double").alias("audited_recall"))


# -- query ---------------------------------------------------------------------------------------

def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings with the same label at cosine 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
