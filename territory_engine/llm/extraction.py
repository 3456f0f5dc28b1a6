"""Main text of web pages by wrapper induction (operator 2).

The pages of a host are aligned with a few reference pages of the same host by simple tree
matching (the largest order-preserving common tree, by dynamic programming over the children of
equally labelled nodes). Counts over all pages tell which nodes of a reference carry the same text
on all pages, and so belong to the template, and how much varying text each node holds. The
wrapper's content slot is the smallest container with most of the varying text, outside parts that
their markup names as menu, footer, advert and the like. A page's main text is what stands at the slot when the
page is aligned with the wrapper, less the texts that its aligned nodes hold on nearly all pages (the template). Pages that no wrapper fits, and hosts whose pages do not vary,
fall back to the page's own markup: its article and main elements, or the body without those parts.

References are chosen by a hash (REFERENCES a host), counts are added up in the tasks before they
are shuffled, and pages themselves are only shuffled if the wrappers are too large to broadcast
under Spark's own threshold. A host may hold any share of the pages.
"""

from __future__ import annotations

import functools
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import table, written
from territory_engine.llm.dom import HEADINGS, TEXT, Element, Shape, nodes, parse, shaped
from territory_engine.llm.urls import url_host

#: Reference pages of a host.
REFERENCES = 3
#: A container is the slot's if it holds this share of the varying text.
SLOT_SHARE = 0.7
CONTAINERS = frozenset("article body center div dd fieldset html main section table tbody td tr".split())
#: A text of a reference is template if this share of the pages that align with its node has it there too, ...
TEMPLATE_SHARE = 0.98
#: ... among them so many different pages (bits of a 64-bit set of page hashes, so copies of a page are one).
TEMPLATE_PAGES = 5
#: Template is left out of a page's slot if this share of the slot's text stays; else the page is a copy, not a template.
KEPT_SHARE = 0.5
#: Tables of children up to this size are kept whole.
CELLS = 4096
#: Hosts and nodes whose counts a task holds before it hands them on.
HELD = 200_000


# -- simple tree matching ------------------------------------------------------------------------

@functools.lru_cache(maxsize=100_000)
def matched(a: Shape, b: Shape) -> int:
    """Nodes in the largest common tree of two shapes with the same label."""
    if a == b:
        return size(a)
    if a[0] != b[0]:
        return 0
    first, last = _ends(a[1], b[1])
    xs, ys = a[1][first:len(a[1]) - last], b[1][first:len(b[1]) - last]
    equal = sum(map(size, a[1][:first])) + sum(map(size, a[1][len(a[1]) - last:]))
    if len(xs) * len(ys) <= CELLS:
        return 1 + equal + _table(xs, ys)[-1][-1]
    return 1 + equal + int(_last_row(xs, *_kinds(ys))[-1])


@functools.lru_cache(maxsize=100_000)
def size(a: Shape) -> int:
    return 1 + sum(map(size, a[1]))


def _ends(xs: tuple, ys: tuple) -> tuple[int, int]:
    """How many children are equal at the start and, of the others, at the end; some largest common tree pairs them."""
    most = min(len(xs), len(ys))
    first = next((i for i in range(most) if xs[i] != ys[i]), most)
    most -= first
    return first, next((i for i in range(most) if xs[-1 - i] != ys[-1 - i]), most)


def _table(xs: tuple, ys: tuple) -> list[list[int]]:
    w = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = w[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(last[j + 1], row[j], last[j] + matched(x, y) if x[0] == y[0] else 0))
        w.append(row)
    return w


def _kinds(ys: tuple) -> tuple[list[Shape], np.ndarray]:
    """The distinct shapes of ``ys`` and the number of each one's."""
    number: dict[Shape, int] = {}
    at = np.array([number.setdefault(y, len(number)) for y in ys], dtype=np.int64)
    return list(number), at


def _last_row(xs: Iterable[Shape], kinds: list[Shape], at: np.ndarray) -> np.ndarray:
    """Last row of the table, one row at a time: entry j is the best of all ``xs`` with the first j of ``ys``."""
    gains: dict[Shape, np.ndarray] = {}
    row = np.zeros(len(at) + 1, dtype=np.int64)
    for x in xs:
        if x not in gains:
            gains[x] = np.array([matched(x, y) for y in kinds], dtype=np.int64)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains[x][at]))
    return row


def paired(xs: tuple, ys: tuple) -> list[tuple[int, int]]:
    """Places of the children that one largest common tree pairs, in order.

    Long rows of children are halved where the tables of both halves add up to the best (linear memory).
    """
    first, last = _ends(xs, ys)
    out = [(i, i) for i in range(first)]
    todo = [(first, len(xs) - last, first, len(ys) - last)]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= CELLS:
            out += [(a + p, c + q) for p, q in _traced(xs[a:b], ys[c:d])]
        elif b - a == 1:
            best = max(range(c, d), key=lambda q: matched(xs[a], ys[q]))
            out += [(a, best)] if matched(xs[a], ys[best]) else []
        else:
            middle = (a + b) // 2
            kinds, at = _kinds(ys[c:d])
            cut = c + int(np.argmax(_last_row(xs[a:middle], kinds, at) + _last_row(reversed(xs[middle:b]), kinds, at[::-1])[::-1]))
            todo += [(a, middle, c, cut), (middle, b, cut, d)]
    return sorted(out) + [(len(xs) - i, len(ys) - i) for i in range(last, 0, -1)]


def _traced(xs: tuple, ys: tuple) -> list[tuple[int, int]]:
    w, p, q, out = _table(xs, ys), len(xs), len(ys), []
    while p and q:
        if w[p][q] == w[p - 1][q]:
            p -= 1
        elif w[p][q] == w[p][q - 1]:
            q -= 1
        else:
            p, q = p - 1, q - 1
            out.append((p, q))
    return out


@functools.lru_cache(maxsize=20_000)
def alignment(a: Shape, b: Shape) -> tuple[tuple[int, int], ...]:
    """Pairs of preorder positions (in ``a``, in ``b``) of one largest common tree."""
    out: list[tuple[int, int]] = []

    def pair(x: Shape, y: Shape, i: int, j: int) -> None:
        out.append((i, j))
        at_x, at_y = [i + 1], [j + 1]
        for s in x[1]:
            at_x.append(at_x[-1] + size(s))
        for s in y[1]:
            at_y.append(at_y[-1] + size(s))
        for p, q in paired(x[1], y[1]):
            pair(x[1][p], y[1][q], at_x[p], at_y[q])

    if a[0] == b[0]:
        pair(a, b, 0, 0)
    return tuple(sorted(out))


def as_shape(x: list) -> Shape:
    label, below = x
    return TEXT if label == "#" else (label, tuple(map(as_shape, below)))


def text_key(members: list) -> str:
    """Short hash of the texts of a run of text leaves."""
    return xxhash.xxh64_hexdigest("\n".join(members).encode("utf-8", "surrogatepass"))[:10]


@functools.lru_cache(maxsize=4096)
def read_references(stored: str) -> list[dict]:
    found = json.loads(stored)
    for r in found:
        r["shape"] = as_shape(r["shape"])
        r["fixed"] = {int(i): frozenset(keys) for i, keys in r.get("fixed", {}).items()}
    return found


def reference(page: str) -> dict:
    """What is kept of a reference page: its shape, and for each node its parent, the key of its text, tag, role and the keys of its single texts."""
    root = parse(page)
    shape = shaped(root)
    kept = []
    for parent, members in nodes(root):
        leaf = isinstance(members[0], str)
        kept.append([parent, text_key(members) if leaf else "", "" if leaf else members[0].tag,
                     int(not leaf and _is_aside(members[0])), sorted({text_key([t]) for t in members}) if leaf else []])
    return {"shape": shape, "nodes": kept}


def _is_aside(e: Element) -> bool:
    """Menus, footers, adverts and the like; a header is one unless it is part of an article."""
    if e.aside:
        return True
    if e.tag != "header":
        return False
    up = e.parent
    while up is not None:
        if up.tag in ("article", "main"):
            return False
        up = up.parent
    return True


def best_reference(shape: Shape, references: list[dict]) -> int:
    """The reference with the largest common tree, by its share of both trees."""
    shares = [2 * matched(r["shape"], shape) / (size(r["shape"]) + size(shape)) for r in references]
    return max(range(len(shares)), key=lambda i: (shares[i], -i))


def counted(page: str, references: list[dict]) -> tuple[int, list[tuple[int, str, int]]]:
    """Best reference and what the page says of its nodes: (position, "", varying characters) for each
    aligned text node, and (position, key, 0) for each of its texts that the page has there."""
    root = parse(page)
    shape = shaped(root)
    k = best_reference(shape, references)
    own, ref = nodes(root), references[k]["nodes"]
    to_ref = {j: i for i, j in alignment(references[k]["shape"], shape)}
    out = []
    for j, (parent, members) in enumerate(own):
        if not isinstance(members[0], str):
            continue
        chars = sum(map(len, members))
        i = to_ref.get(j)
        if i is None:
            while parent >= 0 and parent not in to_ref:
                parent = own[parent][0]
            if parent >= 0:
                out.append((to_ref[parent], "", chars))
            continue
        out.append((i, "", 0 if ref[i][1] == text_key(members) else chars))
        out += [(i, key, 0) for key in {text_key([t]) for t in members}.intersection(ref[i][4])]
    return k, out


def content_slot(ref: dict, varying: dict[int, int]) -> int:
    """Position of the content slot in a reference; -1 if nothing outside asides varies."""
    kept = ref["nodes"]
    aside = [False] * len(kept)
    mass, headed = [0] * len(kept), [0] * len(kept)
    for i, (parent, _, _, flag, _) in enumerate(kept):
        aside[i] = bool(flag) or parent >= 0 and aside[parent]
    for i in range(len(kept) - 1, -1, -1):
        parent, _, tag, _, _ = kept[i]
        if not aside[i]:
            mass[i] += varying.get(i, 0)
            headed[i] += tag in HEADINGS and mass[i] > 0
            if parent >= 0:
                mass[parent] += mass[i]
                headed[parent] += headed[i]
    if not mass[0]:
        return -1
    here = 0
    while kept[here][2] != "article":
        below = [i for i, (parent, _, tag, _, _) in enumerate(kept) if parent == here and tag in CONTAINERS and not aside[i]]
        down = max(below, key=lambda i: mass[i], default=None)
        if down is None or mass[down] < SLOT_SHARE * mass[here] or headed[here] > headed[down]:
            break
        here = down
    return here


def template(ref: dict, slot: int, counts: list[tuple[int, str, int, int]]) -> dict[int, list[str]]:
    """Keys of the texts in the slot that are template, by node; ``counts`` are (node, key, pages, page set)."""
    inside = {slot} if slot >= 0 else set()
    for i, (parent, *_) in enumerate(ref["nodes"]):
        if parent in inside:
            inside.add(i)
    seen = {node: pages for node, key, pages, _ in counts if not key}
    out: dict[int, list[str]] = defaultdict(list)
    for node, key, pages, distinct in counts:
        if key and node in inside and pages >= TEMPLATE_SHARE * seen[node] and (distinct & (1 << 64) - 1).bit_count() >= TEMPLATE_PAGES:
            out[node].append(key)
    return {node: sorted(keys) for node, keys in out.items()}


Fixed = dict[tuple[int, int], frozenset[str]]  # (element, its run) -> keys of texts that are template


def blocks(e: Element, by_name: bool = True, fixed: Fixed | None = None) -> list[str]:
    """Text runs below an element in page order, without asides (if not ``by_name``, with those that only their name marks) and template texts."""
    out: list[str] = []
    for i, (_, members) in enumerate(e.runs):
        if isinstance(members[0], str):
            keys = fixed.get((id(e), i)) if fixed else None
            out += [c for c in members if text_key([c]) not in keys] if keys else members
            continue
        for c in members:
            if not _is_aside(c) or c.named and not by_name:
                out += blocks(c, by_name, fixed)
    return out


def fixed_runs(root: Element, to_ref: dict[int, int], fixed: dict[int, frozenset[str]]) -> Fixed:
    """Text runs of the page that align with a node of the reference that holds template texts."""
    out: Fixed = {}
    at = 0

    def walk(members: list[Element]) -> None:
        nonlocal at
        for i, (_, first) in enumerate(members[0].runs):
            at += 1
            if isinstance(first[0], str):
                keys = fixed.get(to_ref.get(at, -1))
                out.update({(id(m), i): keys for m in members} if keys else {})
            else:
                walk([x for m in members for x in m.runs[i][1]])

    walk([root])
    return out


def own_articles(root: Element) -> list[str]:
    """Text runs of the page's own idea of its main part: all article and main elements that are no asides, else all of it."""
    out: list[str] = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag in ("article", "main"):
            out += blocks(e)
            continue
        todo += [c for c in reversed(e.children) if isinstance(c, Element) and not _is_aside(c)]
    return out or blocks(root)


def main_text(page: str | None, references: list[dict]) -> tuple[str, bool]:
    """The main text of a page, and whether a wrapper found it."""
    root = parse(page)
    shape = shaped(root)
    if references:
        r = references[best_reference(shape, references)]
        if r["slot"] >= 0:
            to_page = dict(alignment(r["shape"], shape))
            j = to_page.get(r["slot"])
            if j is not None:
                members = nodes(root)[j][1]
                found = [b for m in members for b in blocks(m)]
                if r.get("fixed"):
                    fixed = fixed_runs(root, {y: x for x, y in to_page.items()}, r["fixed"])
                    varying = [b for m in members for b in blocks(m, fixed=fixed)]
                    if sum(map(len, varying)) >= KEPT_SHARE * sum(map(len, found)):
                        found = varying
                if found:
                    return "\n\n".join(found), True
    return "\n\n".join(own_articles(root) or blocks(root, by_name=False)), False


# -- jobs ----------------------------------------------------------------------------------------

def learn_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) for each host: its references as JSON, each with the position of its slot.

    Rows with a null url or html, or without a host, teach nothing.
    """
    own = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h")).filter(
        "host <> '' and html is not null").withColumn("slot_no", F.pmod("h", F.lit(REFERENCES)))
    chosen = written(own.groupBy("host", "slot_no").agg(F.min("h").alias("h")), "wrapper-chosen")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "h": b["h"], "ref": [json.dumps(reference(p)) for p in b["html"]]})

    kept = (own.join(chosen.select("host", "h"), ["host", "h"]).mapInPandas(keep, "host string, h long, ref string")
            .groupBy("host", "h").agg(F.min("ref").alias("ref")))  # copies of a chosen page
    refs = written(kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("h", "ref"))).alias("r"))  # REFERENCES at most
                   .select("host", F.concat(F.lit("["), F.array_join("r.ref", ","), F.lit("]")).alias("refs")), "wrapper-references")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])

        def handed() -> pd.DataFrame:
            out = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "ref", "node", "key", "pages", "distinct", "chars"])
            out["distinct"] = out["distinct"].astype("uint64").astype("int64")
            sums.clear()
            return out

        for b in batches:
            for host, page, h, stored in zip(b["host"], b["html"], b["h"], b["refs"], strict=True):
                k, found = counted(page, read_references(stored))
                for i, key, chars in found:
                    s = sums[host, k, i, key]
                    s[0] += 1
                    s[1] |= 1 << (h >> 8 & 63)
                    s[2] += chars
            if len(sums) > HELD:
                yield handed()
        yield handed()

    counts = (own.select("host", "html", "h").join(refs, "host")
              .mapInPandas(count, "host string, ref int, node int, key string, pages long, distinct long, chars long")
              .groupBy("host", "ref", "node", "key").agg(F.sum("pages").alias("pages"), F.bit_or("distinct").alias("distinct"), F.sum("chars").alias("chars")))
    by_host = counts.groupBy("host").agg(  # nodes and texts of the references
        F.collect_list(F.struct("ref", "node", "key", "pages", "distinct", "chars")).alias("counts"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, stored, found in zip(b["host"], b["refs"], b["counts"], strict=True):
                wrapper = []
                for k, r in enumerate(json.loads(stored)):
                    own = [c for c in found if c["ref"] == k] if found is not None else []
                    slot = content_slot(r, {c["node"]: c["chars"] for c in own if not c["key"]})
                    fixed = template(r, slot, [(c["node"], c["key"], c["pages"], c["distinct"]) for c in own])
                    wrapper.append({"shape": r["shape"], "slot": slot, "fixed": fixed})
                out.append((host, json.dumps(wrapper, separators=(",", ":"))))
            yield pd.DataFrame(out, columns=["host", "wrapper"])

    return written(refs.join(by_host, "host", "left").select("host", "refs", "counts").mapInPandas(slots, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text, n_chars (code points) and by_wrapper added (replaced if present).

    Null and empty html give an empty text. Blocks are joined by two line feeds, white space in a
    block is one space, character references are decoded. Every row gives one row.
    """
    added = ("text", "n_chars", "by_wrapper")
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in added]).alias("row")  # whatever its columns are called

    @F.pandas_udf("text string, by_wrapper boolean")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for page, wrapper in batches:
            yield pd.DataFrame([main_text(p, read_references(w) if w else []) for p, w in zip(page, wrapper, strict=True)],
                               columns=["text", "by_wrapper"])

    own = pages.select(row, url_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    found = own.join(wrappers.select("host", "wrapper"), "host", "left").select("row", find("html", "wrapper").alias("found"))
    return found.select("row.*", F.col("found.text").alias("text"), F.length("found.text").cast("long").alias("n_chars"),
                        F.col("found.by_wrapper").alias("by_wrapper"))


# -- query ---------------------------------------------------------------------------------------

def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn_wrappers(pages)).select("page_id", "url", "text", "n_chars", "by_wrapper")
