"""License scan: native cosine against a plain one, inheritance, edge rows."""

import math
import re

from pyspark.sql import functions as F

from territory_engine.llm import licenses as L

FILES = [("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code\nno header"), ("a/b/c/y.py", "# Licensed under CC BY-NC 4.0.\nmore"),
         ("a/b/c/z.py", "nothing"), ("a/b/COPYING.txt", "long text\nThis work is licensed under the GNU General Public License, version 3.\nend"),
         ("ab/q.py", "nothing"), ("top.py", "Licensed under the Apache License, Version 2.0 by us"), ("plain.py", ""), ("a/b/c/LICENSE.md", "no licence here"),
         (None, "Released under the MIT License."), (None, None), ("a/n.py", None), ("a/x.py", "code\nno header"), ("e/LICENSE", None),
         ("d/long.py", "the of and " * 20000 + "\nReleased under the MIT License."), ("d/e/LICENCE", "Released under the MIT License.")]


def plain_best(path, text, files):
    """Best (score, licence) of a file's units, from the definition."""
    tokens = lambda t: re.findall(L.TERM, t.lower())
    n = len(files)
    df = lambda t: sum(t in set(tokens(x or "")) for _, x in files)
    vocabulary = {t for _, x in L.TEMPLATES for t in tokens(x)}
    weight = lambda t: L.idf(df(t) if t in vocabulary else 0, n)
    units = (text or "").split("\n") + ([text or ""] if path and re.match(L.LICENCE_FILE[4:], path.split("/")[-1], re.I) else [])
    best = None
    for u in units:
        v = {t: tokens(u).count(t) * weight(t) for t in set(tokens(u))}
        for licence, x in L.TEMPLATES:
            w = {t: tokens(x).count(t) * weight(t) for t in set(tokens(x))}
            if v:
                c = sum(v[t] * w[t] for t in v.keys() & w.keys()) / math.sqrt(sum(a * a for a in v.values()) * sum(a * a for a in w.values()))
                if round(c, 4) >= L.THRESHOLD and (best is None or (-round(c, 4), licence) < (-best[0], best[1])):
                    best = (round(c, 4), licence)
    return best


def test_own_and_inherited_licences(spark):
    files = spark.createDataFrame([(i, *f) for i, f in enumerate(FILES)], "file_id long, path string, text string").withColumns(
        {c: F.lit("clash") for c in ("licence", "directory", "f1", "own_licence", "dir_path", "row")})
    got = {r["file_id"]: r for r in L.scan_licences(files, L.TEMPLATES).collect()}
    assert len(got) == len(FILES)
    for i, (path, text) in enumerate(FILES):
        own = plain_best(path, text, FILES)
        assert (got[i]["licence_origin"] == "own") == (own is not None), path
        if own:
            assert (got[i]["licence"], got[i]["licence_path"]) == (own[1], path) and abs(got[i]["licence_score"] - own[0]) < 2e-4
    from_ = {FILES[i][0]: (r["licence"], r["licence_path"]) for i, r in got.items() if r["licence_origin"] == "inherited"}
    assert from_ == {"a/x.py": ("MIT", "a/LICENSE"), "a/n.py": ("MIT", "a/LICENSE"), "a/b/c/z.py": ("GPL-3.0", "a/b/COPYING.txt"),
                     "a/b/c/LICENSE.md": ("GPL-3.0", "a/b/COPYING.txt")}
    assert got[5]["licence_origin"] == got[10]["licence_origin"] == "none" and got[5]["licence"] is None


def test_no_python_in_the_plan(spark):
    files = spark.createDataFrame([(1, "a/b", "x")], "file_id long, path string, text string")
    plan = L.scan_licences(files, L.TEMPLATES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert L.scan_licences(spark.createDataFrame([], "path string, text string"), L.TEMPLATES).count() == 0


def test_needed_terms_bound_the_cosine():
    vectors = L.template_vectors(L.TEMPLATES, {"the": 900, "license": 3}, 1000)
    needed = set(L.needed_terms(vectors, L.THRESHOLD))
    for _, v in vectors:
        assert math.sqrt(sum(x * x for t, x in v.items() if t not in needed)) < L.THRESHOLD
