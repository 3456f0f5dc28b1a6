"""Tree matching against brute force, wrapper induction on made-up templates, edge rows."""

import functools
import random
import time

from pyspark.sql import functions as F

from territory_engine.llm import extraction as X
from territory_engine.llm import dom  # noqa: F401


def texts(page):
    return X.main_text(page, [])[0].split("\n\n")


def test_reader_on_awkward_markup():
    assert texts("<p>a &amp; b&nbsp;&lt;c<br>d<p>e <b>f</i> g") == ["a & b <c d", "e f g"]
    assert texts('<script>var t="</p><p>no";</script><style>p{}</style><p title="a>b">x</p><!-- <p>no -->y') == ["x", "y"]
    assert texts("<article><h1>T</h1><div class='side-comments'>no</div><ul><li>1<li>2</ul>tail</article><footer>no") == ["T", "1", "2", "tail"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<header>no</header><main><header>yes</header><form>no</form><p hidden>no</p><p style='display: none'>no</p>t</main>") == ["yes", "t"]
    assert texts("<div role=navigation>no</div><noscript>no</noscript><template><p>no</p></template>1 < 2 &copy; <") == ["1 < 2 © <"]
    assert texts("<p>cut <a href='x") == ["cut <a href='x"] or texts("<p>cut <a href='x")[0].startswith("cut")
    assert X.main_text(None, []) == ("", False) and X.main_text("", []) == ("", False)
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert texts(deep) == ["deep"]
    assert len(texts("<article>" + "<p>word</p>" * 20000 + "</article>")) == 20000
    for levels in (50, 99, 100, 101, 120, 3000):
        assert texts("<div>" * levels + "text<nav>no<div>no</div></nav><header>no</header>" + "</div>" * levels) == ["text"], levels


def test_attributes_are_read_as_names_and_values():
    for c in ("layout has-sidebar", "no-sidebar", "post comments-open", "content-sidebar-wrap"):
        assert texts(f"<div class='{c}'><article><p>text</p></article></div>") == ["text"], c
        assert texts(f"<main class='{c}'>text</main><div class='cookie-bar'>no</div>") == ["text"], c
    assert texts("<p title='a hidden gem'>a</p><p data-hidden='false'>b</p><p><a href=/hidden/falls>c</a></p><p hidden>no</p>") == ["a", "b", "c"]
    assert texts("<div class=widget><p>all of the page</p></div><footer>no</footer>") == ["all of the page"]


def test_all_parts_of_a_main_text_are_kept():
    parts = "<div><article><p>part one</p></article><aside>no</aside><article><p>the longer part two</p></article><main>three</main></div>"
    assert texts("<div class=menu>no</div>" + parts) == ["part one", "the longer part two", "three"]
    page = "<div class=menu>no</div><div><h1>heading</h1><p>lead</p>" + parts + "</div>"
    ref = X.reference(page)
    slot = next(i for i, n in enumerate(ref["nodes"]) if n[0] == 0 and n[2] == "div" and not n[3])
    assert X.main_text(page, [{"shape": ref["shape"], "slot": slot}]) == ("heading\n\nlead\n\npart one\n\nthe longer part two\n\nthree", True)


def random_shape(rng, depth=3):
    kids = [random_shape(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return (rng.choice("ab"), tuple(kids))


@functools.cache
def brute_match(a, b):
    """Largest common tree by trying all pairings of the children."""
    if a[0] != b[0]:
        return 0

    @functools.cache
    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        m = brute_match(a[1][i], b[1][j])
        return max(best(i + 1, j), best(i, j + 1), m + best(i + 1, j + 1) if m else 0)

    return 1 + best(0, 0)


def test_tree_matching_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = random_shape(rng), random_shape(rng)
        assert X.matched(a, b) == brute_match(a, b)
        pairs = X.alignment(a, b)
        assert len(pairs) == brute_match(a, b) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_long_rows_of_children_equal_the_whole_table(monkeypatch):
    rng = random.Random(3)
    pairs = [(random_shape(rng), random_shape(rng)) for _ in range(150)]
    pairs += [(("a", tuple(random_shape(rng, 1) for _ in range(rng.randint(5, 40)))), ("a", tuple(random_shape(rng, 1) for _ in range(40)))) for _ in range(20)]
    whole = [X.matched(a, b) for a, b in pairs]
    monkeypatch.setattr(X, "CELLS", 4)
    X.matched.cache_clear()
    X.alignment.cache_clear()
    assert [X.matched(a, b) for a, b in pairs] == whole
    for (a, b), n in zip(pairs, whole, strict=True):
        found = X.alignment(a, b)
        assert len(found) == n and all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:], strict=False))
    X.matched.cache_clear()
    X.alignment.cache_clear()


def test_a_page_of_many_runs():
    made = [X.reference("<article>" + "".join(rng.choice(["<p>a</p>", "<ul><li>b</ul>", "<h2>c</h2>", "<p><table><tr><td>d</table>"]) for _ in range(20_000)) + "</article>")["shape"]
            for rng in map(random.Random, (4, 5))]
    start = time.monotonic()
    assert len(X.alignment(*made)) == X.matched(*made)
    assert time.monotonic() - start < 20


def page(rng, plain, n):
    words = lambda k: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(k))
    body = [words(30) for _ in range(n)]
    title = words(6)
    content = f"<h2>{title}</h2>" + "".join(f"<p>{b}</p>" for b in body)
    main = f"<div class=x1>{content}</div>" if plain else f"<article>{content}</article>"
    html = f"<html><body><div class=x0>Welcome to our site</div><div class=menu><a href=1>{words(2)}</a></div>{main}<div class=x2>All rights kept by us</div></body></html>"
    return html, "\n\n".join([title, *body])


def test_wrappers_find_the_slot_without_helpful_markup(spark):
    rng = random.Random(2)
    made = [("http://plain.org/" if k % 2 else "http://good.org/", *page(rng, k % 2 == 1, rng.randint(2, 6))) for k in range(40)]
    rows = [(i, u + str(i), h) for i, (u, h, _) in enumerate(made)]
    lone, lone_text = page(rng, True, 3)
    rows += [(90, "http://plain.org/none", None), (91, None, made[0][1]), (92, "no host", made[0][1]), (93, "http://lone.org/", lone), (0, rows[0][1], rows[0][2]),
             (94, "http://plain.org/odd", "<p>other layout</p>"), (95, "http://plain.org/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    out = X.extract(pages, X.learn_wrappers(pages))
    assert sorted(out.columns) == sorted(["page_id", "url", "html", "host", "text", "n_chars", "by_wrapper"])
    got = {}
    for r in out.collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[0]) == 2
    for i, (_, _, want) in enumerate(made):
        assert got[i][0]["text"] == want and got[i][0]["n_chars"] == len(want), i
    assert all(got[i][0]["by_wrapper"] for i in range(1, 40, 2))
    assert got[90][0]["text"] == got[95][0]["text"] == "" and got[90][0]["n_chars"] == 0
    assert got[91][0]["text"] == got[92][0]["text"] == made[0][2]
    assert got[94][0]["text"] == "other layout" and lone_text in got[93][0]["text"]


def test_texts_equal_on_all_pages_are_template(spark):
    rng = random.Random(6)
    words = lambda k: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(k))
    rows, want = [], {}
    for i in range(30):
        title, body = words(5), [words(25) for _ in range(rng.randint(1, 4))]
        story = "".join(f"<p>{b}</p>" for b in body)
        rows.append((i, f"http://t.org/{i}", f"<div class=x1><div class=x7>Our shop has moved to Main Street.</div><h2>{title}</h2><div class=x8>{story}"
                     f"<p>Read on in our paper.</p></div><div class=x9>All rights kept.</div></div>"))
        want[i] = "\n\n".join([title, *body])
    rows += [(100 + i, "http://t.org/copy", rows[0][2]) for i in range(50)]
    want.update({100 + i: want[0] for i in range(50)})
    same, texts = words(60), [words(8) for _ in range(12)]
    for i, t in enumerate(texts):  # near copies of one article
        rows.append((200 + i, "http://near.org/", f"<div class=x1><p>{same}</p><p>{t}</p></div>"))
        want[200 + i] = f"{same}\n\n{t}"
    for i in range(12):  # exact copies of one article beside one other page
        rows.append((300 + i, "http://copies.org/", f"<div class=x1><p>{same}</p></div>"))
        want[300 + i] = same
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__found", F.lit("clash")).withColumn("wrapper", F.lit("clash"))
    got = {r["page_id"]: r for r in X.extract(pages, X.learn_wrappers(pages)).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(got[i]["by_wrapper"] for i in range(30)) and got[0]["wrapper"] == got[0]["__found"] == "clash"


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert X.extract(none, X.learn_wrappers(none)).count() == 0
