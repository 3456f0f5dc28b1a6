"""A small, forgiving HTML reader for text extraction: block elements, text runs, tree shapes.

Elements are kept as a tree of block elements; inline markup is dissolved into the text runs
between block boundaries. Runs of neighbouring siblings of the same shape count as one node of the
shape, so pages of one template have the same shape whatever the number of their paragraphs.
"""

from __future__ import annotations

import html
import re

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")  # values are read over, not searched
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist head map math object select svg template video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open element of the set ends where the element starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Elements that an implied end does not cross.
WALLS = frozenset("article aside body div footer form header html main nav section table td th ul ol dl".split())

# What pages call the parts that are not the article.
ASIDE_TAGS = frozenset("aside dialog footer form menu nav search".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ASIDE_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar"
    " topbar trending widget widgets".split())
# A class that begins or ends so tells of a part elsewhere or of a state: has-sidebar, no-sidebar, comments-open.
STATE_FIRST = frozenset("has have no not with without hide show enable disable".split())
STATE_LAST = frozenset("open opened closed enabled disabled on off allowed visible".split())
#: Levels of the tree; what is nested deeper joins the deepest level, an aside there is a level of its own.
DEPTH = 100


class Element:
    __slots__ = ("tag", "name", "aside", "named", "parent", "children", "depth", "shape", "runs", "chars")

    def __init__(self, tag: str, name: str = "", aside: bool = False, parent: Element | None = None, named: bool = False):
        self.tag, self.name, self.aside, self.parent = tag, name, aside, parent
        self.named = named  # aside by its class or id alone
        self.children: list[Element | str] = []
        self.depth = parent.depth + 1 if parent else 0


def clean(text: str) -> str:
    """Character references decoded, white space as one space, trimmed."""
    return SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()


def attributes(raw: str) -> tuple[str, bool, bool, bool]:
    """Name of an element (class and id words), whether this and whether its role marks it as aside, and whether it is hidden."""
    if "=" not in raw and "hidden" not in raw.lower():
        return "", False, False, False
    words: list[str] = []
    named = aside = hidden = False
    for key, *values in ATTRIBUTE.findall(raw):
        value, key = "".join(values), key.lower()
        if key in ("class", "id"):
            for token in value.split():
                own = [w.lower() for w in TOKEN.findall(token)]
                words += own
                named |= bool(own) and own[0] not in STATE_FIRST and own[-1] not in STATE_LAST and not ASIDE_NAMES.isdisjoint(own)
        elif key == "role":
            aside |= value.strip().lower() in ASIDE_ROLES
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none", value, re.I))
    return ".".join(words), named, aside, hidden


def parse(page: str | None) -> Element:
    """The tree of block elements; its text leaves are cleaned, non-empty runs."""
    root = here = Element("html")
    stack: list[tuple[str, Element]] = []  # open elements, inline ones too, with the block around them
    text: list[str] = []
    page = page or ""
    at = unseen = 0
    unseen_tag = ""

    def flush() -> None:
        if text:
            run = clean("".join(text))
            text.clear()
            if run:
                here.children.append(run)

    def leave(k: int) -> None:
        """Close all elements from position ``k`` of the stack on."""
        nonlocal here
        flush()
        here = stack[k][1]
        del stack[k:]

    while True:
        m = MARKUP.search(page, at)
        if not unseen:
            text.append(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if unseen:
            if tag == unseen_tag:
                unseen += -1 if end else 0 if raw.endswith("/") else 1
            continue
        if end:
            if tag == "p" and not any(t == "p" for t, _ in stack):
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in BLOCK for t, _ in stack[k:]):
                        leave(k)
                    else:
                        del stack[k]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end does not leave its block
            continue
        if tag in ("br", "hr") or tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        name, named, aside, hidden = attributes(raw) if raw else ("", False, False, False)
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = closed.end() if closed else len(page)
            continue
        if tag in UNSEEN or hidden and not raw.endswith("/"):
            unseen, unseen_tag = 1, tag
            if tag in BLOCK:
                flush()
            continue
        if tag not in BLOCK:
            if not raw.endswith("/"):
                stack.append((tag, here))
            continue
        for ending in ({"p"} | ENDS.get(tag, set()) if tag not in ("html", "body") else set(),):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ending:
                    leave(k)
                    break
                if stack[k][0] in WALLS and not (tag == "tr" and stack[k][0] in ("td", "th")):
                    break
        flush()
        if tag in ("html", "body"):
            continue
        aside |= tag in ASIDE_TAGS
        new = Element(tag, name, aside or named, here, named and not aside)
        stack.append((tag, here))
        if here.depth < DEPTH or here.depth == DEPTH and (new.aside or tag == "header"):
            here.children.append(new)
            here = new
    flush()
    return root


Shape = tuple  # (label, shapes of the runs of children)
TEXT: Shape = ("#", ())


def shaped(e: Element) -> Shape:
    """Sets the shape, the runs of children and the characters of an element and all below it.

    Elements without any text are taken out.
    """
    runs: list[tuple[Shape, list]] = []
    e.chars = 0
    for c in e.children:
        if isinstance(c, str):
            s, n = TEXT, len(c)
        else:
            s, n = shaped(c), c.chars
            if not n:
                continue
        e.chars += n
        if runs and runs[-1][0] == s:
            runs[-1][1].append(c)
        else:
            runs.append((s, [c]))
    e.runs = runs
    e.shape = (f"{e.tag}.{e.name}" if e.name else e.tag, tuple(s for s, _ in runs))
    if e.parent is None:
        _keep_main(e)
    return e.shape


def _keep_main(root: Element) -> None:
    """An element that is aside by its name alone is not if it holds most of the page's text and a main or article."""
    todo = [root]
    while todo:
        e = todo.pop()
        if e.aside and e.named and _holds_main(e):
            e.aside = e.named = False
        todo += [c for c in e.children if isinstance(c, Element) and 2 * c.chars > root.chars]


def _holds_main(e: Element) -> bool:
    todo = [e]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main"):
            return True
        todo += [c for c in x.children if isinstance(c, Element) and not c.aside]
    return False


def nodes(root: Element) -> list[tuple[int, list]]:
    """The nodes of the root's shape in preorder: position of the parent, the elements or texts of the run."""
    out: list[tuple[int, list]] = []

    def add(parent: int, members: list) -> None:
        out.append((parent, members))
        me = len(out) - 1
        if isinstance(members[0], Element):
            for i in range(len(members[0].runs)):
                add(me, [x for m in members for x in m.runs[i][1]])

    add(-1, [root])
    return out
