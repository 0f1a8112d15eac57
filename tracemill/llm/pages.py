"""Main text of web pages by scoring a page's tree.

Paragraphs pass points for their length and commas to their ancestors, less at each level; the share
of a container's text that lies in links discounts its points. The best container, widened to the
article that holds it, is kept with those siblings that score well or read as text. What is plainly
no article (menus, forms, adverts and the like, by element, role or whole name) is taken out first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracemill.llm import ship

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
HEAD = frozenset("base link meta title style script noscript template".split())
DROP = frozenset("head nav footer aside form button select menu dialog object svg math canvas audio video map datalist option fieldset legend label".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE_SCOPE = frozenset("article aside blockquote body button dd details div dl dt fieldset figcaption figure footer form header html li main nav ol section table td th tr ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE_OF = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption div section article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words in class or id names. A whole name of such words marks a container as no article, a part of
# one lowers its score; other elements are marked by names of adverts alone.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion "
    "disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
# Words that say how a part is laid out or whose it is; beside a word of the above they change nothing.
FRAMES = frozenset(
    "area author bar block body bottom box button buttons card column container content count counter entry group heading icon icons "
    "inner item items label left link links list outer panel post posts reader region right row section site slot strip text thread "
    "title top unit user wrap wrapper".split()
)
ADVERTS = frozenset("ad ads advert adverts advertisement advertising hidden promo promoted promotion sponsor sponsored".split())
CONTAINERS = frozenset("a center details div dl ol section table ul".split())
KEEP = frozenset("html body main article".split())
PART, WHOLE = 1, 2
PAGE = ("#root", "html", "body")
LINKED = 0.3  # share of links from which a sibling is no text
LEAST_TEXT = 25  # characters of a paragraph that counts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
# What begins a token without any ">" behind it; it takes the rest of the page.
OPEN = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?].*", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
HUMP = re.compile("([a-z])([A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "attributes", "mark", "score", "chars", "links")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.mark, self.score = 0, 0.0
        self.chars = self.links = 0


def unwanted(tag: str, attributes: str, depth_in_article: bool) -> bool:
    """Whether an element is no part of an article, by its name or role, or is not shown."""
    if tag in DROP or (tag == "header" and not depth_in_article):
        return True
    if not attributes or tag in KEEP:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value.strip() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def marked(tag: str, attributes: str) -> int:
    """``WHOLE`` if a class or id has only words of ``NAMES``, or ``FRAMES`` beside one; ``PART`` if one has such a word, else 0."""
    if not attributes or tag in KEEP:
        return 0
    words, found = NAMES if tag in CONTAINERS else ADVERTS, 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for label in HUMP.sub(r"\1-\2", a or b or c).lower().split():
                parts = [w for w in re.split(r"[^a-z]+", label) if w]
                if any(w in words for w in parts):
                    if all(w in words or w in FRAMES for w in parts):
                        return WHOLE
                    found = PART
    return found


def _measure(nodes: list[Node]) -> None:
    """Characters of each node's text, and of its links; children come before parents."""
    for x in nodes:
        own = sum(len(SPACE.sub(" ", c).strip()) for c in x.children if isinstance(c, str))
        inner = [c for c in x.children if isinstance(c, Node)]
        x.chars = own + sum(c.chars for c in inner)
        x.links = x.chars if x.tag == "a" else sum(c.links for c in inner)


def _prune(root: Node) -> None:
    """Take out the elements of a ``WHOLE`` mark, but none that may be or hold the article.

    That is one with an h1; and, if no article or main element with a text stands beside it, one with
    such an element or with most of the page's text outside links. These lose their mark.
    """
    nodes = list(_walk(root))
    if not any(x.mark for x in nodes):
        return
    _measure(nodes)
    holds: dict[int, tuple[bool, bool]] = {}  # an h1, an article
    for x in nodes:
        inner = [holds[id(c)] for c in x.children if isinstance(c, Node)]
        holds[id(x)] = (x.tag == "h1" and x.chars > 0) or any(h for h, _ in inner), x.tag in ("article", "main") or any(a for _, a in inner)
    beside: set[int] = set()
    stack = [root]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main") and x.chars > x.links:
            beside.add(id(x))
        stack.extend(c for c in x.children if isinstance(c, Node) and c.mark != WHOLE)
    most = (root.chars - root.links) / 2
    around = [(root, 0)]
    while around:
        x, within = around.pop()
        within += id(x) in beside
        kept: list[Node | str] = []
        for c in x.children:
            if isinstance(c, Node):
                if c.mark:
                    h1, article = holds[id(c)]
                    if h1 or (len(beside) == within or c.mark == PART) and (article or c.chars - c.links > most):
                        c.mark = 0
                    elif c.mark == WHOLE:
                        continue
                around.append((c, within))
            kept.append(c)
        x.children = kept


def parse(html: str) -> Node:
    """The element tree, without what is no article. Open tags are closed where HTML implies it."""
    root = Node("#root", None)
    at, pos, dropped, article = root, 0, 0, 0

    def close_to(node: Node) -> None:
        nonlocal at, article, dropped
        x = at
        while x is not node.parent:
            article -= x.tag in ("article", "main")
            dropped -= x.attributes is DROPPED
            x = x.parent
        at = node.parent

    last = html.rfind(">") + 1  # no tag ends behind it, so none is looked for there
    while True:
        m = TOKEN.search(html, pos, last) if pos < last else None
        if m and m.end() == last and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>")):
            m = OPEN.match(html, m.start())
        m = m or OPEN.search(html, max(pos, last))
        text = html[pos : m.start() if m else len(html)]
        if at.tag == "head" and text and not text.isspace():
            close_to(at)
        if text and not dropped:
            at.children.append(unescape(text) if "&" in text else text)
        if not m:
            _prune(root)
            return root
        pos = m.end()
        tag = "" if m.re is OPEN else (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not dropped:
                at.children.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            x = at
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                close_to(x)
            continue
        attributes = m[3] or m[6] or ""
        if at.tag == "head" and tag not in HEAD:
            close_to(at)
        if tag in VOID:
            if not dropped and tag in BLOCK:
                at.children.append(Node(tag, at))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if tag in BLOCK:
            x = at
            while x is not root and x.tag != "p" and x.tag not in INLINE_SCOPE:
                x = x.parent
            if x.tag == "p":
                close_to(x)
        if tag in SELF_CLOSING:
            x = at
            while x is not root and x.tag not in SELF_CLOSING[tag] and x.tag not in SCOPE_OF[tag]:
                x = x.parent
            if x.tag in SELF_CLOSING[tag]:
                close_to(x)
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        child = Node(tag, at, attributes)
        if unwanted(tag, attributes, article > 0):
            child.attributes = DROPPED
            dropped += 1
        elif not dropped:
            child.mark = marked(tag, attributes)
            at.children.append(child)
        article += tag in ("article", "main")
        at = child


DROPPED = "\0dropped"


def _walk(root: Node) -> Iterator[Node]:
    """Every node, children before parents."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if isinstance(c, Node))
    return reversed(order)


def _text(node: Node | str) -> str:
    """Blocks of the subtree, each with single spaces, joined by one space."""
    out: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append(" ")
        elif isinstance(x, str):
            out.append(x)
        else:
            edge = x.tag in BLOCK
            if edge:
                out.append(" ")
                stack.append(None)
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def points(text: str) -> float:
    """What a paragraph passes to its parent: one, its commas, and its length in hundreds, 3 at most."""
    return 1 + text.count(",") + min(len(text) // 100, 3)


def score(root: Node) -> Node | None:
    """Score every container; the best, or None if there is no paragraph of some length."""
    nodes = list(_walk(root))
    _measure(nodes)
    candidates: dict[int, Node] = {}
    for x in nodes:
        if x.tag not in PARAGRAPHS or x.parent is None:
            continue
        if any(isinstance(c, Node) and c.tag in BLOCK and c.tag != "br" for c in x.children):
            text = " ".join(c.strip() for c in x.children if isinstance(c, str))
        else:
            text = _text(x)
        if len(text) < LEAST_TEXT:
            continue
        gain, up, level = points(text), x if x.tag in ("div", "section", "article", "main", "td") else x.parent, 1
        while up is not None and level <= 4:
            up.score += gain / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            candidates[id(up)] = up
            up, level = up.parent, level + 1
    best = None
    for x in candidates.values():
        x.score *= (1 - x.links / x.chars if x.chars else 0) * (0.5 if x.mark else 1)
        if x.tag != "#root" and (best is None or x.score > best.score or (x.score == best.score and x.depth < best.depth)):
            best = x
    return best


def _outermost(root: Node) -> list[Node]:
    """Article and main elements that lie in no other one, in order."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main"):
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return found


def _around(centre: Node, least: float, wrapped: bool) -> tuple[list[str], list[str]]:
    """Texts of the siblings before and after ``centre`` that read as text: their links are few.

    Bare text with the inline elements beside it counts as a paragraph. A plain container needs a
    score, a place between siblings that are kept, or a parent that wraps the article (``wrapped``).
    """
    items: list[tuple[str, bool]] = []  # text, and whether it is kept wherever it stands
    run: list[Node | str] = []

    def close() -> None:
        links = sum(c.links for c in run if isinstance(c, Node))
        chars = sum(c.chars if isinstance(c, Node) else len(SPACE.sub(" ", c).strip()) for c in run)
        if chars and links / chars < LINKED:
            whole = Node("span", None)
            whole.children = run.copy()
            items.append((_text(whole), True))
        run.clear()

    place = 0
    for c in centre.parent.children:  # type: ignore[union-attr]
        if c is centre:
            close()
            place = len(items)
            items.append(("", True))
        elif isinstance(c, str) or c.tag not in BLOCK or c.tag == "br":
            run.append(c)
        else:
            close()
            if c.chars and c.links / c.chars < LINKED:
                items.append((_text(c), c.tag not in CONTAINERS or c.tag in ("dl", "ol", "table", "ul") or c.score >= least or (wrapped and not c.mark)))
    close()
    sure = [i for i, (_, s) in enumerate(items) if s]
    kept = [t for t, _ in items[sure[0] : sure[-1] + 1]]
    return kept[: place - sure[0]], kept[place - sure[0] + 1 :]


def extract(html: str) -> str:
    """The main text of a page; empty if it has none."""
    root = parse(html)
    best = score(root)
    if best is None:  # only short texts: the articles, else the whole body
        articles = _outermost(root)
        return " ".join(t for t in map(_text, articles) if t) if articles else _text(root)
    x = best  # the outermost article or main element around the best container is the article
    while x.parent is not None:
        x = x.parent
        if x.tag in ("article", "main"):
            best = x
    while best.parent is not None and best.parent.tag not in PAGE and best.tag not in ("article", "main"):
        scored = [c for c in best.parent.children if isinstance(c, Node) and c.score > 0]
        if len(scored) < 2 and best.parent.chars > best.chars:
            break
        best = best.parent
    if best.parent is None or best.tag == "main":
        return _text(best)
    least = max(4.0, 0.2 * best.score)
    if best.tag == "article":
        kept: list[str] = []
        for c in best.parent.children:
            if c is best:
                kept.append(_text(c))
            elif isinstance(c, Node) and c.chars:
                long = c.tag in ("p", "pre", "blockquote", "ul", "ol", "table") and c.chars >= LEAST_TEXT
                if c.links / c.chars < LINKED and (c.tag in HEADINGS or c.tag == "article" or c.score >= least or long):
                    kept.append(_text(c))
        return " ".join(t for t in kept if t)
    before, after = [], []
    centre = best
    while centre.parent is not None:
        first, last = _around(centre, least, centre is best and centre.parent.tag not in PAGE)
        before, after = first + before, after + last
        centre = centre.parent
        if centre.tag in PAGE:
            break
    return " ".join(t for t in [*before, _text(best), *after] if t)


def extract_text(table: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text, n_chars): the main text of every whole page and its code points.

    A null or empty page, and one without text, has the empty text. Repeated rows give repeated
    rows; other columns are not read.
    """
    ship(table.sparkSession)
    columns = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = pa.array([extract(h) if h else "" for h in batch.column(len(columns)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], texts, pc.cast(pc.utf8_length(texts), pa.int64())], [*columns, "text", "n_chars"])

    fields = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in columns)
    return table.select(*columns, html_col).mapInArrow(run, f"{fields}, text string, n_chars long")
