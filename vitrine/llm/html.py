"""The main text of web pages, by scores passed up the tree of elements.

Elements that are never part of an article (menus, footers, forms, scripts, and
what its class, id or role calls an advert, a sidebar, a notice or comments) go
first.  Every paragraph then passes points for its length and commas to the
elements around it, half as many at each step up; the points of an element
count less, the more of its text lies in links.  The best element is the
container of the article; it takes in those around it that hold nothing else,
and the siblings that are headings, paragraphs or good containers themselves.
Its blocks are the text, one line each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import values_of

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
NEVER = frozenset((
    "head nav footer aside form script style noscript iframe button select textarea template dialog menu svg math object "
    "embed canvas audio video map noembed noframes xmp title search datalist").split())
# What an open element of the first kind ends when one of the second begins, and where that search stops.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
# Words of a class, id or role.  The first kind goes whatever it holds; the second unless it holds the article.
ALWAYS = frozenset((
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe subscription signup paywall comment comments disqus respond replies reply "
    "commentlist share sharing social").split())
LAYOUT = frozenset((
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead banner toolbar widget widgets related "
    "recommended recommendations teaser teasers notice notices notification alert pagination pager complementary contentinfo search "
    "login skip topbar bottombar rail").split())
MAX_DEPTH = 500             # deeper elements are read as if they were not nested further
LEAST_SHARE = 0.2           # of the container's points that make a sibling a good one
LINK_MENU = 0.8             # share of text in links, with MENU_LINKS links or more, that makes a menu
MENU_LINKS = 3
LEAST_LOOSE = 25            # characters of text outside paragraphs that count as one

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMAS = ",;\u060c\u3001\uff0c\uff1b"


class Element:
    """A node of the tree; ``children`` are elements and text."""

    __slots__ = ("tag", "parent", "children", "names", "hidden", "article", "own", "commas",
                 "words", "links", "line", "line_links", "line_commas", "inner", "points", "mass")

    def __init__(self, tag: str, parent: "Element | None", rest: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.hidden, self.article = frozenset(), False, tag in ("article", "main")
        self.own = self.commas = 0       # characters and commas of text right in it
        # Set by measure(): characters in all and in links (words, links); of its line alone, without inner
        # blocks (line, line_links, line_commas); whether it holds paragraphs (inner); points passed up to it
        # (points); characters of paragraphs in it (mass).
        if rest:
            names: set[str] = set()
            for m in NAMES.finditer(rest):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role"):
                    names.update(w.lower() for w in WORDS.findall(value))
                    self.article |= key == "role" and value.strip().lower() in ("main", "article")
                elif key == "itemprop":
                    self.article |= value.strip() == "articleBody"
                elif key == "style":
                    self.hidden |= bool(HIDDEN.search(value))
                else:
                    self.hidden |= key == "hidden" or value.strip().lower() == "true"
            self.names = frozenset(names)


def parsed(html: str) -> Element:
    """The tree of a page, however its tags are closed."""
    root = current = Element("#root", None)
    depth, at, end = 0, 0, len(html)
    opened: dict[str, int] = {}

    def leave(to: Element) -> None:
        nonlocal current, depth
        while current is not to:
            opened[current.tag] -= 1
            current, depth = current.parent, depth - 1

    def text(a: int, b: int) -> None:
        if a < b:
            found = unescape(html[a:b])
            current.children.append(found)
            current.own += len(found.strip())
            current.commas += sum(map(found.count, COMMAS))

    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            break
        text(at, m.start())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if opened.get(tag):
                found = current
                # An inline element does not reach out of its block.
                while found.tag != tag and (tag in BLOCKS or found.tag not in BLOCKS):
                    found = found.parent
                if found.tag == tag:
                    leave(found.parent)
            elif tag == "br":
                current.children.append(" ")
            continue
        if tag in BLOCKS and opened.get("p") and tag not in ("html", "body"):
            found = current
            while found.tag != "p" and found.tag not in BLOCKS:
                found = found.parent
            if found.tag == "p":
                leave(found.parent)
        closes, fences = CLOSED_BY.get(tag), FENCES.get(tag)
        if closes and any(opened.get(c) for c in closes):
            found, last = current, None
            while found.parent is not None and found.tag not in fences:
                if found.tag in closes:
                    last = found
                found = found.parent
            if last is not None:
                leave(last.parent)
        element = Element(tag, current, m["rest"])
        current.children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = close.start() if close else end
            after = TOKEN.match(html, at)
            at = after.end() if after else end
        elif tag not in VOID and not (m["rest"].endswith("/") and tag in ("path", "circle", "rect", "use", "g")) and depth < MAX_DEPTH:
            current, depth = element, depth + 1
            opened[tag] = opened.get(tag, 0) + 1
    text(at, end)
    return root


def in_order(root: Element) -> list[Element]:
    """Elements, each before those in it."""
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        found.append(e)
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    return found


def measure(root: Element) -> list[Element]:
    """Text and link lengths of all elements, and the points that paragraphs pass up."""
    elements = in_order(root)
    for e in reversed(elements):
        e.points, e.mass, e.inner = 0.0, 0, False
        e.words, e.links, e.line, e.line_links, e.line_commas = e.own, 0, e.own, 0, e.commas
        for c in e.children:
            if c.__class__ is str:
                continue
            e.words += c.words
            e.links += c.links
            if c.tag in BLOCKS:
                e.inner |= c.tag in PARAGRAPHS or c.tag == "div"
            else:
                e.line += c.line
                e.line_links += c.line_links
                e.line_commas += c.line_commas
        if e.tag == "a":
            e.links, e.line_links = e.words, e.line
    for e in elements:
        direct = e.tag in PARAGRAPHS and not e.inner
        loose = e.tag not in PARAGRAPHS and e.tag not in HEADINGS and (e.tag in BLOCKS or e.parent is None)
        if not (direct or loose) or e.line < (1 if direct else LEAST_LOOSE):
            continue
        points = (1 + e.line_commas + min(e.line / 100, 3)) * (1 - e.line_links / e.line)
        start = e.parent if direct else e
        up, weight = start, 1.0
        while up is not None:
            if weight > 0.1:
                up.points += points * weight
            up.mass += e.line
            up, weight = up.parent, weight / 2
    for e in elements:
        e.points *= 1 - e.links / max(e.words, 1)
    return elements


def prune(root: Element) -> list[Element]:
    """Removes what is no article; the measured elements that stay."""
    for e in in_order(root):
        e.children = [c for c in e.children if isinstance(c, str) or not (c.tag in NEVER or c.hidden)]
    elements = measure(root)
    holds = {id(a) for e in elements if e.article for a in ancestors(e)}
    keep_mass = root.mass / 2
    for e in elements:
        def goes(c: Element) -> bool:
            if c.tag in ("html", "body") or c.tag == "main":
                return False
            if c.tag == "article":
                return bool(c.names & {"comment", "comments", "ad", "advert", "advertisement", "sponsored", "teaser"})
            if c.names & ALWAYS and not (id(c) in holds and not c.names & {"comment", "comments"}):
                return True
            return bool(c.names & LAYOUT or c.tag == "header" and not any(a.article for a in ancestors(c))) \
                and id(c) not in holds and c.mass <= keep_mass
        e.children = [c for c in e.children if isinstance(c, str) or not goes(c)]
    return measure(root)


def ancestors(e: Element) -> Iterator[Element]:
    while (e := e.parent) is not None:
        yield e


def is_menu(e: Element) -> bool:
    if e.tag in PARAGRAPHS | HEADINGS or e.tag not in BLOCKS or not e.words or e.links < LINK_MENU * e.words:
        return False
    return sum(x.tag == "a" for x in in_order(e)) >= MENU_LINKS


def container(elements: list[Element]) -> list[Element]:
    """The best element, widened, and its siblings that belong to the article."""
    best = max(elements, key=lambda e: e.points)
    if best.points <= 0:
        return [elements[0]]
    # An article around it is its container, and so is any element that holds little else.
    marked = [a for a in (best, *ancestors(best)) if a.article]
    if marked:
        best = marked[0]
    while best.parent is not None and not best.article and best.parent.tag != "#root" and best.parent.mass == best.mass:
        best = best.parent
    if best.article or best.parent is None:
        return [best]
    found = []
    for s in best.parent.children:
        if isinstance(s, str) or s is best:
            found += [best] * (s is best)
            continue
        density = s.links / max(s.words, 1)
        good = s.points >= LEAST_SHARE * best.points and s.points > 0 or bool(s.names & best.names) and density < 0.5
        if good or density < 0.33 and (s.tag in PARAGRAPHS | HEADINGS or s.mass and s.tag in BLOCKS and density < 0.1):
            found.append(s)
    return found


def lines(e: Element) -> list[str]:
    """The blocks of an element in page order, white space made one."""
    out, line = [], []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list[Element | str | None] = [e]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            line.append(c)
        elif c.tag == "br":
            line.append(" ")
        elif c.tag == "hr":
            flush()
        elif c is not e and is_menu(c):
            flush()
        else:
            block = c.tag in BLOCKS or c.tag == "#root"
            if block:
                flush()
                todo.append(None)
            todo += reversed(c.children)
    flush()
    return out


def article_of(html: str) -> str:
    elements = prune(parsed(html))
    if not elements[0].words:
        return ""
    return "\n".join(line for e in container(elements) for line in lines(e))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: the id, url, text and n_chars (its code points).

    Null and empty pages, and pages with nothing but menus and the like, give an
    empty text.  A page without paragraphs gives what is left of it.  Tags may be
    left open, and a page may end anywhere.  Rows that repeat are treated alike;
    other columns are not read.  An empty table gives no rows."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article_of(html or "") for html, in values_of(batch, "_html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["_id", "_url", "text", "n_chars"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(extract, f"_id {kind}, _url string, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})
