"""Main-text extraction with a tree-structured graphical model over DOM nodes.

Each element with text below it is a node with a hidden label, content or not.
Unary potentials are log odds of its features: tag group, region (what the
nearest named element at or above it is by tag, class, id or role), link
density, text length, sentence marks.  Parent-child potentials are log odds of
the two labels for each region of the child.
Sum-product messages go up from the leaves to the root and down again, which
gives every node's exact marginal; a block of text is kept if the marginal of
its element is at least one half.

Both potentials are trained from labelled pages: a bounded sample (``PAGES``)
of pages that mark up their article themselves (article, main, or itemprop
articleBody).  There, text is content inside that element and outside of
elements named as something else (nav, footer, aside, form, comments and so
on).  A third of those pages is read without the marks of the article, and a
third without any names, so that tags, links, lengths and sentence marks learn
to tell an article where names do not.  Counts of labels by feature and by
parent-child kind are summed on Spark over those pages and smoothed with the
pseudo-counts in ``START``, which also stand alone where no page is marked up.

Text: character references are decoded; white space in a block becomes one
space and ends are trimmed; blocks are joined in page order by one newline.
Scripts, styles, templates, comments and hidden elements have no text; hidden
are those with an attribute hidden, with aria-hidden of true, or with a style
of display: none.  What stands outside of a body is in it all the same.
Null and empty pages, and such without content, give the empty text; broken
markup is read as far as it goes.  Repeated rows get equal texts, empty tables
empty results; further columns go along, columns named like the result's
(text, n_chars) are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drawn

PAGES = 2_000
#: The sample counts as at most so many pages beside the pseudo-counts, as it may come from few site designs.
WEIGHT = 200.0
#: How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select option button datalist object canvas".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr "
                   "math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
                   "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 "
                     "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPE = frozenset("html body table ul ol dl menu div article section main aside nav header footer form blockquote".split())
#: Words in tag names, classes, ids and roles that name what is not the article, and what is.
OTHER = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer foot colophon copyright sidebar aside "
                  "widget complementary notice cookie cookies consent gdpr alert ad ads advert adverts advertisement sponsor sponsored "
                  "promo promotion form search login signup subscribe newsletter comment comments reply replies discussion disqus "
                  "respond reader share sharing social related recommended popular pagination pager toolbar popup modal overlay "
                  "contentinfo tags meta byline skip".split())
MAIN = frozenset("article main content post story entry articlebody body text prose".split())
ARTICLE = frozenset(("article", "main"))
CUE = re.compile(r"[a-z]+")
WITH = re.compile(r"(?:with|has|no)[-_][a-z]+")  # a page with a sidebar is not one
#: A quote opens a value only after the equals sign; one that never closes is part of an unquoted value.
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^ \t\n\r\f>]*+"
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)"
                 rf"((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:{VALUE}))?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+({VALUE}))?+", re.S)
MAY_HIDE = re.compile("hidden|style", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


def named(attributes: str) -> list[tuple[str, str]]:
    """The names, in lower case, and values of a tag's attributes; a bare one has the empty value."""
    bare = lambda v: v[1:-1] if len(v) > 1 and v[0] in "\"'" and v[-1] == v[0] else v
    return [(name.lower(), bare(value)) for name, value in ATTRIBUTE.findall(attributes)]


class Node:
    __slots__ = ("tag", "parent", "kids", "other", "main", "marked", "region", "own", "linked", "text", "depth", "marginal", "stops", "holds")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        cues: set[str] = set()
        if attributes:
            for name, value in named(attributes):
                if name in ("class", "id", "role", "itemprop"):
                    cues.update(CUE.findall(WITH.sub("", value.lower())))
        self.tag, self.parent, self.kids = tag, parent, []
        self.other = tag in OTHER or (tag != "body" and not OTHER.isdisjoint(cues))
        self.marked = tag in ARTICLE or "articlebody" in cues
        self.main = self.marked or not MAIN.isdisjoint(cues)
        self.own = self.linked = self.text = self.stops = 0
        self.region, self.marginal, self.holds = "plain", 0.0, False
        self.depth = parent.depth + 1 if parent else 0


def _unshown(style: str) -> bool:
    """Whether the declaration of display that holds (an important one, else the last) is none."""
    held = ("", False)
    for part in COMMENT.sub("", entities.unescape(style)).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, rest = value.partition("!")
        important = bool(mark) and rest.strip() == "important"
        if name.strip() == "display" and important >= held[1]:
            held = (value.strip(), important)
    return held[0] == "none"


def _hidden(attributes: str) -> bool:
    """By an attribute hidden, aria-hidden that is true, or a style of display: none; of one name the first counts."""
    if not MAY_HIDE.search(attributes):
        return False
    of: dict[str, str] = {}
    for name, value in named(attributes):
        of.setdefault(name, value)
    return "hidden" in of or of.get("aria-hidden", "").strip().lower() == "true" or _unshown(of.get("style", ""))


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The elements in page order (a parent before its children), and the blocks of text with their element."""
    root = Node("html", None)
    nodes, at = [root], root
    body: Node | None = None
    blocks: list[tuple[Node, str]] = []
    parts: list[str] = []
    links = 0  # depth of open <a>
    skip, skipped = "", 0
    pos, end = 0, len(page)
    opened: Counter = Counter()  # open elements by tag, and by tag within their scope: walks up end where they must
    scopes = [root]

    def enter(x: Node) -> None:
        nonlocal at
        at = x
        opened[x.tag] += 1
        opened[id(scopes[-1]), x.tag] += 1
        if x.tag in SCOPE:
            scopes.append(x)

    def leave(to: Node) -> None:
        nonlocal at
        while at is not to:
            if at.tag in SCOPE:
                scopes.pop()
            opened[at.tag] -= 1
            opened[id(scopes[-1]), at.tag] -= 1
            at = at.parent

    def home(attributes: str = "") -> Node:
        """The body, which pages may leave out or close too early."""
        nonlocal body
        if body is None:
            root.kids.append(body := Node("body", root, attributes))
            nodes.append(body)
        return body

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                if at is root:
                    enter(home())
                blocks.append((at, text))
                at.own += len(text)
                at.stops += sum(map(text.count, ".!?…。"))

    while pos < end:
        lt = page.find("<", pos)
        lt = end if lt < 0 else lt
        if lt > pos and not skip:
            text = entities.unescape(page[pos:lt])
            parts.append(text)
            if links:
                at.linked += len(text.strip())
        if lt >= end:
            break
        m = TAG.match(page, lt)
        if not m:  # a bare <
            if not skip:
                parts.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        if not m[2]:
            continue
        tag, closing, rest = m[2].lower(), bool(m[1]), m[3] or ""
        if skip:
            if tag == skip:
                skipped += -1 if closing else not rest.endswith("/")
                skip = skip if skipped else ""
            continue
        if not closing and tag not in VOID and (tag in RAW or (rest and tag not in ("html", "body") and _hidden(rest))):
            if rest.endswith("/") and tag not in RAW_TEXT:
                continue
            if tag not in INLINE and tag not in ("button", "select", "svg"):
                flush()
            if tag in RAW_TEXT:  # no markup inside
                close = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\r\f/>])", re.I).search(page, pos)
                pos = TAG.match(page, close.start()).end() if close else end
            else:
                skip, skipped = tag, 1
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        if tag in INLINE or tag in ("br", "img", "input"):
            continue
        flush()
        if closing:
            if opened[tag] > 0:
                x = at
                while x.tag != tag:
                    x = x.parent
                leave(x.parent)
                links = 0
            continue
        if tag in ("html", "head", "hr") or tag in VOID:
            continue
        if tag == "body" or at is root:
            new = body is None
            inside = home(rest if tag == "body" else "")
            if at is root:
                enter(inside)
            if tag == "body":
                links = 0 if new else links
                continue
        if tag in CLOSES_P and at.tag == "p":
            leave(at.parent)
        shut = ITEMS.get(tag, ())
        x, left = at, sum(opened[id(scopes[-1]), t] for t in shut)
        while left > 0:  # up to the outermost in this scope that it closes
            left -= x.tag in shut
            x = x.parent
        if x is not at and shut:
            leave(x)
        links = 0
        at.kids.append(node := Node(tag, at, rest))
        nodes.append(node)
        enter(node)
    flush()
    for x in reversed(nodes):  # what holds a marked article is not a side part, whatever its name
        x.holds = x.holds or x.marked
        if x.parent and x.holds:
            x.parent.other, x.parent.holds = False, True
    set_regions(nodes)
    for x in reversed(nodes):
        x.text += x.own
        if x.parent:
            x.parent.text += x.text
            x.parent.linked += x.linked
            x.parent.stops += x.stops
    return nodes, blocks


def set_regions(nodes: list[Node], hide: str = "") -> None:
    """What the nearest named element at or above each node is; hiding "marks" passes over the article's own, "names" over all."""
    for x in nodes:
        above = x.parent.region if x.parent else "plain"
        marked = x.marked and not hide
        x.region = ("plain" if hide == "names" else "main" if marked else "other" if x.other or above == "other"
                    else "main" if x.main and not x.marked else above)


def features(x: Node) -> list[str]:
    size = x.text
    tag = ("p" if x.tag in ("p", "pre", "blockquote") else "h" if re.fullmatch("h[1-6]", x.tag) else "list" if x.tag in ("ul", "ol", "li", "dl", "dd", "dt")
           else "table" if x.tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else "box")
    links = x.linked / size if size else 0.0
    return ["tag=" + tag, x.region,
            "links=" + ("none" if links < 0.05 else "some" if links < 0.5 else "most"),
            "size=" + str(min(4, int(math.log10(size + 1) * 1.5)) if tag != "h" else "h"),
            "stops=" + str(min(2, x.stops) if tag != "h" else "h")]


def truth(nodes: list[Node]) -> dict[int, bool] | None:
    """The labels of a page that marks up its article itself."""
    label: dict[int, bool] = {}
    found = False
    for x in nodes:
        inside = label.get(id(x.parent), False)
        found |= x.marked
        label[id(x)] = (inside or x.marked) and not (x.other and not x.marked)
    return label if found else None


#: Pseudo-counts (content, not content) of the features, and of (child's kind, parent's label, child's label).
START = {"tag=p": (6, 3), "tag=h": (3, 3), "tag=list": (2, 4), "tag=table": (2, 2), "tag=box": (3, 3),
         "other": (1, 900), "main": (60, 1), "plain": (10, 10), "links=none": (8, 4), "links=some": (4, 4), "links=most": (1, 12),
         "size=0": (2, 4), "size=1": (3, 5), "size=2": (4, 4), "size=3": (6, 3), "size=4": (6, 2), "size=h": (3, 3),
         "stops=0": (3, 6), "stops=1": (5, 3), "stops=2": (6, 2), "stops=h": (3, 3),
         ("plain", 1, 1): 40, ("plain", 1, 0): 2, ("plain", 0, 0): 40, ("plain", 0, 1): 3,
         ("main", 1, 1): 60, ("main", 1, 0): 1, ("main", 0, 0): 6, ("main", 0, 1): 12,
         ("other", 1, 1): 1, ("other", 1, 0): 60, ("other", 0, 0): 900, ("other", 0, 1): 1}


def hidden_part(page: str) -> str:
    """What a page of the sample hides, to teach what an article is like where less tells it: nothing, its marks, or all names."""
    return ("", "marks", "names")[zlib.crc32(page.encode("utf-8", "replace")) % 3]


def page_counts(page: str | None) -> Counter:
    nodes, _ = parse(page or "")
    label = truth(nodes)
    seen: Counter = Counter()
    if label:
        set_regions(nodes, hidden_part(page))
    for x in nodes if label else ():
        if not x.text or not x.parent:
            continue
        y = int(label[id(x)])
        for f in features(x):
            seen[f"f {f} {y}"] += 1
        seen[f"e {x.region} {int(label.get(id(x.parent), False))} {y}"] += 1
    return seen


class Model:
    """Log potentials from counts; a node's evidence is damped, as its features overlap."""

    def __init__(self, counts: dict[str, float], pages: int):
        scale = WEIGHT / max(WEIGHT, pages)  # the sample weighs as much as so many pages
        self.unary, self.edge = {}, {}
        total = [0.0, 0.0]
        names = [f for f in START if isinstance(f, str)]
        both = {f: [START[f][1 - y] + scale * counts.get(f"f {f} {y}", 0) for y in (0, 1)] for f in names}
        for group in ("tag=", "links=", "size=", "stops=", ""):
            members = [f for f in names if (f.startswith(group) if group else "=" not in f)]
            total = [sum(both[f][y] for f in members) for y in (0, 1)]
            for f in members:
                self.unary[f] = math.log(both[f][1] / total[1]) - math.log(both[f][0] / total[0])
        for k in ("plain", "main", "other"):
            for up in (0, 1):
                n = [START[(k, up, y)] + scale * counts.get(f"e {k} {up} {y}", 0) for y in (0, 1)]
                self.edge[(k, up)] = (math.log(n[0] / sum(n)), math.log(n[1] / sum(n)))

    def marginals(self, nodes: list[Node]) -> None:
        """Sum-product: messages to the parents from the last node back, then down in page order."""
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        belief = {id(x): [0.0, 0.6 * sum(self.unary[f] for f in features(x)) if x.parent and x.text else 0.0] for x in nodes}
        sent = {}
        for x in reversed(nodes):
            if x.parent is None or not x.text:
                continue
            (b0, b1) = belief[id(x)]
            up = [add(self.edge[(x.region, y)][0] + b0, self.edge[(x.region, y)][1] + b1) for y in (0, 1)]
            sent[id(x)] = up
            p = belief[id(x.parent)]
            p[0] += up[0]
            p[1] += up[1]
        for x in nodes:
            b = belief[id(x)]
            if x.parent is None:
                b[1] -= 30.0  # the page as a whole is not the article
            elif x.text:
                k, p, up = x.region, belief[id(x.parent)], sent[id(x)]
                cavity = (p[0] - up[0], p[1] - up[1])
                for y in (0, 1):
                    b[y] += add(cavity[0] + self.edge[(k, 0)][y], cavity[1] + self.edge[(k, 1)][y])
            top = max(b)
            x.marginal = math.exp(b[1] - top) / (math.exp(b[0] - top) + math.exp(b[1] - top))

    def extract(self, page: str | None, hide: str = "") -> str:
        """The main text; ``hide`` reads the page without its marks or names, to measure what was learned."""
        nodes, blocks = parse(page or "")
        if hide:
            set_regions(nodes, hide)
        self.marginals(nodes)
        return "\n".join(text for node, text in blocks if node.marginal >= 0.5)


def fit(pages: DataFrame, html_col: str = "html", limit: int = PAGES) -> Model:
    """Trains the potentials from pages that mark up their article, at most about ``limit`` of them."""
    sample = drawn(pages.select(F.col(html_col).alias("html")), F.xxhash64("html"), pages.count(), limit)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            all_of, labelled = Counter(), 0
            for page in b["html"]:
                seen = page_counts(page)
                all_of.update(seen)
                labelled += bool(seen)
            yield pd.DataFrame([*all_of.items(), ("pages", labelled)], columns=["name", "n"])

    sums = sample.mapInPandas(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()
    counts = {r["name"]: float(r["n"]) for r in sums}
    return Model(counts, int(counts.pop("pages", 0)))


def extract(df: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """Every row with its main text and the number of its code points."""
    cols = [c for c in df.columns if c not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([model.extract(p) for p in pages], dtype=object)
    out = df.withColumn("__tx_text", run(F.col(html_col)))
    return out.select(*cols, F.col("__tx_text").alias("text"), F.length("__tx_text").cast("long").alias("n_chars"))
