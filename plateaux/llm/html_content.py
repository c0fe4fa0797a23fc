"""Main text of HTML pages as the maximum-scoring contiguous region of words and tags.

A page becomes a row of tokens: words score positive or negative by what they stand in, tags negative, and one linear scan
finds the contiguous run with the highest sum. What a block counts is learned from labelled pages, which are those whose
markup itself names its content by exactly one ``article`` or ``main`` element: naive Bayes over the block's features (its
tag, how much of it is link, its length, the landmark element it stands in, and the words of class, id and role of the
elements round it), with the shares inside and outside the labelled content; a tag's weight is the share that lies outside.
At most ``SAMPLE`` labelled pages, the first by a hash, are counted.

Names are evidence, not a rule: fixed priors for what they usually mean are a few pseudo-counts that the labelled pages
outvote. A name that is only part of a compound (entry-header) counts half, one that a compound denies or merely mentions
(no-comments, with-sidebar) not at all, nor does one on an element that holds a heading of the first rank, an article or
main element, or most of the page's words, as such names describe a page and not a part. Landmarks (nav, aside, footer,
form; header outside the content) count most. Within the region, blocks that score negative give no text: adverts, forms
and menus stand in articles too.

Text: character references decoded, white space in a block to one space, blocks joined by a line feed. A line break
element is white space inside its block. Scripts, styles and other elements without text of their own are dropped. Captions,
formulas, labels and buttons are text as any other. Unclosed and crossed tags are borne; an unclosed quote ends at the
next > from there on, so that every page takes time in proportion to its length, and very long pages are read whole.

Nulls: a null or empty html, or one without text, gives the empty string. A null page_id or url is returned as it is.
Repeated rows are judged each on its own. Of regions with equal sums the first counts. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE = 2000

# Element names, and the words of class, id and role that mostly name what is not main text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "audio", "video")
LANDMARKS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
AWAY = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "disclaimer", "sidebar", "side",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "search", "searchbox", "widget", "widgets", "pagination", "pager", "toolbar", "skip", "complementary",
    "contentinfo", "copyright",
}
DENIED = {"no", "not", "has", "with", "without", "is", "show", "hide", "open", "closed", "layout", "page", "site", "theme", "post", "template"}
_OPEN_ENDED = {"p", "li", "td", "th", "tr", "dd", "dt", "option"}
#: Pseudo-counts of blocks outside the content, of 1 inside, for landmarks and for names given whole and in part.
PRIOR_LANDMARK, PRIOR_NAME, PRIOR_PART = 60.0, 12.0, 3.0

_ATTRIBUTES = re.compile(r"""((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_PLAIN = re.compile(r"([^>]*+)>")
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*+>?", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")


def tokens(page: str):
    """(text, tag, closing, attributes) along the page; the text stands before the tag, which is None at the end."""
    at, plain, n = 0, False, len(page)
    text_from = 0
    while at < n:
        m = _OPEN.search(page, at)
        if not m:
            break
        if m[1]:
            end = page.find("-->", m.end())
            yield page[text_from:m.start()], "!", False, ""
            at = text_from = n if end < 0 else end + 3
            continue
        if m[2]:
            end = page.find(">", m.end())
            yield page[text_from:m.start()], "!", False, ""
            at = text_from = n if end < 0 else end + 1
            continue
        found = (_PLAIN if plain else _ATTRIBUTES).match(page, m.end())
        if not found and not plain:
            plain = True  # from here on quotes mean nothing, so that no end of the page is looked for twice
            found = _PLAIN.match(page, m.end())
        if not found:
            break
        name, closing = m[4].lower(), bool(m[3])
        yield page[text_from:m.start()], name, closing, found[1]
        at = text_from = found.end()
        if name in _CLOSE and not closing and not found[1].rstrip().endswith("/"):
            end = _CLOSE[name].search(page, at)
            at = text_from = end.end() if end else n
    yield page[text_from:], None, False, ""


def names_of(attributes: str) -> list[tuple[str, bool]]:
    """The words that name an element, each with whether it is a whole name."""
    out = []
    for m in _NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = _PART.findall(_HUMP.sub(r"\1 \2", token).lower())
            if len(words) == 1:
                out.append((words[0], True))
            elif not DENIED & set(words):
                out += [(w, False) for w in words]
    return out


class Element:
    __slots__ = ("name", "names", "parent", "landmark", "inside", "words", "page_like", "known")

    def __init__(self, name: str, names, parent: Element | None, inside: bool):
        self.name, self.names, self.parent, self.inside = name, names, parent, inside
        self.words, self.page_like = 0, name in ("html", "body", "article", "main")
        self.known: frozenset[str] = frozenset()  # names of this element and those round it, set once by _spread
        self.landmark = parent.landmark if parent else ""
        if name in LANDMARKS and not (name == "header" and inside):
            self.landmark = name


class Block:
    __slots__ = ("tag", "element", "link", "parts", "before", "text", "n")

    def __init__(self, tag: str, element: Element, before: list[str]):
        self.tag, self.element, self.before = tag, element, before
        self.link, self.parts, self.text, self.n = 0, [], "", 0


def blocks_of(page: str) -> tuple[list[Block], list[str], int]:
    """Blocks with text in page order (with the tags since the block before), the tags after the last, and how many
    elements name the content."""
    root = Element("html", [], None, False)
    out: list[Block] = []
    tags: list[str] = []
    stack = [root]
    elements = [root]
    depth: Counter = Counter()
    named = anchor = 0
    block = Block("body", root, tags)

    def cut(tag: str) -> None:
        nonlocal block, tags
        words = entities.unescape("".join(block.parts)).split()
        if words:
            block.text, block.n = " ".join(words), len(words)
            block.element.words += block.n
            out.append(block)
            tags = []
        block = Block(tag, stack[-1], tags)

    def enter(element: Element) -> None:
        stack.append(element)
        elements.append(element)
        depth[element.name] += 1

    def close(k: int) -> None:
        for e in stack[k:]:
            depth[e.name] -= 1
        del stack[k:]

    for text, name, closing, attributes in tokens(page):
        if text:
            block.parts.append(text)
            if anchor:
                block.link += len(text.split())
        if name is None or name == "!":
            continue
        if closing:
            tags.append("/" + name)
            if name == "a":
                anchor = max(0, anchor - 1)
            if name in BLOCKS:
                cut("body")
            if depth[name] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            if name in BLOCKS:
                block.element = stack[-1]
                block.tag = stack[-1].name
            continue
        tags.append(name)
        if name == "br":
            block.parts.append(" ")
        if name == "a":
            anchor += 1
        if name in RAW:
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            if name == "hr":
                cut("body")
            continue
        if name not in BLOCKS:
            names = names_of(attributes) if "=" in attributes else []
            if names:
                enter(Element(name, names, stack[-1], stack[-1].inside))
                if not block.parts:
                    block.element = stack[-1]
            continue
        if name in _OPEN_ENDED and stack[-1].name == name:  # the one before ends here
            cut("body")
            close(len(stack) - 1)
        inside = stack[-1].inside
        if name in ("article", "main"):
            named += not inside
            inside = True
        cut(name)
        enter(Element(name, names_of(attributes), stack[-1], inside))
        if name == "h1" or name in ("article", "main"):
            e: Element | None = stack[-1].parent
            while e and not e.page_like:
                e.page_like, e = True, e.parent
        block.element = stack[-1]
    cut("body")
    _spread(out, elements)
    return out, tags, named


def _spread(blocks: list[Block], elements: list[Element]) -> None:
    """Words are counted up to the root; elements with most of the page's words are no parts of it; names are handed down.

    Parents come before their children, so two passes over the elements do it, whatever the depth.
    """
    for e in reversed(elements):
        if e.parent:
            e.parent.words += e.words
    most = 0.6 * sum(b.n for b in blocks)
    for e in elements:
        e.page_like = e.page_like or e.words > most
        e.known = e.parent.known if e.parent else frozenset()
        if not e.page_like and e.names:
            own = frozenset(("name " if whole else "part ") + w for w, whole in e.names if w in AWAY)
            e.known = e.known | own if own - e.known else e.known


def features(block: Block) -> list[str]:
    """What is known of a block's words, from its tag to the names round it."""
    tag = block.tag if block.tag in ("p", "li", "td", "div", "article", "section", "main", "body", "blockquote", "pre", "figcaption") else "heading" if block.tag in HEADINGS else "other"
    out = [f"kind {tag} {'link' if 2 * block.link > block.n else 'text'} {'short' if block.n < 6 else 'middle' if block.n < 20 else 'long'}", "in " + (block.element.landmark or "none")]
    return out + sorted(block.element.known)


def counts_of(page: str) -> Counter:
    """Blocks' features and tags inside and outside the labelled content, or nothing for an unlabelled page."""
    blocks, tail, named = blocks_of(page)
    out: Counter = Counter()
    if named != 1:
        return out
    inside = False
    for block in blocks:
        for f in features(block):
            out[f, block.element.inside] += block.n if f.startswith("kind ") else 1
        for tag in block.before:
            inside = True if tag in ("article", "main") else False if tag in ("/article", "/main") else inside
            out["tag " + tag, inside or tag in ("/article", "/main")] += 1
    for tag in tail:
        inside = inside and tag not in ("/article", "/main")
        out["tag " + tag, inside] += 1
    return out


class Weights:
    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.counts = counts
        self.odds: dict[str, float] = {}

    def _prior(self, feature: str) -> tuple[float, float]:
        kind, name = feature.split(" ", 1)
        if kind == "in" and name != "none":
            return 1, PRIOR_LANDMARK
        return (1, PRIOR_NAME) if kind == "name" else (1, PRIOR_PART) if kind == "part" else (2, 1) if kind == "kind" else (1, 1)

    def of(self, feature: str) -> float:
        """Log odds that what has this feature lies inside the content."""
        if feature not in self.odds:
            inside, outside = self._prior(feature)
            inside, outside = inside + self.counts.get((feature, True), 0), outside + self.counts.get((feature, False), 0)
            cap = {"kind": 1.5, "in": 6.0, "name": 4.0, "part": 1.2}[feature.split(" ", 1)[0]]
            self.odds[feature] = max(-cap, min(cap, math.log(inside / outside)))
        return self.odds[feature]

    def word(self, block: Block) -> float:
        """What each word of a block counts, from -1 to 1."""
        kind, landmark, *names = features(block)
        x = max(-0.7, self.of(kind)) + min(0.0, self.of(landmark)) + sum(min(0.0, self.of(f)) for f in names) + 0.8
        return math.tanh(x / 2)

    def tag(self, name: str) -> float:
        inside, outside = self.counts.get(("tag " + name, True), 0) + 1, self.counts.get(("tag " + name, False), 0) + 1
        return -0.02 - 0.4 * outside / (inside + outside)


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """The first run of blocks (from, to) with the highest sum of what precedes each but the first and what each counts."""
    best, region, total, start = 0.0, (0, -1), 0.0, 0
    for k, (before, own) in enumerate(scores):
        if total + before <= 0:
            total, start = 0.0, k
        else:
            total += before
        total += own
        if total > best:
            best, region = total, (start, k)
    return region


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best contiguous region; a block's words weigh alike, so regions begin and end at blocks."""
    if not page:
        return ""
    blocks, _, _ = blocks_of(page)
    words = [weights.word(b) for b in blocks]
    low, high = best_region([(sum(map(weights.tag, b.before)), b.n * w) for b, w in zip(blocks, words, strict=True)])
    return "\n".join(b.text for b, w in zip(blocks[low:high + 1], words[low:high + 1], strict=True) if w > 0)


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    key = F.xxhash64("page_id", "html")
    labelled = pages.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    picked = labelled.select(key.alias("key")).orderBy("key").limit(sample).distinct()  # keys alone, never pages, are sorted
    drawn = labelled.select(key.alias("key"), F.col("html").cast("string").alias("html")).join(F.broadcast(picked), "key")
    each = drawn.groupBy("key").agg(F.min("html").alias("html")).select("html")

    def run(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total.update(counts_of(page))
        rows = [{"kind": k, "inside": inside, "n": n} for (k, inside), n in total.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    tags = ", ".join(repr(t) for t in sorted(BLOCKS | VOID | LANDMARKS | set(RAW) | {"a", "b", "i", "span", "em", "strong", "u", "small", "font", "code", "button", "label"}))
    known = ~F.col("kind").startswith("tag ") | F.expr(f"regexp_replace(kind, '^tag /?', '') in ({tags})")
    found = each.mapInArrow(run, "kind string, inside boolean, n long").where(known).groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r["kind"], r["inside"]): r["n"] for r in found.collect()})  # a fixed set of features


def extract_main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(learn(pages, sample).counts)

    def run(batches):
        import pyarrow as pa

        weights = Weights(shared.value)
        for b in batches:
            found = [main_text(p, weights) for p in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
