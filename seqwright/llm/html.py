"""Main text of web pages by consensus of each host's pages.

Every page is parsed by itself and its containers are scored: a block of text
gives its characters, less twice those in links, to the container it stands in,
half of them to the next one and a third to the one after. What is boilerplate
by tag, role or class gives nothing. The best container's generalised path (tags
and classes, digits as ``#``) is the page's vote; votes are counted by host in
Spark, and each page is parsed again with the path that won: its text is that of
all containers on this path, or of the page's own best one if the page has no
text there.

Pages are parsed as browsers do as far as text needs it: comments, raw text
elements, attributes in quotes, implied ends of p, li, dt, dd, options and table
parts, end tags without a start. Character references are decoded as HTML 5
says, a reference without an end stays. White space is what ``str.split`` splits
at; ``<br>`` counts as white space. Headings inside the ``header`` of an article
are text, the rest of that header is not.

Null and empty html, and pages without text, give an empty text. A null url or
one without a host has no vote and no consensus, so such a page takes its own
best container. Repeated rows are extracted, and vote, each by itself; ties of
votes go to the path of the higher score, then to the least path. Very long
pages are handled whole, one at a time. Empty tables give empty results. Further
columns play no part.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm.common import chosen, table
from seqwright.scratch import written

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that stand in a line of text and end no block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never part of the main text.
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas math button select textarea dialog menu head title audio video map xmp noembed noframes datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tooltip".split())
#: Words of a class or id that mark boilerplate.
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads adbox advert adverts advertisement advertising banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations comment comments disqus replies respond responses discussion widget widgets toolbar pagination pager copyright disclaimer skip hidden".split()
)
#: Words that turn the next word of a class round, as in "no-sidebar".
NEGATED = frozenset("no not without with has non".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that class words leave alone: those that hold a page or its article.
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
#: An open element of the first kind ends when one of the second starts, unless one of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: A p stays open across these.
P_SCOPE = frozenset("td th caption table button object".split())

_TAG = re.compile(r"""<(?:!--(?s:.*?)(?:--!?>|\Z)|(?:!|\?)[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))|/[^a-zA-Z][^>]*(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


@dataclass(slots=True)
class Element:
    """An open or closed element; place is its index, up its parent's. label is its step of the path, key a hash of all steps down to it."""

    tag: str
    place: int
    up: int
    label: str = ""
    key: int = 0
    dropped: bool = False
    headings_only: bool = False
    in_article: bool = False
    in_link: bool = False
    in_heading: bool = False
    score: float = 0.0


@dataclass(slots=True)
class Page:
    """Elements in page order and blocks of kept text as (element place, text, characters in links, is heading)."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)


def boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is boilerplate by its tag, role, class, id or because it is hidden."""
    if tag in DROPPED or attributes.get("role", "").lower() in DROPPED_ROLES or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if tag in KEPT:
        return False
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    for name in (*attributes.get("class", "").split(), *attributes.get("id", "").split()):
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in DROPPED_WORDS and (k == 0 or words[k - 1] not in NEGATED) for k, w in enumerate(words)):
            return True
    return False


def parse(text: str) -> Page:
    """Elements and blocks of a page."""
    page = Page([Element("", 0, -1)])
    elements, stack = page.elements, [0]
    parts: list[str] = []
    linked = 0

    def block_end() -> None:
        """The text so far is a block of the innermost open element that is not inline."""
        nonlocal linked
        if parts:
            found = " ".join("".join(parts).split())
            if found:
                at = next(k for k in reversed(stack) if elements[k].tag not in INLINE)
                page.blocks.append((at, found, linked, elements[at].tag in HEADINGS))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        """Close all elements from the given place in the stack on."""
        if any(elements[k].tag not in INLINE for k in stack[depth:]):
            block_end()
        del stack[depth:]

    def said(raw: str) -> None:
        nonlocal linked
        top = elements[stack[-1]]
        if not top.dropped and (top.in_heading or not top.headings_only):
            raw = references.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if top.in_link:
                linked += len(raw)

    at = 0
    while at < len(text):
        found = _TAG.search(text, at)
        if not found:
            said(text[at:])
            break
        if found.start() > at:
            said(text[at : found.start()])
        at, name = found.end(), found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            if tag == "br":
                parts.append(" ")
                continue
            for depth in range(len(stack) - 1, 0, -1):
                own = elements[stack[depth]].tag
                if own == tag:
                    close(depth)
                    break
                if tag in INLINE and own not in INLINE:
                    break
            else:
                if tag not in INLINE:
                    block_end()
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                block_end()
            continue
        if tag not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):
                own = elements[stack[depth]].tag
                if own == "p":
                    close(depth)
                    break
                if own in P_SCOPE:
                    break
            ends, barrier = IMPLIED.get(tag, (None, None))
            if ends:
                least = None
                for depth in range(len(stack) - 1, 0, -1):
                    own = elements[stack[depth]].tag
                    if own in ends:
                        least = depth
                    elif own in barrier:
                        break
                if least:
                    close(least)
            block_end()
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(found[3])} if len(found[3]) > 1 else {}
        up = elements[stack[-1]]
        dropped = up.dropped or boilerplate(tag, attributes) or (len(found[3]) > 1 and re.search(r"(?i)(?:^|\s)hidden(?=[\s/>]|$)", _ATTRIBUTE.sub("", found[3])) is not None)
        only = up.headings_only
        if tag == "header" or "header" in attributes.get("class", "").lower().split():
            dropped, only = dropped or not up.in_article, True
        label, key = "", up.key
        if tag not in INLINE and tag not in ("html", "body"):
            label = tag + "".join(f".{re.sub('[0-9]+', '#', c)}" for c in sorted(attributes.get("class", "").replace("/", "_").split()))
            key = hash((key, label))
        article, link, heading = up.in_article or tag in ("article", "main") or attributes.get("role") == "main", up.in_link or tag == "a", up.in_heading or tag in HEADINGS
        elements.append(Element(tag, len(elements), up.place, label, key, dropped, only, article, link, heading))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
        else:
            stack.append(len(elements) - 1)
    close(1)
    block_end()
    return page


def path_of(page: Page, e: Element) -> str:
    """The generalised path of an element: the labels from the top down, each after a slash."""
    steps = []
    while e.up >= 0:
        if e.label:
            steps.append(e.label)
        e = page.elements[e.up]
    return "".join(f"/{x}" for x in reversed(steps))


def key_of(path: str) -> int:
    """The key of the elements that have this path, in this process."""
    key = 0
    for label in path.split("/")[1:]:
        key = hash((key, label))
    return key


def best(page: Page) -> Element | None:
    """The container of the highest score, lifted to the article around it or to a container that adds its heading; None without text."""
    elements = page.elements
    for at, text, linked, _ in page.blocks:
        worth, share = len(text) - 2 * linked, 1
        if elements[at].tag in HEADINGS | {"p", "li", "pre", "blockquote", "td", "th", "dt", "dd", "figcaption"}:
            at = elements[at].up
        while at >= 0 and share <= 3:
            elements[at].score += worth / share
            at, share = elements[at].up, share + 1
    if not page.blocks:
        return None
    top = max(elements, key=lambda e: (e.score, -e.place))
    at, article = top, None
    while at.up >= 0:
        if at.tag in ("article", "main"):
            article = at
            if at.tag == "article":
                break
        at = elements[at.up]
    if article:
        return article
    up = elements[top.up] if top.up >= 0 else None
    if up and up.tag not in ("body", "html", "") and any(h and elements[k].up == up.place for k, _, _, h in page.blocks):
        return up
    return top


def text_of(page: Page, path: str | None) -> str:
    """The blocks of all containers on the path, in page order; those of the page's own best one if there are none."""
    inside: list[bool] = []
    key = key_of(path) if path else None
    for e in page.elements:
        inside.append((e.up >= 0 and inside[e.up]) or (key is not None and e.key == key and e.label != ""))
    found = [t for at, t, _, _ in page.blocks if inside[at]]
    if not found and (top := best(page)):
        for e in page.elements:
            inside[e.place] = e.place == top.place or (e.up >= 0 and inside[e.up])
        found = [t for at, t, _, _ in page.blocks if inside[at]]
    return "\n\n".join(found)


def host(url: F.Column) -> F.Column:
    """The host of a url in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: the generalised path of each page's best container."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, text in zip(batch.column(0), batch.column(1)):
                page = parse(text.as_py())
                if top := best(page):
                    rows.append((own.as_py(), path_of(page, top), float(top.score)))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["host", "path", "score"])

    rows = pages.select(host(F.col("url")).alias("host"), "html").where("host IS NOT NULL AND html <> ''")
    return rows.mapInArrow(of, "host string, path string, score double")


def winners(voted: DataFrame) -> DataFrame:
    """host, path: the path with most votes of each host."""
    counted = voted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score").cast("long")).alias("score"))
    least = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")).alias("won")
    return counted.groupBy("host").agg(least).select("host", "won.path")


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, path (the host's winning path, null without one) of every page."""
    rows = chosen(pages, page_id=page_id, url=url, html=html)
    won = written(winners(votes(rows)), "host-paths")
    joined = rows.withColumn("host", host(F.col("url"))).join(won, "host", "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(parse(x), p.as_py()) if (x := t.as_py()) else "" for t, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3)], ["page_id", "url", "text", "path"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInArrow(of, f"page_id {kind}, url string, text string, path string")


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
