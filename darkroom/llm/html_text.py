"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are told by tag, role, class or id and take no part; a class that only mentions such a thing ("has-sidebar", or an
element that holds the article, the page's heading or most of its text) doesn't count. The first pass decides long blocks: by link density, and by stop-word
density; blocks full of links are boilerplate at any length. Short blocks, and long ones in an article with few stop words, are
ambiguous: the second pass gives each the label of the nearest decided block in its scope (inside or outside the article), and a tie
goes to text inside an article and to boilerplate outside one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.runtime import ship

SHORT = 70
MAX_LINKS = 0.33
MIN_STOPWORDS = 0.2

#: Fixed word list: frequent function words of English, French, German and Spanish.
STOPWORDS = frozenset(
    "a and are as at be by for from has he in is it not of on or that the this to was were will with you "
    "au aux avec ce dans de des du elle en est et il la le les ne pas par pour que qui se sur un une "
    "als auf aus das dem den der des die ein eine es für im ist mit nicht sich sie und von wie zu zum "
    "al con del el ella en es la las lo los más no o para pero por que se si su sus un una y".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text isn't article text, wherever they stand.
APART = frozenset("aside audio button canvas dialog fieldset footer form head label menu nav object option select title video".split())
#: Elements that are skipped up to their own end tag, and those that run to the page's end without one.
SKIPPED = frozenset("script style textarea template iframe noscript svg math".split())
ENDLESS = frozenset("script style textarea template".split())
#: Elements that end where another of their kind, or (p) any block, begins.
SELF_ENDING = frozenset(["p", "li", "dt", "dd", "option", *HEADINGS])
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that mark a class or id as boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising adbox adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promoted promotion recommended related replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "toolbar widget".split()
)
#: Words that say of a class that it is about something else than the element itself.
MODIFIERS = frozenset("no not non has have with without is hide hidden show disable disabled enable enabled".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^'\"<>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
_ENDS = {t: re.compile(f"</{t}\\s*>", re.I) for t in SKIPPED}


def marks(attributes: str) -> int:
    """Whether a role, class or id says boilerplate: 2 if one of its names consists of marks, 1 if a name holds one, else 0."""
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "role":
            found = max(found, 2 * (value.lower() in ROLES))
            continue
        for token in value.split():
            parts = {p.lower() for p in PART.findall(token)}
            if parts & MARKS and not parts & MODIFIERS:
                found = max(found, 2 if parts <= MARKS else 1)
    return found


class Elements:
    """The block elements of a page in order of their start tags, and what they hold."""

    def __init__(self):
        self.parent, self.tag, self.mark, self.size, self.holds = [-1], [""], [0], [0], [False]

    def add(self, parent: int, tag: str, mark: int) -> int:
        """A new element; returns its number."""
        self.parent.append(parent)
        self.tag.append(tag)
        self.mark.append(mark)
        self.size.append(0)
        self.holds.append(tag in ("article", "main", "h1"))
        return len(self.tag) - 1

    def settle(self) -> tuple[list[bool], list[bool], list[bool]]:
        """For every element: in an article; in boilerplate; in an article's own header, where only headings belong to the article."""
        n = len(self.tag)
        for i in range(n - 1, 0, -1):
            self.size[self.parent[i]] += self.size[i]
            self.holds[self.parent[i]] |= self.holds[i]
        inside, apart, header = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            inside[i] = inside[up] or tag in ("article", "main")
            wide = self.holds[i] or 2 * self.size[i] > self.size[0]
            bad = tag in APART and not (tag == "form" and wide)
            if tag not in ("html", "body", "article", "main"):
                bad |= self.mark[i] == 2 or self.mark[i] == 1 and not wide
            own_header = inside[up] and (tag == "header" or self.mark[i] == 2) and self.holds[i] and tag not in APART
            header[i] = header[up] or own_header
            apart[i] = apart[up] or (bad or tag == "header") and not own_header
        return inside, apart, header


def blocks(html: str) -> list[tuple[str, int, bool, bool]]:
    """Blocks of a page in order: (text, characters in links, inside an article, apart).

    Texts have their character references decoded and white space made one space; blocks without text are left out. Time is linear in the page.
    """
    found: list[tuple[str, int, int, bool]] = []
    elements = Elements()
    stack: list[tuple[str, int]] = [("", 0)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    endless: set[str] = set()
    linked, links, heading = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                elements.size[stack[-1][1]] += len(text)
                found.append((text, min(linked, len(text)), stack[-1][1], heading))
            pieces.clear()
        linked = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            text = html[at : m.start()]
            pieces.append(text)
            if links:
                linked += len(" ".join(text.split()))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and tag not in endless and not (tag in ("svg", "math") and attributes.endswith("/")):
                end = _ENDS[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in ENDLESS:
                    at = len(html)
                else:
                    endless.add(tag)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            pieces.append(" ")
        mark = marks(attributes) if attributes and not closing else 0
        if tag not in BLOCKS and tag not in APART and (tag in VOID or (not opened.get(tag) if closing else not mark)):
            continue
        flush()
        if tag != "a":
            links = 0
        if tag in HEADINGS:
            heading = not closing
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not attributes.endswith("/"):
            while stack[-1][0] in SELF_ENDING and (stack[-1][0] == tag or stack[-1][0] == "p" and tag in BLOCKS or stack[-1][0] in HEADINGS and tag in HEADINGS):
                pop()
            stack.append((tag, elements.add(stack[-1][1], tag, mark)))
            opened[tag] = opened.get(tag, 0) + 1
    pieces.append(html[at:])
    flush()
    inside, apart, header = elements.settle()
    return [(text, linked, inside[e], apart[e] or header[e] and not heading) for text, linked, e, heading in found]


def main_text(html: str) -> str:
    """The main text of a page; an empty string if there is none."""
    found = blocks(html)
    has_article = any(inside and not apart for _, _, inside, apart in found)
    labels: list[bool | None] = []
    for text, linked, inside, apart in found:
        if apart:
            labels.append(False)
        elif linked > MAX_LINKS * len(text):
            labels.append(False)
        elif len(text) < SHORT:
            labels.append(False if text.startswith("©") else None)
        else:
            words = WORD.findall(text.lower())
            dense = sum(w in STOPWORDS for w in words) >= MIN_STOPWORDS * max(1, len(words))
            labels.append(True if dense else None if inside else False)
    # nearest decided blocks of the same scope; blocks told by their tags have no say
    left, right = _nearest(found, labels, range(len(found))), _nearest(found, labels, range(len(found) - 1, -1, -1))
    kept = []
    for i, (text, _, inside, _) in enumerate(found):
        if labels[i] if labels[i] is not None else _inherit(i, text, inside, has_article, labels, left[i], right[i]):
            kept.append(text)
    return "\n\n".join(kept)


def _nearest(found: list, labels: list, order: range) -> list[int | None]:
    last: dict[bool, int] = {}
    out: list[int | None] = [None] * len(found)
    for i in order:
        _, _, inside, apart = found[i]
        out[i] = last.get(inside)
        if labels[i] is not None and not apart:
            last[inside] = i
    return out


def _inherit(i: int, text: str, inside: bool, has_article: bool, labels: list, left: int | None, right: int | None) -> bool:
    if left is None and right is None:
        return inside or not has_article and any(w in STOPWORDS for w in WORD.findall(text.lower()))
    if left is None or right is None:
        return labels[right if left is None else left]
    if labels[left] == labels[right] or i - left != right - i:
        return labels[left] if i - left <= right - i else labels[right]
    return inside


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null or empty html, and pages without main text, give an empty text. Null or repeated page_id rows are pages of their
    own. An empty table gives an empty table; other columns are ignored. Pages are taken whole; nothing is shuffled.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
