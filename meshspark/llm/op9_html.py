"""HTML extraction by two-pass block rules.

A page is cut into blocks of text with their tag, the share of text inside links and whether they lie in the
article.  Elements that can't hold main text (navigation, footers, forms, scripts, adverts, comments ...) are
left out with all they hold, by tag, role or the words of class and id.  The first pass decides a block by its
stop-word density, length and link density, or leaves a short one open; in the second, open blocks take the label
that their nearest decided neighbours share, or that of the nearer one.

Both passes judge every block.  An article that a page marks is evidence: in it, few stop words leave a block open
and a moderate share of them makes a block good, and an open block is bad only between two bad ones of the article.
Where the article holds main text, a block outside it must be both long and rich in stop words to be good on its
own, and an open one is good only between two good ones; an h1 may head the article.

Stop words say nothing where their languages aren't used: in blocks mostly in other than Latin letters, and on pages
where they make up hardly any of the text.  There, length and link density decide.

A page is read once from start to end, whatever it holds: time grows with its length.

Defined results: null and empty html give an empty text; unclosed and stray tags are allowed; an unclosed comment
or script ends the page; from the first tag whose quotes don't close, tags end at the next >; after the last > all
is text; repeated rows get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Common function words of the languages of the pages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich im ist mit nach nicht nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos era esta este fue ha la las lo los más no para pero por se sin sobre su sus y ya".split()
)
SKIPPED = frozenset("head script style noscript template textarea select option button svg math canvas iframe object audio video form fieldset nav footer aside dialog menu".split())
RAW = frozenset("script style textarea noscript iframe template svg title".split())
CONTAINERS = frozenset("html body div section article main header footer nav aside form fieldset ul ol dl table figure blockquote details center menu dialog select button object svg noscript template head".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption pre hr address summary legend option title".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id that mark what is not main text; the second set also holds for the article itself.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social widget pagination pager toolbar copyright disclaimer tags author".split()
)
ALWAYS_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion comment comments commentlist disqus replies reply respond related recommended recommendations teaser".split())
MAIN_WORDS = frozenset("article content entry story post".split())
#: Names that stand for the article: one of the first words with one of the second, and nothing else.
ARTICLE_NAME = re.compile(r"(?:article|entry|post|story)[-_]*(?:body|content|text)", re.I)

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}[\s>/]", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")

#: Characters from which a block is long enough to decide, and to be good without neighbours.
SHORT, LONG = 70, 200
#: Stop-word densities from which a block may be good, and is good.
LOW, HIGH = 0.05, 0.15
#: Share of text in links beyond which a block is not main text.
LINKS = 0.5
#: Share of a page's letters in stop words below which its language is none of theirs.
FOREIGN = 0.03


@dataclass
class Block:
    text: str
    tag: str
    links: float
    main: bool


def _skips(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool]:
    """(leave the element out, it is the article, its header belongs to the text) by tag and attributes."""
    if tag in SKIPPED:
        return True, False, False
    main = tag in ("article", "main")
    if not attributes.strip():
        return tag == "header" and not in_main, main, main
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    names = found.get("class", "") + " " + found.get("id", "")
    tokens = {t.lower() for t in TOKEN.findall(names)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    if role in ROLES or hidden or tokens & ALWAYS_WORDS:
        return True, False, False
    main = main or role == "main" or "articlebody" in found.get("itemprop", "").lower()
    if tag in ("body", "html"):
        return False, False, False
    if main:
        return False, True, True
    if tokens & ASIDE_WORDS or tag == "header" and not in_main:
        return True, False, False
    inner = bool(tokens & MAIN_WORDS) and tag in ("div", "section")
    return False, inner and any(ARTICLE_NAME.fullmatch(n) for n in names.split()), inner


class Tags:
    """The tags of a page in order: next(at) gives (start, end, closing, name, attributes) of the first at or after
    ``at``, with an empty name for comments and the like, or None."""

    def __init__(self, html: str) -> None:
        self.html, self.right, self.quotes = html, -1, True

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, len(html) if end < 0 else end + 3, False, "", ""
            if self.right < at and (found := html.find(">", at)) >= 0:
                self.right = found
            if self.right < at:
                return None
            if m := NAME.match(html, at):
                end = self._end(m.end())
                return at, end + 1, bool(m[1]), m[2].lower(), html[m.end() : end]
            if html[at + 1 : at + 2] in ("!", "?", "/"):
                return at, self.right + 1, False, "", ""
            at += 1
        return None

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes start at ``at``."""
        if self.quotes:
            p = at
            while m := STOP.search(self.html, p):
                if m[0] == ">":
                    return m.start()
                if (p := self.html.find(m[0], m.end()) + 1) == 0:
                    break
            self.quotes = False
        return self.right


class Open:
    """The open elements of a page, with the places of each tag, of articles and of elements that are left out."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, left out, article, keeps headers
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.skips: list[int] = []
        self.main = self.inner = 0

    def push(self, tag: str, left_out: bool, article: bool, heads: bool) -> None:
        i = len(self.stack)
        self.stack.append((tag, left_out, article, heads))
        self.places.setdefault(tag, []).append(i)
        if tag in ("article", "main"):
            self.walls.append(i)
        if left_out:
            self.skips.append(i)
        self.main += article
        self.inner += heads

    def pop(self, n: int) -> None:
        while len(self.stack) > n:
            tag, left_out, article, heads = self.stack.pop()
            self.places[tag].pop()
            if tag in ("article", "main"):
                self.walls.pop()
            if left_out:
                self.skips.pop()
            self.main -= article
            self.inner -= heads

    def close(self, tag: str) -> None:
        """An end tag closes the last such element, but not one around an open article."""
        if places := self.places.get(tag):
            if tag in ("body", "html", "article", "main") or not self.walls or self.walls[-1] < places[-1]:
                self.pop(places[-1])


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, without elements that can't hold main text."""
    out: list[Block] = []
    tags, open_ = Tags(html), Open()
    text: list[str] = []
    linked = breaks = at = 0
    in_link, tag_now = False, ""

    def flush(next_tag: str) -> None:
        nonlocal text, linked, tag_now, breaks
        if text:
            whole = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, tag_now, min(1.0, linked / len(whole)), open_.main > 0))
        text, linked, tag_now, breaks = [], 0, next_tag, 0

    while at < len(html):
        found = tags.next(at)
        piece = html[at : found[0] if found else len(html)]
        if piece and not open_.skips:
            text.append(piece)
            if piece.strip():
                breaks = 0
            if in_link:
                linked += len(SPACE.sub(" ", entities.unescape(piece)).strip())
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush(tag_now)
            text.append(" ")
            continue
        if tag == "a":
            in_link = not closing
        if tag in BREAKS:
            flush("" if closing else tag)
        alone = attributes.rstrip().endswith("/")
        if tag in RAW and not closing and not alone:
            end = RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
            if tag in CONTAINERS:
                continue
        if tag in VOID or tag not in CONTAINERS:
            continue
        if closing:
            open_.close(tag)
        elif not alone:
            if tag == "body":
                open_.pop(0)
            left_out, article, heads = _skips(tag, attributes, open_.inner > 0)
            if article and tag in ("article", "main") and open_.skips and open_.stack[-1][0] in ("nav", "header", "footer", "aside"):
                open_.pop(open_.skips[0])  # the element was not closed
            open_.push(tag, left_out, article, heads)
    flush("")
    return out


def _decided(b: Block, stops: float | None, marked: bool) -> bool | None:
    """The first pass: good, bad or open.  ``stops``: see _stops; ``marked``: an article holds main text."""
    if b.links > LINKS:
        return False
    if len(b.text) < SHORT:
        return None
    if stops is None:
        return True if len(b.text) >= LONG or b.main or not marked else None
    if b.main:
        return True if stops >= LOW else None
    if marked:
        good = stops >= HIGH and len(b.text) >= LONG
    else:
        good = stops >= HIGH or stops >= LOW and len(b.text) >= LONG
    return True if good else None if stops >= LOW else False


def _stops(found: list[Block]) -> list[float | None]:
    """The share of stop words of each block; None where it says nothing."""
    shares: list[float | None] = []
    letters = known = 0
    for b in found:
        words = WORDS.findall(b.text.lower())
        stops = [w for w in words if w in STOP_WORDS]
        share = len(stops) / max(1, len(words))
        size = sum(map(len, words))
        if b.links <= LINKS:
            letters += size
            known += sum(map(len, stops))
        other = share < LOW and size > 0 and 2 * sum(len(w) for w in words if w[0] > "\u024f") > size
        shares.append(None if other else share)
    foreign = known < FOREIGN * letters
    return [None if foreign and x is not None and x < LOW else x for x in shares]


def _inherited(b: Block, before: tuple[int, Block, bool] | None, after: tuple[int, Block, bool] | None, marked: bool) -> bool:
    """The second pass: an open block by its nearest decided neighbours (distance, block, label)."""
    if b.main:
        return not all(n is not None and n[1].main and not n[2] for n in (before, after))
    if b.tag[:1] == "h" and after is not None and (b.tag == "h1" or not marked or not after[1].main):
        return after[2]  # a heading goes with what it heads
    if marked:
        return all(n is not None and n[2] for n in (before, after))
    return min((n for n in (before, after) if n is not None), key=lambda n: n[0])[2]


def extract(html: str | None) -> str:
    """The main text of a page: its good blocks joined by an empty line."""
    found = blocks(html or "")
    stops = _stops(found)
    inside = [b for b in found if b.main and b.links <= LINKS]
    marked = sum(len(b.text) for b in inside) >= LONG or any(_decided(b, s, False) for b, s in zip(found, stops, strict=True) if b.main)
    label = [_decided(b, s, marked) for b, s in zip(found, stops, strict=True)]
    known = [i for i, x in enumerate(label) if x is not None]
    k = 0
    final = []
    for i, x in enumerate(label):
        while k < len(known) and known[k] < i:
            k += 1
        if x is None:
            before, after = ((abs(j - i), found[j], label[j]) if j is not None else None for j in (known[k - 1] if k else None, known[k] if k < len(known) else None))
            if known:
                x = _inherited(found[i], before, after, marked)
            else:
                x = found[i].main if inside else found[i].links == 0 and found[i].tag not in ("", "li")
        final.append(x)
    return "\n\n".join(b.text for b, x in zip(found, final, strict=True) if x)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([extract(x.as_py()) for x in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages."""
    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
