"""Main text of web pages by consensus host paths.

1. A page is parsed once, into blocks of text, each inside a chain of containers.  A container's name is its path of
   tags and classes, generalised by leaving out digits.  Every block gives its length, less twice that of its links, to
   its container and half and a quarter as much to the next two; containers that are called an article count more.  From
   the best one the page goes up to the article element around it or, without one, while what a parent adds is prose.
2. Each page votes for the path that it came to.  Spark adds up the votes of each host.
3. Every page's blocks are taken again along its host's winning path, or along its own where it has no such container.

Left out wherever they stand: scripts, styles, menus, page headers and footers, sidebars, notices, adverts, forms and
reader comments.  Tags and roles decide it alone, but for forms, buttons and dialogs, which pages may stand in as a whole:
these are marks, as is a class or an id by its head word only ("ad-box", "site-header", not "has-sidebar").  What is marked stays
if it holds the page's article, its main heading, or nearly all of the text around it, and so does a paragraph of prose with the
name of a list of links.  Containers below ``MAX_DEPTH`` levels take the name of the last one above; their text is kept.

Defined results: null, empty and textless html give an empty text; pages without a host follow their own path; repeated
rows are kept; unclosed tags are closed by what follows, an unclosed script or comment by the page's end; an empty table
gives no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import looked_up, reliable, slices, table, written
from .url_filter import host_and_path

MAX_DEPTH = 12
#: What a parent adds is prose if blocks of this many characters make most of it.
PROSE = 40
# Names of the HTML standard, and words that sites use for parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article blockquote body center div main section td ul ol dl table".split())
#: Their content is no markup, up to the end tag.
RAW = frozenset("script style noscript textarea iframe title".split())
BESIDE = frozenset("aside footer iframe menu nav noscript script select style svg template textarea title".split())
BESIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo menu menubar navigation search toolbar".split())
#: Elements and roles that whole pages may stand in; they count like a class.
AROUND = frozenset("button dialog form".split())
BESIDE_WORDS = frozenset("ad ads adv advert advertisement advertising adverts adsbygoogle banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion recommended related share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar topbar widget widgets".split())
#: Those of lists of links: a paragraph of prose stays whatever they say.
LINK_WORDS = frozenset("breadcrumb breadcrumbs login menu nav navbar navigation pagination recommended related share sharing sidebar social toolbar topbar widget widgets".split())
COMMENT_WORDS = frozenset("comment comments commentary disqus replies reply respond responses".split())
#: Words that may follow one of those without another meaning, and first words that only say that something is there.
PART_WORDS = frozenset("area bar block body bottom box button buttons center col column container content group icons inner item items left link links list main message outer panel primary right row secondary section slot text thread title top unit wrap wrapper".split())
MODIFIERS = frozenset("has hide is js no not show with without".split())
ARTICLE_WORDS = frozenset("article articlebody content entry main post story text".split())
#: There is a body whether or not there is a tag of it.
IMPLIED = frozenset("html head body".split())
#: A start tag of the key closes open elements of these.
CLOSES = {"p": {"p"}, "a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= dict.fromkeys(("tbody", "thead", "tfoot"), {"tbody", "thead", "tfoot", "tr", "td", "th"})
#: Elements beyond which neither such closing nor the end tag of an inline element looks.
FENCES = frozenset("article aside div dl fieldset footer form header main nav ol section table ul".split())
#: Elements beyond which no end tag looks but that of a part of a table.
CELLS = frozenset("td th caption table template object".split())
TABLE_PARTS = frozenset("table tbody td tfoot th thead tr caption template object".split())

# Quotes count only where a value begins.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""")
_REMARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z])[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile("[0-9]+")


def _beside(name: str) -> str:
    """What a class or an id says about an element: "comments", "header", "links", "beside" or nothing."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in MODIFIERS:
        return ""
    head = words[-1]
    if not (head in BESIDE_WORDS or head in COMMENT_WORDS):
        head = words[0]
        if not (head in BESIDE_WORDS or head in COMMENT_WORDS) or not PART_WORDS.issuperset(words[1:]):
            return ""
    if head == "header":
        return "" if ARTICLE_WORDS.intersection(words) else "header"
    return "comments" if head in COMMENT_WORDS else "links" if head in LINK_WORDS else "beside"


class Element:
    """An open element.  One that is set beside is a mark: ``mark`` is the innermost one here, ``outer`` the next one around a mark;
    what a mark holds is counted at the innermost one first."""

    __slots__ = ("about", "article", "articles", "beside", "bonus", "chars", "commented", "container", "depth", "dropped", "free", "heading", "kept_around", "link", "links", "mains", "mark", "outer", "parent", "path", "place", "tag")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.beside = tag in BESIDE or (parent is not None and parent.beside)
        self.article = parent is not None and parent.article
        self.link = parent is not None and parent.link
        self.mark: Element | None = parent.mark if parent else None
        self.commented = parent is not None and parent.commented
        self.about, self.bonus = "beside" if tag in AROUND else "", 1.0
        self.container = tag in CONTAINERS
        label = tag
        if "=" in attributes:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            names = found.get("class", "").split()
            role = found.get("role", "").lower()
            self.beside |= role in BESIDE_ROLES
            self.link |= tag == "a" and "href" in found
            if tag != "main":
                said = {_beside(n) for n in (*names, found.get("id", ""))}
                if role in AROUND:
                    said.add("beside")
                self.about = next((s for s in ("comments", "beside", "links", "header") if s in said), self.about)
                if tag == "article" and self.about != "comments" or (self.about == "header" and self.article):
                    self.about = ""
            if ARTICLE_WORDS.intersection(w.lower() for n in (*names, found.get("id", ""), role) for w in _WORD.findall(n)):
                self.bonus = 2.0
            if role in ("main", "article"):
                self.bonus = 3.0
            label += "".join(f".{_DIGITS.sub('', n)}" for n in sorted(names)[:2])
        if tag == "header" and not self.article:
            self.beside = True
        if self.about:
            self.outer, self.mark = self.mark, self
            self.free = self.chars = self.links = 0
            self.articles = self.mains = self.heading = False
            self.commented |= self.about == "comments"
        if tag in ("article", "main") and self.about != "comments":
            self.bonus, self.article = 3.0, True
            if self.mark:
                self.mark.articles = True
                self.mark.mains |= tag == "main"
        if tag == "h1" and self.mark:
            self.mark.heading = True
        if parent is None:
            self.path = label
        elif self.container and parent.depth < MAX_DEPTH:
            self.path = f"{parent.path}/{label}"
        else:
            self.path = parent.path
        # the innermost element around here with a name of its own
        self.place: Element = self if parent is None or self.path != parent.path else parent.place


@dataclass(slots=True)
class Block:
    text: str
    links: int
    owner: Element


class Page:
    """Blocks of a page while its tags go by."""

    def __init__(self) -> None:
        self.stack = [Element("body", None)]
        self.pieces: list[tuple[str, Element]] = []
        self.found: list[tuple[list[tuple[str, Element]], Element]] = []
        self.marks: list[Element] = []
        self.has_article = False

    def flush(self) -> None:
        """Ends a block; its owner is the innermost element of a block around its first piece."""
        if self.pieces:
            owner = self.pieces[0][1]
            while owner.parent and owner.tag not in BLOCKS:
                owner = owner.parent
            self.found.append((self.pieces, owner))
            self.pieces = []

    def add(self, raw: str) -> None:
        top = self.stack[-1]
        if raw and not top.beside:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append((text, top))
            if top.article or top.mark:
                solid = len(text.strip())
                self.has_article |= top.article and solid > 0 and not top.commented
                if top.mark:
                    top.mark.free += solid
                    top.mark.links += solid if top.link else 0

    def close(self, tags: set[str] | frozenset[str], fences: frozenset[str]) -> None:
        """Closes the outermost open element of these tags that no fence hides."""
        last = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                last = k
            elif self.stack[k].tag in fences:
                break
        if last:
            del self.stack[last:]

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        fences = FENCES if tag not in BLOCKS or tag == "p" else frozenset() if tag in TABLE_PARTS else CELLS
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in fences:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.add(" ")
            return
        if tag in IMPLIED:
            return
        if closes := CLOSES.get(tag) or ({"p"} if tag in BLOCKS else None):
            self.close(closes, FENCES)
        # an inline element without attributes tells nothing; its end tag finds no opener
        if (tag in BLOCKS or tag in BESIDE or tag in AROUND or "=" in attributes) and not (attributes.endswith("/") and tag in ("svg", "math")):
            self.stack.append(Element(tag, self.stack[-1], attributes))
            if self.stack[-1].about:
                self.marks.append(self.stack[-1])

    def drops(self, m: Element) -> bool:
        if m.mains or m.articles and m.about != "comments":
            return False
        if m.about == "links" and m.tag == "p" and m.chars >= 2 * PROSE and 3 * m.links < m.chars:
            return False
        if self.has_article:
            return True
        return not (m.heading and m.about != "header") and (m.about == "comments" or 10 * m.kept_around >= m.chars)

    def blocks(self) -> list[Block]:
        """The blocks without what marks hold, unless a mark has to be a part of the article."""
        outside = sum(len(t.strip()) for pieces, _ in self.found for t, node in pieces if not node.mark)
        for m in reversed(self.marks):  # those inside before those around them
            m.chars += m.free
            if m.outer:
                m.outer.chars += m.chars
                m.outer.links += m.links
                m.outer.articles |= m.articles
                m.outer.mains |= m.mains
                m.outer.heading |= m.heading
        for m in self.marks:
            m.kept_around = m.outer.kept_around + m.outer.free if m.outer else outside
            m.dropped = m.outer is not None and m.outer.dropped or self.drops(m)
        out = []
        for pieces, owner in self.found:
            text, links = [], 0
            for t, node in pieces:
                if node.mark and node.mark.dropped:
                    continue
                text.append(t)
                links += len(t.strip()) if node.link else 0
            if whole := " ".join("".join(text).split()):
                out.append(Block(whole, min(links, len(whole)), owner))
        return out


def blocks_of(html: str) -> list[Block]:
    page = Page()
    at, last = 0, html.rfind(">")
    text_from = 0
    ends: dict[str, re.Pattern] = {}
    while 0 <= (at := html.find("<", at)) <= last:
        if remark := _REMARK.match(html, at):
            page.add(html[text_from:at])
            at = text_from = remark.end()
            continue
        m = _TAG.match(html, at)
        if not m:
            if not html[at + 1 : at + 2].isalpha() and html[at + 1 : at + 2] != "/":
                at += 1
                continue
            # a quote that is never closed: the tag ends where it seems to
            m = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>").match(html, at)
            if not m:
                at += 1
                continue
        page.add(html[text_from:at])
        at = text_from = m.end()
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, m[3])
        if tag in RAW:
            end = ends.setdefault(tag, re.compile(f"</{tag}[\\s/>]", re.I)).search(html, at)
            if end or tag in ("script", "style"):
                at = text_from = end.start() if end else len(html)
            else:
                # without an end its element would hold the rest of the page; it ends with the next tag
                page.end(tag)
                at = text_from = html.find("<", at) if "<" in html[at:] else len(html)
    page.add(html[text_from:])
    page.flush()
    return page.blocks()


def _containers(node: Element) -> Iterator[Element]:
    """Those around an element, each name once."""
    up: Element | None = node.place
    while up:
        yield up
        up = up.parent and up.parent.place


def best_path(blocks: list[Block]) -> str | None:
    """The path of a page's best container."""
    scores: dict[str, float] = defaultdict(float)
    total: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])  # characters, of links, of prose below each path
    place: dict[str, Element] = {}
    for b in blocks:
        worth = max(0, len(b.text) - 2 * b.links) * (1.0 if len(b.text) > 25 else 0.3)
        share = 1.0
        for container in _containers(b.owner):
            if share > 0.2:
                scores[container.path] += worth * share * container.bonus
                share /= 2
            place.setdefault(container.path, container)
            sums = total[container.path]
            sums[0] += len(b.text)
            sums[1] += b.links
            sums[2] += len(b.text) if len(b.text) >= PROSE and 2 * b.links < len(b.text) else 0
    if not scores:
        return None
    path = max(scores, key=lambda p: (scores[p], p))
    for up in _containers(place[path]):
        if up.tag in ("article", "main") and up.article:
            return up.path
    for up in _containers(place[path]):
        more = [a - b for a, b in zip(total[up.path], total[path], strict=True)]
        if up.path == path or not more[0]:
            continue
        if 3 * more[1] >= more[0] or 2 * more[2] <= more[0]:
            break
        path = up.path
    return path


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its own path, the paths of its containers, and its blocks with the numbers of those around them."""
    inside_type = pa.list_(pa.struct([("text", pa.string()), ("links", pa.int32()), ("inside", pa.list_(pa.int32()))]))
    for part in (p for batch in batches for p in slices(batch, "html")):
        own, paths, found = [], [], []
        for html in part.column("html"):
            blocks = blocks_of(html.as_py() or "")
            number: dict[str, int] = {}
            rows = []
            for b in blocks:
                inside = [number.setdefault(c.path, len(number) + 1) for c in _containers(b.owner)]
                rows.append({"text": b.text, "links": b.links, "inside": inside})
            own.append(best_path(blocks))
            paths.append(list(number))
            found.append(rows)
        yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "host": part.column("host"), "own": pa.array(own, pa.string()), "paths": pa.array(paths, pa.list_(pa.string())), "blocks": pa.array(found, inside_type)})


_PAGES = "page_id long, url string, host string, own string, paths array<string>, blocks array<struct<text:string,links:int,inside:array<int>>>"


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html)."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    given = given.withColumn("host", host_and_path(F.col("url"))[0])
    parsed = written(given.mapInArrow(_parsed, _PAGES))
    votes = parsed.filter("host <> '' and own is not null").groupBy("host", "own").count()
    winners = reliable(votes.groupBy("host").agg(F.max_by("own", F.struct("count", "own")).alias("path"), F.sum("count").alias("times")))
    joined = looked_up(parsed, winners, "host", "times")
    chosen = F.when(F.array_contains("paths", F.col("path")), F.col("path")).otherwise(F.col("own"))
    at = F.array_position("paths", chosen).cast("int")
    lines = F.transform(F.filter("blocks", lambda b: F.col("at").isNull() | F.array_contains(b["inside"], F.col("at"))), lambda b: b["text"])
    texts = joined.withColumn("at", at).select("page_id", "url", F.array_join(lines, "\n").alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def main_text(html: str, path: str | None) -> str:
    """The text of one page along a path, or along its own."""
    blocks = blocks_of(html)
    known = {c.path for b in blocks for c in _containers(b.owner)}
    path = path if path in known else best_path(blocks)
    return "\n".join(b.text for b in blocks if path is None or any(c.path == path for c in _containers(b.owner)))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
