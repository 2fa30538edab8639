"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its element paths (`html>body>div.ad`) and its text blocks of any length with their path. Tokens of
one host that share the occurrence vector, the count on every page of the host, form an equivalence class. A class is
valid if it is on at least half of the host's pages and has two tokens or more. Valid classes nest by path. The class of
the elements that every page has once is the frame of the template, in the order of their mean place; a page whose frame
stands in another order does not follow the template. The main slot is the element path of a valid class that is an
article or main element, or else the deepest one that occurs once a page and holds nine tenths of the text outside of
boilerplate elements. A page's main text is the text in its main slot, without the elements that hold menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments, and without template text: blocks of a valid
class that nine tenths of the host's different texts share, `support` different texts at least. Copies of one article are
one text. If what is shared makes up more than half of the host's text, the pages are versions of one article and
nothing is taken for template text.

Vectors are compared by the sum of a hash per page and count, which is combined before the shuffle, so a host with a
third of all pages is no larger a group than another; a template is one written row per host. Pages without the host's
main slot, such as the only page of another layout, fall back on their own article or main element, then on the whole body.

Defined cases: null or empty html has empty text; null urls share the empty host; an unclosed element ends with the page;
a tag that does not end is text; rows are extracted one by one, repeated or not; text of any length is kept whole. A page
is read once from left to right, whatever its markup, so time grows with its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.stage import stage
from procura.llm.urls import split_url
from procura.llm.words import slices

RAW = frozenset("script style noscript template svg iframe object select textarea button title".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_PLAIN = re.compile(r"[^>\"']*")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MAIN = frozenset(("article", "main"))
#: Elements and class, id or role words that hold no main text.
ASIDE = frozenset("nav footer aside form menu dialog head".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar widget widgets related recommended share sharing social comment comments reply replies respond disqus discussion breadcrumb breadcrumbs menu nav navbar navigation topbar footer pagination pager toolbar login search contentinfo complementary alert".split()
)
_SEMANTIC = "role=main"


#: Elements of a path that are shown in words; paths are compared whole.
SHOWN = 32
#: Elements that keep a paragraph around them open.
HOLDS_P = frozenset("table td th li div article".split())


class Block(NamedTuple):
    """One block of text: number of its element on the page (-1: none), its text, characters outside of links, and
    whether an element around it is boilerplate."""

    element: int
    text: str
    free: int
    aside: bool


class Element(NamedTuple):
    """path: hash of the names and classes from the root; parent: number on the page; main: article or main element;
    shown: the end of the path in words."""

    path: int
    parent: int
    depth: int
    main: bool
    shown: str


class Page(NamedTuple):
    blocks: list[Block]
    elements: list[Element]
    #: Characters of free text below each element, itself included, outside of boilerplate.
    free: list[int]


def tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, is an end tag, attributes) in page order; the last one has the text behind all tags and no
    name. Comments, declarations and raw elements with their content are left out."""
    at = begin = 0
    quotes = True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            text, end = html[begin:at], html.find("-->", at + 4)
            begin = at = len(html) if end < 0 else end + 3
            yield text, "", False, ""
            continue
        end = html.find(">", at)
        if end < 0:
            break
        if html[at + 1] in "!?":
            text = html[begin:at]
            begin = at = end + 1
            yield text, "", False, ""
            continue
        closing = html[at + 1] == "/"
        name = _NAME.match(html, at + 1 + closing)
        if not name:
            at += 1
            continue
        if quotes:
            found = _tag_end(html, name.end())
            quotes = found >= 0  # no tag ends outside of quotes any more: quotes mean nothing from here on
            end = found if quotes else end
        text, rest, tag = html[begin:at], html[name.end() : end], name[0].lower()
        begin = at = end + 1
        if tag in RAW and not closing:
            over = _ENDS[tag].search(html, at)
            begin = at = over.end() if over else len(html)
            yield text, "", False, ""
            continue
        yield text, tag, closing, rest
    yield html[begin:], "", False, ""


def _tag_end(html: str, at: int) -> int:
    """Place of the `>` outside of quotes, or -1."""
    while True:
        at = _PLAIN.match(html, at).end()
        if at >= len(html):
            return -1
        if html[at] == ">":
            return at
        at = html.find(html[at], at + 1) + 1
        if not at:
            return -1


def _words(rest: str) -> tuple[str, set[str]]:
    """Class names for the path, and the words of class, id and role."""
    classes, words = "", set()
    for name, *values in _ATTRIBUTE.findall(rest):
        value = next((v for v in values if v), "").lower()
        words.update(w for w in re.split(r"[^a-z]+", value) if w)
        if name.lower() == "class":
            classes = "".join("." + _DIGITS.sub("0", c) for c in sorted(value.split()))
        elif name.lower() == "role" and value == "main":
            classes += "." + _SEMANTIC
    return classes, words


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class _Reader:
    """Keeps the open elements of a page, and where those of each name are, so no step looks through all of them."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self.free: list[int] = []
        self.open: list[tuple[str, int, bool]] = []  # name, element, boilerplate
        self.places: dict[str, list[int]] = defaultdict(list)
        self.holders: list[int] = []
        self.mains = self.links = self.chars = 0
        self.held: list[str] = []

    def text(self, text: str) -> None:
        if text:
            text = entities.unescape(text)
            self.held.append(text)
            if not self.links:
                self.chars += len(text)

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                _, element, aside = self.open[-1] if self.open else ("", -1, False)
                self.blocks.append(Block(element, text, self.chars, aside))
                if element >= 0 and not aside:
                    self.free[element] += self.chars
            self.held.clear()
        self.chars = 0

    def close(self, to: int) -> None:
        self.flush()
        while len(self.open) > to:
            name, element, _ = self.open.pop()
            self.places[name].pop()
            if name in HOLDS_P:
                self.holders.pop()
            self.mains -= self.elements[element].main

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def end(self, name: str) -> None:
        if (place := self.last(name)) >= 0:
            self.close(place)
        elif name in BLOCK:
            self.flush()

    def start(self, name: str, rest: str) -> None:
        if name in VOID:
            if name in BLOCK:
                self.flush()
            return
        classes, words = _words(rest) if rest else ("", set())
        aside = name in ASIDE or bool(words & ASIDE_WORDS)
        aside |= (name == "header" or bool(words & {"header", "masthead"})) and not self.mains
        if name not in BLOCK and not aside:
            return
        if name in BLOCK:
            self.flush()
            ends = max((self.last(n) for n in CLOSES.get(name, ())), default=-1)
            p = self.last("p")
            if ends > p or (p >= 0 and (not self.holders or self.holders[-1] < p)):
                self.close(max(ends, p))
        _, parent, above = self.open[-1] if self.open else ("", -1, False)
        over = self.elements[parent] if parent >= 0 else Element(0, -1, 0, False, "")
        main = name in MAIN or _SEMANTIC in classes
        path = _signed(xxhash.xxh64_intdigest(name + classes, seed=over.path & ((1 << 64) - 1)))
        above_shown = over.shown.partition(">")[2] if over.depth >= SHOWN else over.shown
        shown = f"{above_shown}>{name}{classes}" if above_shown else name + classes
        self.elements.append(Element(path, parent, over.depth + 1, main, shown))
        self.free.append(0)
        if rest.rstrip().endswith("/") and name not in BLOCK:
            return
        self.places[name].append(len(self.open))
        if name in HOLDS_P:
            self.holders.append(len(self.open))
        self.mains += main
        self.open.append((name, len(self.elements) - 1, above or aside))

    def page(self) -> Page:
        self.flush()
        for i in range(len(self.elements) - 1, 0, -1):
            if self.elements[i].parent >= 0:
                self.free[self.elements[i].parent] += self.free[i]
        return Page(self.blocks, self.elements, self.free)


def parse(html: str) -> Page:
    """Text blocks and elements in page order."""
    reader = _Reader()
    for text, name, closing, rest in tags(html):
        reader.text(text)
        if name == "a":
            reader.links = max(reader.links - 1, 0) if closing else reader.links + 1
        if name and closing:
            reader.end(name)
        elif name:
            reader.start(name, rest)
    return reader.page()


def text_token(page: Page, block: Block) -> int:
    """Token of a text block: hash of its path and its words."""
    path = page.elements[block.element].path if block.element >= 0 else 0
    return _signed(xxhash.xxh64_intdigest(block.text, seed=(path ^ 1) & ((1 << 64) - 1)))


#: Kinds of tokens: the page itself, an element path, a text block.
PAGE, PATH, TEXT = 0, 1, 2
_COLUMNS = [
    ("host", pa.string()), ("page", pa.int64()), ("content", pa.int64()), ("kind", pa.int32()), ("token", pa.int64()), ("n", pa.int64()),
    ("chars", pa.int64()), ("size", pa.int64()), ("depth", pa.int64()), ("place", pa.int64()), ("main", pa.bool_()), ("shown", pa.string()),
]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page and token: n occurrences, free characters below it, characters of a text, first place on the
    page. content: hash of all text of the page outside of boilerplate."""
    for batch in batches:
        for part in slices(batch, "html"):
            out: list[tuple] = []
            for host, number, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                page = parse(html or "")
                own = [b for b in page.blocks if not b.aside]
                whole = xxhash.xxh64()
                for block in own:
                    whole.update(block.text.encode() + b"\n")
                content = _signed(whole.intdigest())
                out.append((host, number, content, PAGE, 0, 1, sum(b.free for b in own), sum(len(b.text) for b in own), 0, 0, False, ""))
                paths: dict[int, list] = {}
                for i, (element, free) in enumerate(zip(page.elements, page.free, strict=True)):
                    seen = paths.setdefault(element.path, [0, 0, element.depth, i, element.main, element.shown])
                    seen[0] += 1
                    seen[1] += free
                out += [(host, number, content, PATH, path, n, free, 0, *rest) for path, (n, free, *rest) in paths.items()]
                texts = Counter((text_token(page, b), len(b.text)) for b in own)
                out += [(host, number, content, TEXT, token, n, 0, size, 0, 0, False, "") for (token, size), n in texts.items()]
            columns = list(zip(*out, strict=True)) or [[]] * len(_COLUMNS)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], [name for name, _ in _COLUMNS])


def templates(pages: DataFrame, support: int = 8) -> DataFrame:
    """One row per host: main and slot, the path of the main slot in words and its token, or null; frame, the elements that every page has once, by mean
    place; constant, the tokens of template text; texts, how many different texts the host has."""
    fields = "host string, page long, content long, kind int, token long, n long, chars long, size long, depth long, place long, main boolean, shown string"
    mark = F.xxhash64("page", "n").cast("decimal(38,0)")
    by_content = pages.mapInArrow(_tokens, fields).groupBy("host", "kind", "token", "content").agg(
        F.sum(mark).alias("vector"), F.count(F.lit(1)).alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars"),
        F.sum("size").alias("size"), F.max("depth").alias("depth"), F.sum("place").alias("place"), F.max("main").alias("main"), F.max("shown").alias("shown"),
    )
    tokens = stage(
        by_content.groupBy("host", "kind", "token").agg(
            F.sum("vector").alias("vector"), F.sum("pages").alias("pages"), F.max("most").alias("most"), F.sum("chars").alias("chars"),
            F.sum("size").alias("size"), F.max("depth").alias("depth"), F.sum("place").alias("place"), F.max("main").alias("main"), F.max("shown").alias("shown"),
            F.count(F.lit(1)).alias("contents"),
        ),
        "tokens",
    )
    whole = tokens.filter(F.col("kind") == PAGE).select(
        "host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"), F.col("size").alias("all_size"), F.col("contents").alias("texts")
    )
    classes = stage(tokens.filter(F.col("kind") != PAGE).groupBy("host", "vector").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "classes")
    valid = tokens.filter(F.col("kind") != PAGE).join(classes, ["host", "vector"], "left_semi").join(whole, "host").filter(F.col("pages") * 2 >= F.col("all_pages"))
    is_path = F.col("kind") == PATH
    holds = (F.col("most") == 1) & (F.col("chars") >= 0.9 * F.col("all_chars")) & (F.col("all_chars") > 0)
    framed = is_path & (F.col("most") == 1) & (F.col("pages") == F.col("all_pages"))
    shared = ~is_path & (F.col("contents") >= support) & (F.col("contents") >= 0.9 * F.col("texts"))
    place = F.col("place") / F.col("pages")
    found = valid.groupBy("host").agg(
        F.max(F.when(is_path & F.col("main"), F.struct("chars", -F.col("depth"), "token", "shown"))).alias("semantic"),
        F.max(F.when(is_path & holds, F.struct("depth", "token", "shown"))).alias("largest"),
        F.sort_array(F.collect_list(F.when(framed, F.struct(place.alias("place"), "token")))).alias("frame"),
        F.collect_set(F.when(shared, F.col("token"))).alias("constant"),
        F.sum(F.when(shared, F.col("size"))).alias("shared_size"),
        F.max("all_size").alias("all_size"),
        F.max("texts").alias("texts"),
    )
    versions = F.coalesce(F.col("shared_size"), F.lit(0)) * 2 > F.col("all_size")
    return stage(
        found.select(
            "host", *[F.coalesce(F.col("semantic")[c], F.col("largest")[c]).alias(n) for c, n in (("shown", "main"), ("token", "slot"))], F.transform("frame", lambda f: f["token"]).alias("frame"),
            F.when(versions, F.array().cast("array<bigint>")).otherwise(F.col("constant")).alias("constant"), "texts",
        ),
        "templates",
    )


def main_text(html: str, slot: int | None, frame: list[int], constant: frozenset[int]) -> str:
    """Blocks of the main slot joined by line feeds."""
    page = parse(html)
    first: dict[int, int] = {}
    for i, element in enumerate(page.elements):
        first.setdefault(element.path, i)
    places = [first[f] for f in frame if f in first]
    if slot not in first or places != sorted(places):
        slot = next((e.path for e in page.elements if e.main), None)
    inside: list[bool] = []
    for element in page.elements:
        inside.append(element.path == slot or (element.parent >= 0 and inside[element.parent]))
    kept = [
        b.text for b in page.blocks
        if not b.aside and (slot is None or (b.element >= 0 and inside[b.element])) and not (constant and text_token(page, b) in constant)
    ]
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            columns = (part.column(c).to_pylist() for c in ("html", "slot", "frame", "constant"))
            texts = [main_text(html or "", slot, frame or [], frozenset(constant or ())) for html, slot, frame, constant in zip(*columns, strict=True)]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, support: int = 8) -> DataFrame:
    """(page_id, url, text) per row of `pages` (page_id long, url string, html string). support: different texts of a
    host that have to share a block before it can be template text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", split_url(F.col("url"))[0])
    found = templates(rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html"), support)
    return rows.join(found, "host", "left").select("page_id", "url", "html", "slot", "frame", "constant").mapInArrow(_extract, "page_id long, url string, text string")
