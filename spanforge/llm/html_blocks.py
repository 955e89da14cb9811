"""HTML extraction: flat text blocks with the word counts and link densities of their neighbours, and a decision tree.

A page is cut into blocks at block-level tags. Tags and names are structure: they say which blocks are page furniture (menus, headers, forms,
adverts, reader comments), and which lie in the article, chosen among all elements of that kind by size. Of the rest, a small decision tree, trained here on
``EXAMPLES``, says which blocks are main text, from a block's words and link density, those of the block before and the block after, and whether it lies in the article. On
pages without an article, the words and links decide alone.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
Markup, scripts, styles and comments give no text. Nothing is dropped for its length, and pages of any length are read
whole, in one pass that is linear in their length.

Defined cases: null and empty html give an empty text; pages without blocks too; unclosed and misnested tags are
tolerated, as is an html that breaks off anywhere (a tag that is never closed by ">" is dropped); repeated rows are each
extracted; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENING = re.compile(r"<(?:[!?]|/?[A-Za-z])")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*)?")
VALUE = re.compile(r"[^\s>]*")
NAMING = frozenset("class id role aria-label itemprop data-role".split())
HIDING = re.compile(r"display\s*:\s*none", re.I)
WORDS = re.compile(r"\S+")
SPACES = re.compile(r"\s+")
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button option".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
FURNITURE_TAG = frozenset("nav header footer aside form menu dialog search".split())
#: A name is cut at what is no letter or digit, and between small and capital letters. It stands for reader comments if its first part is of these and its last one of no state;
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
STATES = frozenset("open closed off on enabled disabled count allowed".split())
#: for other furniture if a part is of these and the others of the next or numbers. Names with any other part say nothing: an "article-header" is no header.
FURNITURE_NAME = frozenset(
    "nav navbar navigation menu menubar header masthead banner footer sidebar side widget related recommended cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login ad ads advert adverts advertisement sponsor sponsored promo promotion share sharing social breadcrumb breadcrumbs pagination pager toolbar copyright legal tags search complementary contentinfo".split()
)
NEUTRAL = frozenset("site page global main primary secondary top bottom left right upper lower box block bar area list item items links link wrap wrapper container inner outer section panel row col column slot unit zone widget buttons button icons".split())
CLOSES = {"p": BLOCK - {"html", "body"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: int = 0
    article: int = 0  # whether it lies in the page's article

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class Element:
    """What is known of an element as structure: its kind, and the blocks from start up to end in it."""

    kind: str  # 'furniture', 'named' (furniture by its name only), 'article', 'main'
    start: int
    end: int = -1


def name_kind(names: list[str]) -> str:
    """What names (class, id, role) say of an element: 'furniture', 'named', or nothing."""
    kind = ""
    for value in names:
        for token in value.split():
            parts = [p for p in re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", token).lower()) if p]
            if parts and parts[0] in COMMENTS and not (len(parts) > 1 and parts[-1] in STATES):
                return "furniture"
            if any(p in FURNITURE_NAME for p in parts) and all(p in FURNITURE_NAME or p in NEUTRAL or p.isdigit() for p in parts):
                kind = "named"
    return kind


class Scanner:
    """Tags of a page, one after the other; no character is looked at more than a few times."""

    def __init__(self, page: str):
        self.page = page
        self.never: set[str] = set()  # what doesn't occur any more from some place on

    def find(self, what: str, at: int) -> int:
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def tag(self, at: int) -> tuple[str, bool, dict[str, str], bool, int] | None:
        """name, whether it is an end tag, attributes, whether it closes itself, the place after it, of the tag that begins at a '<'; None if it never ends."""
        page, closing = self.page, self.page.startswith("/", at + 1)
        m = NAME.match(page, at + 1 + closing)
        assert m
        attributes: dict[str, str] = {}
        if self.find(">", m.end()) < 0:
            return None
        at = m.end()
        while True:
            a = ATTRIBUTE.match(page, at)
            if not a:
                end = self.find(">", at)
                return None if end < 0 else (m[0].lower(), closing, attributes, page[end - 1] == "/", end + 1)
            at, value = a.end(), ""
            if a[0].rstrip().endswith("="):
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:  # no quotes, or one that is never closed
                    v = VALUE.match(page, at)
                    value, at = v[0], v.end()
            attributes.setdefault(a[1].lower(), value)


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """The flat blocks of a page, in order, and its elements that say something of them, in one pass."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, Element | None, int, int]] = []  # tag; what it is; whether it is a link, silent
    opened: dict[str, int] = {}  # how many elements of each tag are on the stack
    within: list[str] = []  # the block elements on the stack
    link = silent = articles = 0
    text: list[str] = []
    linked = 0
    scanner = Scanner(page)
    ends = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW}
    unended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        joined = SPACES.sub(" ", "".join(text)).strip()
        if joined:
            out.append(Block(joined, len(WORDS.findall(joined)), linked))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            plain = entities.unescape(raw)
            text.append(plain)
            if link:
                linked += len(WORDS.findall(plain))

    def leave() -> str:
        nonlocal link, silent, articles
        tag, element, l, s = stack.pop()
        opened[tag] -= 1
        if tag in BLOCK:
            within.pop()
        if element is not None:
            element.end = len(out)
            articles -= element.kind == "article"
        link, silent = link - l, silent - s
        return tag

    at, n = 0, len(page)
    while at < n:
        found = OPENING.search(page, at)
        if not found:
            add(page[at:])
            break
        start = found.start()
        add(page[at:start])
        if page.startswith("<!--", start):
            end = scanner.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1] in "!?":
            end = scanner.find(">", start)
            at = n if end < 0 else end + 1
            continue
        got = scanner.tag(start)
        if got is None:
            break
        tag, closing, attributes, empty, at = got
        if closing:
            if opened.get(tag):
                if tag in BLOCK:
                    flush()
                while leave() != tag:
                    pass
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            while stack and (stack[-1][0] in CLOSES and tag in CLOSES[stack[-1][0]] or stack[-1][0] not in BLOCK and stack[-1][0] not in SILENT and within and within[-1] in CLOSES and tag in CLOSES[within[-1]]):  # or an inline element (as an unclosed <b>) in a paragraph that this tag closes
                leave()
        elif tag == "br":
            add(" ")
        if tag in VOID or empty:
            continue
        if tag in RAW:
            end = None if tag in unended else ends[tag].search(page, at)
            if end is None:
                unended.add(tag)
            at = end.end() if end else n
            continue
        kind = ""
        if tag not in ("html", "body"):
            kind = name_kind([v for k, v in attributes.items() if k in NAMING]) if attributes else ""
            if tag in ("article", "main"):
                kind = "furniture" if kind == "furniture" else tag
            elif tag in FURNITURE_TAG and not (tag == "header" and articles and not kind):
                kind = "furniture"
            elif not kind and "articlebody" in attributes.get("itemprop", "").lower():
                kind = "article"
        element = Element(kind, len(out)) if kind else None
        if element is not None:
            elements.append(element)
            articles += kind == "article"
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(HIDING.search(attributes.get("style", "")))
        l, s = int(tag == "a"), int(tag in SILENT or hidden)
        stack.append((tag, element, l, s))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in BLOCK:
            within.append(tag)
        link, silent = link + l, silent + s
    flush()
    while stack:
        leave()
    return out, elements


def covered(found: list[Block], elements: list[Element]) -> list[int]:
    """How many of the elements each block lies in."""
    change = [0] * (len(found) + 1)
    for e in elements:
        change[e.start] += 1
        change[e.end] -= 1
    return list(accumulate(change[:-1]))


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page, with what the page's structure says of them: furniture, and the article.

    Furniture by name alone isn't, if it holds more than half of the words that are in no other furniture, few of them links: names of layouts are no menus. The article is the element of
    that kind with the most words, and others of half its size or more; smaller ones are teasers. If more than twice as many words lie outside
    all of them as in it, the page's text isn't in its articles. A main element counts where articles don't.
    """
    found, elements = parsed(page)
    hard = covered(found, [e for e in elements if e.kind == "furniture"])
    plain = [0, *accumulate(0 if h else b.words - b.linked for b, h in zip(found, hard, strict=True))]
    every = [0, *accumulate(0 if h else b.words for b, h in zip(found, hard, strict=True))]

    def is_layout(e: Element) -> bool:
        return 2 * (every[e.end] - every[e.start]) > every[-1] and 10 * (plain[e.end] - plain[e.start]) >= 7 * (every[e.end] - every[e.start])

    named = covered(found, [e for e in elements if e.kind == "named" and not is_layout(e)])
    for b, h, s in zip(found, hard, named, strict=True):
        b.furniture = h + s
    own = [0, *accumulate(0 if b.furniture else b.words - b.linked for b in found)]
    size = lambda e: own[e.end] - own[e.start]
    articles = [e for e in elements if e.kind == "article" and size(e)]
    best = max(map(size, articles), default=0)
    inside = covered(found, articles)
    outside = sum(b.words - b.linked for b, a in zip(found, inside, strict=True) if not a and not b.furniture)
    if best and outside <= 2 * best:
        region = covered(found, [e for e in articles if 2 * size(e) >= best])
    else:
        mains = [e for e in elements if e.kind == "main" and 2 * size(e) > own[-1]]
        region = [a if not i else 0 for a, i in zip(covered(found, mains), inside, strict=True)]
        if not any(region):
            region = [-1 if i else 0 for i in inside]  # teasers are no part of a text outside of them
    for b, r in zip(found, region, strict=True):
        b.article = r
    return found


#: Labelled blocks to train on: (words, link density, words before, density before, words after, density after, in the article, main text).
EXAMPLES = [
    (10, 0.0, 8, 0.0, 40, 0.0, 1, 1), (60, 0.0, 10, 0.0, 45, 0.0, 1, 1), (1, 0.0, 60, 0.0, 45, 0.0, 1, 1), (2, 0.0, 1, 0.0, 3, 0.0, 1, 1), (9, 0.0, 1, 1.0, 70, 0.0, 1, 1), (3, 0.0, 2, 1.0, 0, 0.0, 1, 1),
    (90, 0.1, 60, 0.0, 70, 0.2, 1, 1), (70, 0.0, 90, 0.1, 10, 0.0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 1), (3, 1.0, 40, 0.0, 45, 0.0, 1, 1), (12, 1.0, 30, 0.0, 30, 0.2, 1, 1), (5, 1.0, 4, 1.0, 6, 1.0, 1, 1),
    (40, 0.4, 70, 0.0, 50, 0.0, 1, 1), (6, 0.5, 20, 0.0, 30, 0.0, 1, 1), (200, 0.0, 1, 1.0, 9, 0.0, 1, 1), (4, 0.0, 2, 1.0, 80, 0.0, 1, 1),
    (40, 0.0, 8, 0.0, 60, 0.0, 0, 1), (60, 0.1, 40, 0.0, 30, 0.0, 0, 1), (8, 0.0, 12, 0.0, 40, 0.0, 0, 1), (12, 0.0, 60, 0.0, 50, 0.0, 0, 1), (30, 0.0, 60, 0.1, 3, 1.0, 0, 1), (35, 0.0, 1, 1.0, 40, 0.0, 0, 1),
    (5, 0.0, 50, 0.0, 40, 0.0, 0, 1), (7, 0.0, 45, 0.0, 20, 0.0, 0, 1), (8, 0.0, 1, 1.0, 60, 0.0, 0, 1), (6, 0.0, 2, 1.0, 45, 0.0, 0, 1), (25, 0.0, 0, 0.0, 0, 0.0, 0, 1), (120, 0.0, 9, 0.0, 1, 1.0, 0, 1), (3, 0.0, 30, 0.0, 25, 0.0, 0, 1),
    (48, 0.0, 50, 0.0, 0, 0.0, 0, 1), (60, 0.0, 45, 0.0, 1, 0.0, 1, 1), (21, 0.0, 160, 0.0, 1, 0.0, 1, 1), (6, 0.0, 40, 0.0, 0, 0.0, 0, 1), (9, 0.0, 30, 0.0, 1, 0.0, 0, 1), (40, 0.0, 8, 0.0, 0, 0.0, 0, 1), (33, 0.1, 70, 0.0, 1, 0.0, 0, 1), (1, 0.0, 44, 0.0, 1, 0.0, 1, 1),
    (2, 0.0, 0, 0.0, 35, 0.0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1), (14, 0.2, 40, 0.0, 35, 0.1, 0, 1), (10, 0.5, 50, 0.1, 60, 0.0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0), (4, 0.8, 3, 1.0, 60, 0.0, 0, 0), (2, 1.0, 70, 0.0, 1, 1.0, 0, 0), (20, 0.9, 5, 1.0, 40, 0.0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (5, 1.0, 40, 0.0, 0, 0.0, 0, 0),
    (2, 0.0, 3, 1.0, 4, 1.0, 0, 0), (1, 0.0, 1, 1.0, 2, 1.0, 0, 0), (4, 0.0, 2, 1.0, 1, 1.0, 0, 0), (15, 0.7, 1, 1.0, 1, 1.0, 0, 0), (3, 0.0, 5, 1.0, 0, 0.0, 0, 0), (8, 1.0, 6, 1.0, 7, 1.0, 0, 0), (12, 0.9, 60, 0.0, 10, 0.9, 0, 0),
]
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article")


@dataclass
class Node:
    """A split at feature <= bound, or, without branches, a verdict."""

    verdict: int = 0
    feature: int = -1
    bound: float = 0.0
    yes: Node | None = None
    no: Node | None = None

    def decide(self, row: tuple) -> int:
        node = self
        while node.yes is not None and node.no is not None:
            node = node.yes if row[node.feature] <= node.bound else node.no
        return node.verdict


def grow(rows: list[tuple], depth: int = 6) -> Node:
    """A decision tree by the Gini index; among equal splits the first feature and the least bound."""
    ones = sum(r[-1] for r in rows)
    node = Node(int(2 * ones >= len(rows)))
    if not depth or ones in (0, len(rows)):
        return node

    def gini(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    best: tuple | None = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            bound = (a + b) / 2
            yes, no = [r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]
            impurity = gini(yes) + gini(no)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, bound, yes, no)
    if best is None:
        return node
    _, node.feature, node.bound, yes, no = best
    node.yes, node.no = grow(yes, depth - 1), grow(no, depth - 1)
    return node


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(EXAMPLES)


def rows_of(found: list[Block]) -> list[tuple]:
    edge = Block("", 0, 0)
    around = [edge, *found, edge]
    return [(b.words, b.density, p.words, p.density, q.words, q.density, int(b.article > 0)) for p, b, q in zip(around, found, around[2:], strict=False)]


def main_text(page: str | None) -> str:
    """The main text of a page: of the blocks that are no furniture, and in the article where there is one, those that the tree takes."""
    found = blocks(page or "")
    known = any(b.article > 0 for b in found)
    keep = [not b.furniture and (b.article > 0 if known else b.article == 0) for b in found]
    top = tree()
    return "\n\n".join(b.text for b, row, k in zip(found, rows_of(found), keep, strict=True) if k and top.decide(row))


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with column out: the main text of each page."""
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = pa.array([main_text(t.as_py()) for t in part.column(html)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), got], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)


def page_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    got = extract_text(pages.select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
