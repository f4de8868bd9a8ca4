"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of tags from the root to
it. Text length and punctuation are added up for each path and divided by its
number of blocks; both ratios are smoothed over the page's blocks in order,
fused and held against their spread. Paths above it are content. The region
that holds them is the article, and the blocks in it are its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framesift.llm.common import ROW, keyed, text_batches

#: Share of the fused ratios' spread that content paths are above, and the width of the smoothing in blocks.
SPREAD, WIDTH = 0.3, 1.0

#: Share of the content that an article or main element has to hold to be the region.
MAJORITY = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements whose text is not parsed for tags.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())

#: Elements that are never article text, and one that is none unless it holds most of the page.
OUTSIDE = frozenset(
    "head nav footer aside button select option input label fieldset dialog menu svg math canvas object "
    "audio video map datalist".split()
)
DOUBTFUL = "form"

#: Roles that say the same of any element.
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: Words of a class or id that say so.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay sidebar side nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager footer foot copyright disclaimer comment comments commentlist reply replies respond "
    "discussion disqus share sharing social related recommended newsletter subscribe subscription signup login search "
    "toolbar widget widgets skip hidden".split()
)

#: Of these, words of readers' comments; and words beside one that make it say how a page is made, not what an element is.
READERS_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
STATE_WORDS = frozenset("has no not with without open opened closed enabled disabled allowed on off overflow".split())

#: Text of an element left out as a form or for its class or id, as a multiple of the text of the rest, above which it is read.
OVERRULES = 3

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that begin and end blocks.
BLOCK = HEADINGS | frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "button select option optgroup legend".split()
)

#: What a start tag closes, and the elements beyond which it closes nothing.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？\"'()«»„“”‘’–—-]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    name: str
    parent: Element | None
    path: int
    depth: int
    outside: bool
    doubt: int  # the nearest start tag that it may be outside for, if for nothing that is certain; or 0


@dataclass(slots=True)
class Block:
    element: Element
    heading: bool
    text: str
    linked: int  # characters in links


def _outside(name: str, attributes: str, parent: Element | None) -> tuple[bool, bool, str]:
    """Whether an element is not article text, whether it may not be, and its class or id as part of its path."""
    found, doubtful = name in OUTSIDE, name == DOUBTFUL
    label = ""
    if attributes and name not in ("html", "body"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                label = label or value.strip().split(" ")[0]
                for token in value.split():
                    every = {w.lower() for w in _WORD.findall(token)}
                    words = every & OUTSIDE_WORDS
                    if name in ("article", "main"):
                        words &= {"comment", "comments", "reply"}
                    found = found or bool(words & READERS_WORDS and (token.lower() in words or not every & STATE_WORDS))
                    doubtful = doubtful or bool(words)
            elif key == "role":
                found = found or value.lower() in OUTSIDE_ROLES
            elif key == "style":
                found = found or bool(_HIDDEN.search(value))
            elif key in ("hidden", "aria-hidden"):
                found = found or key == "hidden" or value.lower() == "true"
    if name == "header":  # a page's header is not text; an article's may hold its headline
        above = parent
        while above is not None and above.name not in ("article", "main"):
            above = above.parent
        found = found or above is None
    return found, doubtful, label


class _Reader:
    """Reads a page into blocks. Start tags of ``overruled``, by number, are not outside as a form or for their class or id."""

    def __init__(self, overruled: frozenset[int] = frozenset()):
        self.overruled = overruled
        self.tags = 0
        self.doubted: Counter[int] = Counter()  # characters left out, by the nearest doubtful start tag; not those of links
        self.within: dict[int, int] = {}  # the doubtful start tag around each
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str, str], int] = {}
        self.open: list[Element] = [Element("", None, 0, 0, False, 0)]
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if raw and not self.open[-1].outside:
            self.parts.append(raw)
            if self.names["a"]:
                self.linked += len(raw.strip())
        elif raw and self.open[-1].doubt and not self.names["a"]:
            self.doubted[self.open[-1].doubt] += len(raw.strip())

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                # a block belongs to the innermost element that makes blocks
                inner = self.open[-1]
                heading = False
                while inner.name and inner.name not in BLOCK:
                    inner = inner.parent
                heading = inner.name in HEADINGS
                self.blocks.append(Block(inner, heading, text, min(self.linked, len(text))))
            self.parts = []
        self.linked = 0

    def pop(self) -> None:
        self.names[self.open.pop().name] -= 1

    def close(self, targets: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Close the innermost open element of ``targets``, if no limit is nearer."""
        if not any(self.names[t] for t in targets):
            return
        for place in range(len(self.open) - 1, 0, -1):
            name = self.open[place].name
            if name in targets:
                while len(self.open) > place:
                    self.pop()
                return
            if name in limits:
                return

    def start_tag(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in BLOCK:
            self.end_block()
            if name in CLOSES:
                self.close(*CLOSES[name])
            elif name not in ("html", "body"):
                self.close(("p",), ("article", "aside", "blockquote", "div", "section", "li", "td", "body"))
        if name in VOID:
            return
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.pop()
        parent = self.open[-1]
        self.tags += 1
        outside, doubtful, label = _outside(name, attributes, parent)
        doubtful = doubtful and self.tags not in self.overruled
        certain = outside or (parent.outside and not parent.doubt)
        if doubtful and not certain:
            self.within[self.tags] = parent.doubt
        doubt = 0 if certain else self.tags if doubtful else parent.doubt
        path = self.paths.setdefault((parent.path, name, label), len(self.paths) + 1)
        self.open.append(Element(name, parent, path, parent.depth + 1, outside or doubtful or parent.outside, doubt))
        self.names[name] += 1

    def end_tag(self, name: str) -> None:
        if name in BLOCK:
            self.end_block()
        if self.names[name] and name not in ("html", "body"):
            while self.open[-1].name != name:
                self.pop()
            self.pop()

    def read(self, page: str) -> list[Block]:
        place = 0
        while (token := _TOKEN.search(page, place)) is not None:
            self.text(page[place : token.start()])
            place = token.end()
            name = token["name"]
            if name is None:
                continue
            name = name.lower()
            if token["end"]:
                self.end_tag(name)
            elif name in RAW:
                closing = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, place)
                place = closing.end() if closing else len(page)
            else:
                self.start_tag(name, token["attributes"])
        self.text(page[place:])
        self.end_block()
        return self.blocks


def _smooth(values: np.ndarray, width: float) -> np.ndarray:
    reach = max(1, round(2 * width))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * width**2))
    weight = np.convolve(np.ones(len(values)), kernel, "same") if len(values) > 2 * reach else None
    if weight is None:  # shorter than the kernel
        apart = np.subtract.outer(np.arange(len(values)), np.arange(len(values)))
        kernel = np.exp(-(apart**2) / (2 * width**2))
        return kernel @ values / kernel.sum(axis=1)
    return np.convolve(values, kernel, "same") / weight


def content_paths(blocks: list[Block], spread: float = SPREAD, width: float = WIDTH) -> set[int]:
    """Paths whose fused ratios of text and punctuation stand out."""
    paths, place, count = np.unique([b.element.path for b in blocks], return_inverse=True, return_counts=True)
    own = np.array([len(b.text) - b.linked for b in blocks], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) * (b.linked < len(b.text)) for b in blocks], dtype=float)
    length = _smooth((np.bincount(place, own) / count)[place], width)
    marked = _smooth((np.bincount(place, marks) / count)[place], width)
    fused = length * (1 + marked)
    by_path = np.bincount(place, fused) / count
    chosen = by_path >= max(spread * fused.std(), 1e-9)
    # beside the smoothed ratio, a path needs a fair share of the best path's own text
    ratio = np.bincount(place, own) / count
    chosen &= ratio >= 0.1 * ratio.max()
    return set(paths[chosen].tolist())


def _region(blocks: list[Block]) -> Element:
    """The element that holds the content: an article or main with most of it, or the lowest that has it all."""
    held: Counter[int] = Counter()
    elements: dict[int, Element] = {}
    total = 0
    for block in blocks:
        total += len(block.text)
        above: Element | None = block.element
        while above is not None:
            if above.name in ("article", "main"):
                held[id(above)] += len(block.text)
                elements[id(above)] = above
            above = above.parent
    enough = [elements[key] for key, size in held.items() if size > MAJORITY * total]
    if enough:
        return max(enough, key=lambda e: e.depth)
    common = blocks[0].element
    for block in blocks[1:]:
        other = block.element
        while common is not other:
            if common.depth >= other.depth:
                common = common.parent
            else:
                other = other.parent
    return common


def _within(element: Element | None, region: Element) -> bool:
    while element is not None and element.depth >= region.depth:
        if element is region:
            return True
        element = element.parent
    return False


def _overruled(reader: _Reader) -> frozenset[int]:
    """Doubtful start tags that hold far more text than the rest of the page, and so are read all the same.

    The outermost ones first; what is within one that is read stays doubtful by itself.
    """
    total = Counter(reader.doubted)
    inner: dict[int, list[int]] = {}
    for tag in sorted(reader.within, reverse=True):  # those within a tag come after it
        around = reader.within[tag]
        inner.setdefault(around, []).append(tag)
        if around:
            total[around] += total[tag]
    rest = sum(len(b.text) - b.linked for b in reader.blocks)
    outermost = [(-total[tag], tag) for tag in inner.get(0, [])]
    heapify(outermost)
    found = set()
    while outermost and -outermost[0][0] > OVERRULES * rest:
        tag = heappop(outermost)[1]
        found.add(tag)
        rest += reader.doubted[tag]
        for more in inner.get(tag, []):
            heappush(outermost, (-total[more], more))
    return frozenset(found)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, one to a line. Empty if there is none."""
    reader = _Reader()
    blocks = reader.read(page or "")
    if overruled := _overruled(reader):
        blocks = _Reader(overruled).read(page or "")
    if not blocks:
        return ""
    paths = content_paths(blocks)
    content = [b for b in blocks if b.element.path in paths]
    if not content:
        return ""
    region = _region(content)
    if region.name in ("", "html", "body"):
        # no element of its own: content paths, and headings that lead to them
        kept, leads = [], False
        for block in reversed(blocks):
            stays = block.element.path in paths or (block.heading and leads)
            leads = stays
            if stays:
                kept.append(block)
        kept.reverse()
    else:
        # an article or main is one by its name; what stands in any other element has to be on a content path
        named = region.name in ("article", "main")
        kept = [
            b
            for b in blocks
            if _within(b.element, region) and (b.element.path in paths or b.heading or (named and 2 * b.linked < len(b.text)))
        ]
    return "\n".join(b.text for b in kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id, url, text, n_chars) with the main text of its whole html.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments are left out. Character references are decoded
    and white space inside a block becomes one space; blocks are joined by a
    line feed. A null or empty html, or one without text, gives an empty text.
    Null and repeated ids, and null urls, are passed on as they are. Other
    columns are not read.
    """
    text_batches(pages.sparkSession)
    rows = keyed(pages, id_col, _url=url_col, _html=html_col)
    id_type = rows.schema["_id"].dataType.simpleString()
    keep = [ROW] if ROW in pages.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch["_html"]]
            columns = [batch["_id"], batch["_url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + columns, [*keep, id_col, url_col, "text", "n_chars"])

    schema = f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long"
    return rows.mapInArrow(run, f"{ROW} long, {schema}" if keep else schema)
