"""Main text of web pages by tag-path ratios.

A page is read once, tag by tag, into blocks of text: the text under one block element,
inline markup ignored, white space made one space. Each block has a root-to-leaf tag path.
What is no text (scripts, styles, the head) isn't read. For each path the text length and the punctuation
are added up; the ratios per block are smoothed over neighbouring blocks in page order and fused with those
of the container that the path lies in. Paths whose fused ratio reaches a share of the page's best are content, and so
is what lies with them in one article, main or other container below the body; lists, tables,
captions and headings, if not mostly links, also where a container further out, or the body, holds both.

Text in links doesn't count as length. Two more features weigh a path's ratio. A path through an element that carries a name of page furniture as its tag, role, class
or id (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) counts ``MARKED``, unless that
element holds the page's first article or main, or, on pages with neither outside of them, most of the text; such a path is content
only by its own ratio. On a page with an article or main, a path outside of them counts ``OUTSIDE``. Class and id
names count as whole. An element without an end tag ends where HTML says, inside furniture too.

Null, empty and text-free pages give an empty text. Rows are handled one by one: repeated rows give
equal results, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？؛،]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select input dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Of these an amount of text makes no content.
FIRM = frozenset("head nav footer button select menu".split())
#: Class and id names that mark page furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split()
)
#: An opening tag of the first kind ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A path is content from this share of the best fused ratio; weight of each neighbour.
SHARE, WEIGHT = 0.1, 0.25
#: What the ratio of a path counts through furniture, and outside of the page's articles and main.
MARKED, OUTSIDE = 1 / 1024, 1 / 256
ROOTS, MAIN = frozenset(("html", "body")), frozenset(("article", "main"))
STRUCTURE = frozenset("ul ol dl li dt dd table caption thead tbody tfoot tr td th figure figcaption blockquote pre h1 h2 h3 h4 h5 h6".split())


def furniture(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and not NAMES.isdisjoint(value.split()):
            return True
    return False


@dataclass
class Furniture:
    name: str
    size: int = 0  # characters of text inside
    main: bool = False  # holds the page's first article or main


#: A tag path, and the furniture around the text.
Path = tuple[tuple[str, ...], tuple[str, ...]]


@dataclass
class Piece:
    path: Path
    inside: tuple[int, ...]  # numbers of the elements of the tag path
    text: str
    linked: int = 0  # characters in links


def blocks(page: str) -> list[list[Piece]]:
    """The pieces of each block, in page order; a block has more than one piece if furniture lies within it."""
    found: list[tuple[list[str], list[int], list[tuple[str, tuple[Furniture, ...], bool]]]] = []
    stack: list[str] = []  # open block elements, and all elements that may be furniture
    numbers: list[int] = []  # of these, where they start in the page
    opened: list[tuple[int, Furniture]] = []  # those that may be furniture, with their depth in the stack
    held: list[tuple[str, tuple[Furniture, ...], bool]] = []
    main = link = False
    total = at = 0

    def flush() -> None:
        if held:
            of = [k for k, x in enumerate(stack) if x not in INLINE]
            found.append(([stack[k] for k in of], [numbers[k] for k in of], held.copy()))
            held.clear()

    def hold(text: str) -> None:
        nonlocal total
        if text:
            held.append((text, tuple(f for _, f in opened), link))
            size = len(SPACE.sub(" ", text).strip())
            total += size
            for _, f in opened:
                f.size += size

    def pop() -> str:
        name = stack.pop()
        numbers.pop()
        while opened and opened[-1][0] > len(stack):
            opened.pop()
        return name

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            hold(page[at:])
            break
        hold(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if not closing and name in RAW:
            if name not in INLINE:
                flush()
            if name in ("svg", "math") and m[3].endswith("/"):
                continue
            tail = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = tail.end() if tail else end
            continue
        if name in VOID:
            if name in INLINE:
                if name == "br":
                    hold(" ")
            else:
                flush()
            continue
        if name == "a":
            link = not closing
        elif name not in INLINE:
            link = False
        marked = not closing and furniture(name, m[3])
        if name in INLINE and not marked and name not in stack:
            continue
        if name not in INLINE:
            flush()
        if closing:
            if name in INLINE and not INLINE.issuperset(stack[len(stack) - 1 - stack[::-1].index(name) :]):
                continue  # inline end tags don't end blocks
            if name in stack:
                while pop() != name:
                    pass
            continue
        if name not in INLINE:
            if name == "body" and "head" in stack:
                while pop() != "head":
                    pass
            if stack and stack[-1] == "p":
                pop()
            while stack and stack[-1] in CLOSES.get(name, ()):
                pop()
        stack.append(name)
        numbers.append(at)
        if marked:
            opened.append((len(stack), Furniture(name)))
        if name in ("article", "main") and not main:
            main = True
            for _, f in opened:
                f.main = True
    flush()
    out = []
    for path, inside, pieces in found:
        texts: list[Piece] = []
        for text, around, linked in pieces:
            marks = tuple(f.name for f in around if not (f.main or not main and f.name not in FIRM and 2 * f.size > total))
            if not texts or texts[-1].path[1] != marks:
                texts.append(Piece((tuple(path), marks), tuple(inside), ""))
            texts[-1].text += text
            texts[-1].linked += len(text) * linked
        out.append(texts)
    return out


def plain(text: str) -> str:
    return SPACE.sub(" ", unescape(text)).strip()


def scores(found: list[Piece]) -> dict[Path, float]:
    """The best fused and weighed ratio of each path; text in links doesn't count as text length."""
    total: dict[Path, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    inside: dict[Path, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    holder = lambda path: (path[0][:-1], path[1])
    for x in found:
        marks = len(PUNCTUATION.findall(x.text))
        for sums in (total[x.path], inside[holder(x.path)]):
            for k, v in enumerate((max(1, len(x.text) - x.linked), marks, 1)):
                sums[k] += v
    ratio = lambda s: s[0] / s[2] * (1 + s[1] / s[2])
    primary = {path: not MAIN.isdisjoint(path[0]) for path in total}
    weight = {path: (MARKED if path[1] else 1) * (1 if primary[path] or not any(primary.values()) else OUTSIDE) for path in total}
    own = np.array([ratio(total[x.path]) * weight[x.path] for x in found])
    padded = np.concatenate((own[:1], own, own[-1:]))
    smooth = (1 - 2 * WEIGHT) * own + WEIGHT * (padded[:-2] + padded[2:])
    fused = [np.sqrt(min(v, 2 * o) * ratio(inside[holder(x.path)]) * weight[x.path]) for x, v, o in zip(found, smooth, own, strict=True)]
    best: dict[Path, float] = {}
    for x, f in zip(found, fused, strict=True):
        best[x.path] = max(best.get(x.path, 0.0), f)
    return best


def content(found: list[Piece]) -> list[bool]:
    """Which pieces are content: those on good paths, and what lies with them; none, if all lie in furniture."""
    best = scores(found) if found else {}
    if all(path[1] for path in best):
        return [False] * len(found)
    least = SHARE * max(best.values())
    good = [x for x in found if best[x.path] >= least]
    around = {x.inside[:k] for x in good for k in range(len(x.inside) + 1)}
    holders = {x.inside[:-1] for x in good if x.inside and not ROOTS.issuperset(x.path[0][:-1])}
    main = {x.inside[: k + 1] for x in good for k, name in enumerate(x.path[0]) if name in MAIN}
    held: dict[Path, list[int]] = defaultdict(lambda: [0, 0])
    for x in found:
        held[x.path][0] += len(x.text)
        held[x.path][1] += x.linked

    def beside(x: Piece) -> bool:
        """In an article, main or other container of content, or a list, table, caption or heading beside such."""
        ways = [x.inside[:k] for k in range(len(x.inside) + 1)]
        if x.path[1] or not main.isdisjoint(ways):
            return not x.path[1]
        if 2 * held[x.path][1] > held[x.path][0]:
            return False
        outer = next((k for k, name in enumerate(x.path[0]) if name in STRUCTURE), None)
        return not holders.isdisjoint(ways) or outer is not None and ways[outer] in around

    return [best[x.path] >= least or beside(x) for x in found]


def main_text(page: str | None) -> str:
    """The text of the page's content blocks, joined by blank lines."""
    found = blocks(page or "")
    units = [Piece(x.path, x.inside, text, x.linked) if (text := plain(x.text)) else None for pieces in found for x in pieces]
    keep = iter(content([x for x in units if x]))
    kept = iter([x is None or next(keep) for x in units])
    texts = (plain("".join(x.text for x in pieces if next(kept))) for pieces in found)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row of ``pages``, and the main ``text`` of its whole ``html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*keep, "text"])

    return texts_of(pages, *keep, F.col("html").alias("_html")).mapInArrow(run, pages.select(*keep).schema.add("text", "string"))
