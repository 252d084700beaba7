"""Main text of web pages by tree scoring.

Text blocks pass points for their length and commas to the elements around them, less with each level and
discounted by the share of link text. The best container is kept with those siblings that read like text.
Names that pages give to what is not the article lower the points of what stands inside; such an element goes
only after that, and stays where it holds the best container together with the article or most of the text. Lists of bare
links are left out of the article; a list with an item that reads as text, or that a colon announces, and every table stays.

The time grows with the length of the page, whatever its markup: an end tag finds its element by the places of the
open elements of that name, and sums over ancestors are taken in one pass from the last element to the first. From
the place where quotes in tags no longer close, tags end at the next ``>``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and names that pages give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF_BLOCKS = HEADINGS | frozenset("p pre li dd dt td th blockquote figcaption caption address".split())
#: A start tag in the first set ends an open one of the second, looking no further than the third.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
DROPPED = frozenset("nav aside footer script style noscript template head button select menu dialog iframe object svg canvas audio video search textarea title map annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist status".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion promoted banner "
    "cookie cookies consent gdpr privacy notice notices alert alerts warning announcement disclaimer newsletter subscribe subscription signup login register paywall popup "
    "modal overlay lightbox sidebar sidebars side rail aside comment comments commentlist disqus reply replies respond discussion reactions "
    "nav navbar navigation menu menus submenu topbar toolbar breadcrumb breadcrumbs crumbs pagination pager footer foot colophon copyright legal "
    "masthead share sharing social follow related recommended recommendations trending popular widget widgets skip search searchbox "
    "tags tagcloud toc feedback survey form".split()
)
PAGE_HEAD = frozenset({"header", "head", "top", "hdr"})

_TAG = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
_QUOTED_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>")
_PLAIN_REST = re.compile(r"[^>]*(?:>|\Z)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: End tags of these look beyond the cell they stand in.
_FAR = frozenset("table tr tbody thead tfoot td th body html article main div section".split())
_CELL = frozenset({"td", "th", "table"})
_LISTS = frozenset({"ul", "ol", "dl"})


class Page:
    """Elements in page order with their text events; an element's events are a run of the event list."""

    def __init__(self, source: str):
        self.tag, self.up, self.off, self.first, self.last = ["#"], [-1], [False], [0], [0]
        self.in_article = [False]
        self.doubtful, self.depth = [False], [0]  # by its name not the article; how many such elements it stands in
        self.block = [0]  # nearest block around or at the element
        self.events: list[tuple[int, str]] = []  # (element, text); the text of a break is ""
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # places on the stack of the open elements of a name
        self.blocks_open = [0]  # and of the open blocks
        self.build(source)
        self.hard = self.off

    def drop_doubtful(self, keep: set[int] | None) -> None:
        """From now on doubtful elements other than ``keep`` are off; None: none of them is."""
        self.off = list(self.hard)
        if keep is not None:
            for n in range(1, len(self.tag)):
                self.off[n] = self.hard[n] or self.off[self.up[n]] or (self.doubtful[n] and n not in keep)

    def open(self, tag: str, attrs: str) -> None:
        n, up = len(self.tag), self.stack[-1]
        self.tag.append(tag)
        self.up.append(up)
        inside = self.in_article[up] or tag in ("article", "main")
        self.in_article.append(inside)
        gone, doubt = self.unwanted(tag, attrs, inside) if len(attrs) > 1 else (False, False)
        self.off.append(self.off[up] or tag in DROPPED or (tag == "header" and not inside) or gone)
        self.doubtful.append(doubt or tag == "form")
        self.depth.append(self.depth[up] + self.doubtful[n])
        self.first.append(len(self.events))
        self.last.append(-1)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.events.append((n, ""))
            self.blocks_open.append(len(self.stack))
        self.block.append(n if tag in BLOCK else self.block[up])
        self.stack.append(n)

    def unwanted(self, tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
        """(whether the element is hidden or has another role, whether it has the name of such a one)."""
        doubt = False
        heading = tag in HEADINGS
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return True, doubt
            if name == "role":
                doubt = doubt or value.lower() == "form"
                if value.lower() in ROLES:
                    return True, doubt
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return True, doubt
            elif name == "class" or (name == "id" and tag != "p" and not heading):  # the id of a heading tells its subject
                if tag in ("html", "body", "article", "main", "h1"):
                    continue
                parts = {x.lower() for x in _NAME.findall(value)}
                page_head = not inside and not heading and tag != "p" and parts & PAGE_HEAD
                if parts & NAMES or (page_head and not parts & {"article", "entry", "post", "story", "content"}):
                    doubt = True
        return False, doubt

    def close(self, depth: int) -> None:
        """Close all elements from ``depth`` of the stack upwards."""
        for n in reversed(self.stack[depth:]):
            self.places[self.tag[n]].pop()
            if self.tag[n] in BLOCK:
                self.blocks_open.pop()
                self.events.append((n, ""))
            self.last[n] = len(self.events)
        del self.stack[depth:]

    def nearest(self, wanted: frozenset | set, stop: frozenset | set = frozenset()) -> int:
        """Place of the innermost open element of ``wanted``, 0 if there is none or one of ``stop`` stands inside it."""
        place = max((at[-1] for tag in wanted if (at := self.places.get(tag))), default=0)
        return place if place and all(at[-1] <= place for tag in stop if (at := self.places.get(tag))) else 0

    def build(self, source: str) -> None:
        at, end, open_tags = 0, len(source), self.stack
        rest = _QUOTED_REST
        while at < end:
            found = _TAG.search(source, at)
            stop = found.start() if found else end
            if stop > at:
                text = source[at:stop]
                self.events.append((open_tags[-1], html.unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            name = found[2]
            if not name:
                continue
            over = rest.match(source, at)
            if over is None:  # no tag from here on closes its quotes
                rest = _PLAIN_REST
                over = rest.match(source, at)
            tag, attrs, at = name.lower(), over[0], over.end()
            if found[1]:
                if tag == "br":
                    self.events.append((open_tags[-1], " "))
                elif depth := self.nearest((tag,), () if tag in _FAR else _CELL):
                    self.close(depth)
                continue
            if tag not in HEAD_ONLY and len(open_tags) > 1 and self.tag[open_tags[-1]] == "head":
                self.close(len(open_tags) - 1)
            if tag in BLOCK and tag != "html" and self.tag[open_tags[self.blocks_open[-1]]] == "p":
                self.close(self.blocks_open[-1])
            if tag in IMPLIED and (depth := self.nearest(*IMPLIED[tag])):
                self.close(depth)
            if tag in HEADINGS and self.tag[open_tags[-1]] in HEADINGS:
                self.close(len(open_tags) - 1)
            if tag in ("br", "hr"):
                self.events.append((open_tags[-1], " " if tag == "br" else ""))
            elif tag in VOID:
                continue
            elif tag in RAW:
                over = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = over.end() if over else end
            elif not attrs.endswith("/>") or tag in BLOCK:
                self.open(tag, attrs)
        self.close(1)
        self.last[0] = len(self.events)

    def blocks(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, str, int]]:
        """(element, text, letters in links) of the wanted blocks, white space as one space."""
        held: list[str] = []
        owner, linked = -1, 0
        links = self.link_of()
        for n, text in self.events[first:last]:
            if text:
                if not self.off[n]:
                    owner = n if owner < 0 and not text.isspace() else owner
                    held.append(text)
                    if links[n]:
                        linked += len(text)
            elif held:
                if line := " ".join("".join(held).split()):
                    yield owner, line, linked
                held, owner, linked = [], -1, 0
        if held and (line := " ".join("".join(held).split())):
            yield owner, line, linked

    def link_of(self) -> list[bool]:
        if not hasattr(self, "_links"):
            links = [False]
            for n in range(1, len(self.tag)):
                links.append(self.tag[n] == "a" or links[self.up[n]])
            self._links = links
        return self._links


def scores(page: Page, min_block: int, levels: int) -> tuple[list[float], list[int], list[int], list[float]]:
    """(score, letters, letters in links, text) of every element, from the blocks that are not off; ``text`` counts
    the letters of running text. Within doubtful elements points are halved, once for each."""
    size = len(page.tag)
    score, letters, linked, text = [0.0] * size, [0] * size, [0] * size, [0] * size
    for n, line, in_links in page.blocks():
        element = page.block[n]
        in_links = min(in_links, len(line))
        letters[element] += len(line)
        linked[element] += in_links
        if len(line) < min_block:
            continue
        text[element] += len(line) - in_links
        points = (1 + sum(map(line.count, ",،、，")) + min(len(line) / 100, 3)) * (1 - in_links / len(line)) * 0.5 ** page.depth[element]
        x, share = page.up[element] if page.tag[element] in LEAF_BLOCKS else element, 1.0
        for level in range(levels):
            if x < 0:
                break
            score[x] += points * share
            share = 1 / (2 if level == 0 else 3 * (level + 1))
            x = page.up[x]
    for n in range(size - 1, 0, -1):  # an element comes after those around it
        up = page.up[n]
        letters[up] += letters[n]
        linked[up] += linked[n]
        text[up] += text[n]
    return score, letters, linked, text


def ranked(score: list[float], letters: list[int], linked: list[int]) -> list[float]:
    return [s * (1 - l / n) if n else -1.0 for s, n, l in zip(score, letters, linked)]


def main_text(source: str, min_block: int = 25, levels: int = 5) -> str:
    """Text of the article in ``source``; blocks are joined by a line feed. Nothing found: empty.

    A doubtful element is kept where it is or holds the best container of the page and holds <main>, the longest
    <article> or most of the text. If what is left is empty or not a tenth of the best container, none is dropped.
    """
    page = Page(source)
    if not any(page.doubtful):
        return chosen_text(page, min_block, levels)
    page.drop_doubtful(None)
    score, letters, linked, text = scores(page, min_block, levels)
    rank = ranked(score, letters, linked)
    best = max(range(len(rank)), key=lambda x: (rank[x], -x))
    if rank[best] <= 0:
        best = max(range(len(rank)), key=lambda x: (letters[x], x))
    whole = [x for x in range(len(rank)) if page.tag[x] in ("article", "main") and not page.off[x] and letters[x]]
    longest = max((x for x in whole if page.tag[x] == "article"), key=lambda x: (text[x], -x), default=-1)
    holders = set()
    for x in [longest, *(x for x in whole if page.tag[x] == "main")]:
        while x > 0 and x not in holders:
            holders.add(x)
            x = page.up[x]
    keep, x = set(), best
    while x > 0:
        if page.doubtful[x] and (x in holders and page.tag[x] not in ("article", "main") or text[x] > 0.5 * text[0]):
            keep.add(x)
        x = page.up[x]
    page.drop_doubtful(keep)
    out = chosen_text(page, min_block, levels)
    if len(out) < 0.1 * letters[best] * 0.5 ** page.depth[best]:
        page.drop_doubtful(None)
        out = chosen_text(page, min_block, levels)
    return out


def chosen_text(page: Page, min_block: int, levels: int) -> str:
    """Text of the best container and its siblings, of the blocks that are not off."""
    size = len(page.tag)
    score, letters, linked, _ = scores(page, min_block, levels)
    if not letters[0]:
        return ""
    density = lambda x: linked[x] / letters[x] if letters[x] else 0.0
    rank = ranked(score, letters, linked)
    best = max(range(size), key=lambda x: (rank[x], -x))
    if rank[best] <= 0:
        whole = [x for x in range(size) if page.tag[x] in ("article", "main", "body") and letters[x]]
        best = max(whole, key=lambda x: (page.tag[x] != "body", letters[x]), default=0)
    lift = best
    while lift > 0 and page.tag[lift] not in ("article", "main"):
        lift = page.up[lift]
    if lift > 0:
        best = lift
    else:
        while (up := page.up[best]) > 0 and page.tag[up] not in ("body", "html") and rank[up] >= 0.6 * rank[best]:
            best = up
    chosen = {best}
    if lift <= 0 and (up := page.up[best]) >= 0:
        need = max(3.0, 0.2 * rank[best])
        for x in range(1, size):
            if page.up[x] == up and x != best and not page.off[x] and letters[x]:
                reads = page.tag[x] in HEADINGS and x < best or page.tag[x] in ("p", "pre", "blockquote") and density(x) < 0.3
                if reads or rank[x] >= need and density(x) < 0.5:
                    chosen.add(x)
    out = []
    for x in sorted(chosen):
        lines = list(page.blocks(page.first[x], page.last[x]))
        skip = menus(page, lines, x)
        out += [line for n, line, _ in lines if n not in skip]
    return "\n".join(out)


def menus(page: Page, lines: list[tuple[int, str, int]], container: int) -> set[int]:
    """Elements inside ``container`` that stand in a list of bare links. A list is more than that if more of an item
    than a mark is no link, if an item has a full stop, a comma or 60 letters, or if the block before ends with a colon."""
    end = container + 1
    while end < len(page.tag) and page.up[end] >= container:
        end += 1
    reads, first = [False] * (end - container), [len(lines)] * (end - container)
    for at, (n, line, in_links) in enumerate(lines):
        n -= container
        reads[n] = reads[n] or in_links < len(line) - 2 or len(line) >= 60 or any(c in line for c in ".,،、，。")
        first[n] = min(first[n], at)
    for n in range(end - 1, container, -1):
        up, n = page.up[n] - container, n - container
        reads[up] = reads[up] or reads[n]
        first[up] = min(first[up], first[n])
    out: set[int] = set()
    for n in range(container + 1, end):
        at = first[n - container]
        bare = page.tag[n] in _LISTS and not reads[n - container] and 0 <= at < len(lines)
        if page.up[n] in out or (bare and not (at > 0 and lines[at - 1][1].endswith(":"))):
            out.add(n)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, *keep, text, n_chars) per row; null or empty html gives empty text, repeated rows one result each.

    Pages are independent, so there is no shuffle; each row is parsed alone, whole.
    """
    source = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("_html"))
    out = source.drop("_html").schema.add("text", "string").add("n_chars", "long")
    kept = ["page_id", *keep]

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batch_iter:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(x) if x else "" for x in batch.column("_html").to_pylist()]
                columns = [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return source.mapInArrow(run, out)
