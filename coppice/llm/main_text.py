"""Main text of web pages by minimum cuts.

A page is cut into blocks of text at block-level tags. A linear classifier over a block's place
in the document (its ancestors and their classes and ids), its share of linked text, length and
punctuation gives the costs of calling it content or boilerplate: the capacities of its edges
to source and sink. Edges between neighbouring blocks, and between a block and the one before
it in the same container, have capacities that fall with their distance in the document tree. The minimum
cut, found by maximum flow, labels the blocks; those on the source's side are the main text.

Scripts, styles, comments of the markup, form controls, drawings and embedded media have no
blocks; formulas are text. Only elements that HTML reads as raw text run on to their own end tag;
the others without blocks end with the element around them at the latest. Character references
are decoded, white space inside a block becomes one space, blocks are joined by one space.
Null and empty pages and pages without content have an empty text. Malformed markup is read as
far as possible: a new paragraph ends the open one, unknown end tags are ignored, and a "<"
that begins no tag is text. Tags are scanned in time linear in the page, whatever its quotes. Elements
nested deeper than 512 open elements are no part of a block's place. Repeated rows are extracted one by one; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: Elements open at once, beyond which further ones add nothing to a block's place.
DEPTH = 512
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = frozenset("script style noscript textarea title iframe".split())
_EXCLUDED = frozenset("template svg object select option canvas audio video button".split())
_SCOPE = frozenset("template svg object select button".split())  # no tag inside closes an element outside
_DRAWN_HTML = frozenset("foreignobject desc".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_INLINE_END = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li td th tr caption legend summary figcaption".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
_ENDS = {"option": ("option",), "optgroup": ("option", "optgroup"), "select": ("option", "optgroup", "select"), "button": ("button",)}
_CONTAINER = frozenset("ul ol dl table tr".split())

#: Weights of the classifier: places, and words in classes, ids and roles.
_PLACES = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -7.0, "menu": -6.0, "dialog": -7.0, "head": -9.0, "header": -6.0, "fieldset": -4.0, "figure": -0.5, "address": -1.5, "article": 5.0, "main": 4.0, "h1": 0.8, "h2": 0.5, "h3": 0.5, "p": 0.8, "blockquote": 0.5, "pre": 0.5, "td": -0.3, "li": -0.4}
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscri\w+|signup|sign-up|login|popup|modal|overlay|side-?bar|widgets?|related|recommend\w*|share\w*|sharing|social|breadcrumbs?|menus?|nav\w*|foot\w*|masthead|site-?header|page-?header|header|top-?bar|comments?|comment-?list|disqus|respon(?:d|ses?)|repl(?:y|ies)|discussion|pager|pagination|toolbar|copyright|legal|disclaimer|tags|tag-?cloud|trending|popular|teasers?|skip|search\w*|donate|paywall|rating|outbrain|taboola|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main\w*|post|entry|story|body|text|prose)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE = re.compile(r"[.!?…:;\"”)]\s*$")


class Block:
    __slots__ = ("text", "linked", "path", "score")

    def __init__(self, text: str, linked: int, path: tuple, score: float):
        self.text, self.linked, self.path, self.score = text, linked, path, score


class Tags:
    """The tags, comments and declarations of a page, one after the other, in linear time.

    A ">" inside quotes doesn't end a tag, unless its quotes aren't closed before the page's end;
    then the first ">" does. Places from which a search has failed once aren't searched again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.lost: set[int] = set()  # opening quotes from which no tag's end is reached
        self.stop = (0, -1)  # the first of > " ' from the one place on is at the other

    def next_stop(self, at: int) -> int:
        if not self.stop[0] <= at <= self.stop[1]:
            m = _STOP.search(self.page, at)
            self.stop = (at, m.start() if m else len(self.page))
        return self.stop[1]

    def end(self, at: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin at `at`; there is some ">" from there on."""
        seen, first = [], at
        while (stop := self.next_stop(at)) < len(self.page):
            mark = self.page[stop]
            if mark == ">":
                return stop
            if stop in self.lost:
                break
            seen.append(stop)
            if (close := self.page.find(mark, stop + 1)) < 0:
                break
            at = close + 1
        self.lost.update(seen)
        return self.page.find(">", first)

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag from `at` on; the name is empty for others."""
        page = self.page
        while 0 <= (start := page.find("<", at)):
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, close + 3 if close >= 0 else len(page), "", False, ""
            if page.startswith("<![CDATA[", start):
                close = page.find("]]>", start + 9)
                return start, close + 3 if close >= 0 else len(page), "", False, ""
            if page.startswith(("<!", "<?"), start) and start < self.last:
                return start, page.find(">", start) + 1, "", False, ""
            if start < self.last and (m := _NAME.match(page, start)) and m.end() <= self.last:
                end = self.end(m.end())
                return start, end + 1, m[1].lower(), page[start + 1] == "/", page[m.end() : end]
            at = start + 1
        return None


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, each with the path of its open elements (name, number, weight)."""
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked, links, number, at, end = 0, 0, 0, 0, len(page)
    skip = -1  # place in the stack of the outermost excluded element
    tags, names = Tags(page), Counter()  # how many elements of a name are open

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, tuple(e for e in stack if e[0] in _BLOCK), 0.0))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links, skip
        for e in stack[upto:]:
            names[e[0]] -= 1
            if e[0] == "a":
                links -= 1
        del stack[upto:]
        if upto <= skip:
            skip = -1

    while at < end:
        tag = tags.after(at)
        piece = page[at : tag[0]] if tag else page[at:]
        if piece and skip < 0:
            said = html.unescape(piece) if "&" in piece else piece
            parts.append(said)
            if links:
                linked += len(said.strip())
        if not tag:
            break
        _, at, name, closes, attributes = tag
        if not name:
            continue
        if closes:
            for i in range(len(stack) - 1 if names[name] else -1, -1, -1):
                if stack[i][0] == name:
                    if any(e[0] in _BLOCK for e in (stack[i:skip] if skip >= 0 else stack[i:])):
                        flush()
                    close(i)
                    break
            else:
                if name in ("p", "br") and skip < 0:
                    flush() if name == "p" else parts.append(" ")
            continue
        if name in _RAW and not attributes.endswith("/"):
            ending = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at, max(at, tags.last + 1))
            at = ending.end() if ending else end
            continue
        if name == "br":
            if skip < 0:
                parts.append(" ")
            continue
        if skip >= 0 and name in _BLOCK and stack[skip][0] == "svg" and not any(e[0] in _DRAWN_HTML for e in stack[skip:]):
            close(skip)  # HTML ends a drawing here
        while skip >= 0 and stack[-1][0] in _ENDS.get(name, ()):
            close(len(stack) - 1)
        if name in _BLOCK:
            if skip < 0:
                flush()
            for i in range(len(stack) - 1 if any(names[x] for x in ("p", *_CLOSES.get(name, ()))) else -1, -1, -1):
                above = stack[i][0]
                if above in _SCOPE:
                    break
                if above in _CLOSES.get(name, ()) or above == "p":
                    if i < skip:
                        flush()
                    close(i)
                    break
                if above in _BLOCK and above not in _INLINE_END or above in _CONTAINER and above != name:
                    break
        if name in _VOID or attributes.endswith("/") or len(stack) >= DEPTH:
            continue
        number += 1
        weight = _PLACES.get(name, 0.0)
        if attributes:
            weight += _attributes(name, attributes)
        if name == "a":
            links += 1
        if skip < 0 and name in _EXCLUDED:
            skip = len(stack)
        stack.append((name, number, weight))
        names[name] += 1
    flush()
    return out


def _attributes(name: str, source: str) -> float:
    weight, bad, good = 0.0, False, False
    for a in _ATTRIBUTE.finditer(source):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            weight -= 8.0
        elif key in ("class", "id", "role", "itemprop", "aria-label"):
            split = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
            bad |= bool(_BAD.search(split))
            good |= bool(_GOOD.search(split))
    if name in ("body", "html"):
        return weight
    return weight + (-7.0 if bad else 2.5 if good else 0.0)


def score(block: Block) -> float:
    """How much likelier content than boilerplate, as a log-odds: the linear classifier."""
    n = len(block.text)
    words = block.text.count(" ") + 1
    place, inside = 0.0, False
    for name, _, weight in block.path:
        if name in ("article", "main"):
            inside = True
        place += 0.0 if name == "header" and inside and weight == _PLACES["header"] else weight  # an article's own header
    value = -1.0 + max(-14.0, min(7.0, place)) + min(2.0, 0.6 * math.log1p(words)) - 4.0 * min(1.0, block.linked / n)
    return value + (0.6 if _SENTENCE.search(block.text) else -0.2)


def proximity(a: Block, b: Block) -> float:
    """From 1 for blocks of one parent down, by the number of steps between them in the tree."""
    shared = 0
    for x, y in zip(a.path, b.path):
        if x[1] != y[1]:
            break
        shared += 1
    return 0.6 ** (max(0, len(a.path) - shared - 1) + max(0, len(b.path) - shared - 1))


def edges(found: list[Block], near: float, same: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and to the block before in the same container."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, near * proximity(found[i - 1], b)))
        holder = b.path[-2][1] if len(b.path) > 1 else 0
        if holder in last and last[holder] != i - 1:
            out.append((last[holder], i, same * proximity(found[last[holder]], b)))
        last[holder] = i
    return out


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side. gain: capacity from the source (if above 0) or to the sink. Dinic's algorithm."""
    n = len(gain)
    source, sink = n, n + 1
    to, room = [], []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, ab: float, ba: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(ab)
        out[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i, g in enumerate(gain):
        edge(source, i, g, 0.0) if g > 0 else edge(i, sink, -g, 0.0)
    for a, b, w in links:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1


def extract(page: str | None, near: float = 0.8, same: float = 0.4) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    if not found:
        return ""
    content = minimum_cut([score(b) for b in found], edges(found, near, same))
    return " ".join(b.text for b, yes in zip(found, content, strict=True) if yes)


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    few = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "html"):
            text = [extract(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(np.array([len(x) for x in text], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return few.mapInArrow(run, f"page_id {few.schema['page_id'].dataType.simpleString()}, url {few.schema['url'].dataType.simpleString()}, text string, n_chars long")


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
