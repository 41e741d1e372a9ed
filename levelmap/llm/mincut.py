"""Main text of web pages by minimum-cut labelling of their blocks.

A page is split into blocks of text. A linear classifier on a block's surroundings and wording
gives its terminal capacities, to content or to boilerplate. Edges between successive blocks and
between successive children of one element resist a change of label, less so across landmarks.
The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = re.compile(r"[>\"']")
AFTER_NAME = re.compile(r"[\s/>]")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|type|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements, read as sets. VOID ones hold nothing, RAW ones no markup, and the text of MUTE ones is never read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
MUTE = RAW | frozenset("head template noscript svg math canvas object audio video select option button datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: What an opening element ends, and the elements that shield it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: How far an element leans to content.
LEAN = {
    "article": 3.0, "main": 2.5, "nav": -5.0, "aside": -4.0, "footer": -4.5, "header": -3.0, "form": -4.0, "dialog": -4.0,
    "menu": -3.0, "address": -1.5, "h1": 1.0, "h2": 0.3, "blockquote": 0.3, "figcaption": -0.3, "label": -3.0, "legend": -3.0,
}
#: Words of class, id and role that speak against content, and for it.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr privacy"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social related"
    " recommended recommendations trending popular sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer"
    " foot masthead topbar comment comments reply replies respond disqus discussion discussions pagination pager toolbar search form"
    " skip hidden copyright legal disclaimer complementary contentinfo toc outbrain taboola paywall donate feedback reviews".split()
)
FOR = frozenset("article articlebody content entry post story main body text prose markdown".split())
LANDMARKS = frozenset("article main nav aside footer header form dialog".split())


class Pieces:
    """Cuts a page into tags, comments and text, in time linear in its length however broken it is.

    A tag ends at the first > outside quotes. From a place outside quotes there is one way on, so a place that
    has led to the end of the page once leads there always, and is not walked again.
    """

    def __init__(self, page: str):
        self.page, self.dead, self.dead_names = page, set(), set()
        self.last = {c: page.rfind(c) for c in "\"'"}
        self.stops: tuple[list[int], list[int]] | None = None

    def next(self, at: int) -> tuple[int, str | None, bool, str, str]:
        """End of the piece at a place, and for a tag its name, whether it closes, and its attributes; else its text."""
        page, size = self.page, len(self.page)
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            return end, None, False, "", page[at:end]
        if page.startswith(("<!", "<?"), at):
            shut = ("-->", at + 4, 3) if page.startswith("<!--", at) else (">", at + 2, 1)
            end = page.find(shut[0], shut[1])
            return (size if end < 0 else end + shut[2]), None, False, "", "<!"
        name = at + 1 + page.startswith("/", at + 1)
        if page[name : name + 1].isascii() and page[name : name + 1].isalpha():
            name_end = self._stop(AFTER_NAME, 1, name)
            for cut in self._cuts(name, name_end):
                end = self._closing(cut)
                if end >= 0:
                    return end + 1, page[name:cut], name > at + 1, page[cut:end], ""
            self.dead_names.add(name_end)
        return at + 1, None, False, "", "<"

    def _stop(self, pattern: re.Pattern, kind: int, at: int) -> int:
        """The next place of a kind, or the page's end; looked up in a list once a tag has failed to end."""
        if self.stops is None:
            found = pattern.search(self.page, at)
            return found.start() if found else len(self.page)
        places = self.stops[kind]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else len(self.page)

    def _cuts(self, name: int, name_end: int) -> Iterator[int]:
        """Where the attributes may begin: after the name, or at a quote within it that would open a string."""
        if name_end in self.dead_names:
            return
        yield name_end
        for cut in range(name_end - 1, name, -1):
            if self.page[cut] in self.last:
                yield cut

    def _closing(self, at: int) -> int:
        """The > that ends a tag whose attributes go on at a place outside quotes; -1 if there is none."""
        page, walked = self.page, []
        while at not in self.dead:
            walked.append(at)
            at = self._stop(SPECIAL, 0, at)
            if at < len(page) and page[at] == ">":
                return at
            if at == len(page) or self.last[page[at]] <= at:
                break
            at = page.find(page[at], at + 1) + 1
        self.dead.update(walked)
        if self.stops is None:
            self.stops = tuple([m.start() for m in p.finditer(page)] for p in (SPECIAL, AFTER_NAME))
        return -1


class Element:
    """An open element: what its blocks inherit."""

    __slots__ = ("tag", "parent", "lean", "landmark", "mute", "link", "number", "inside")

    def __init__(self, tag: str, parent: Element | None, number: int, attributes: str):
        self.tag, self.parent, self.number = tag, parent, number
        up = parent or self
        self.inside = tag in ("article", "main") or (parent is not None and up.inside)
        lean = LEAN.get(tag, 0.0)
        if tag == "header" and parent is not None and up.inside:
            lean = 0.0
        self.mute = tag in MUTE or (parent is not None and up.mute)
        self.link = tag == "a" or (parent is not None and up.link)
        hint = 0.0
        if attributes:
            names: set[str] = set()
            for key, value in ATTRIBUTE.findall(attributes):
                value, key = value.strip("\"'"), key.lower()
                if (key == "style" and HIDDEN.search(value)) or key == "hidden" or (key == "aria-hidden" and value == "true"):
                    hint = -6.0
                elif key in ("class", "id", "role"):
                    names.update(WORDS.findall(CAMEL.sub(" ", value).lower()))
            if names & AGAINST or ("header" in names and not names & FOR):
                hint = min(hint, -5.0)
            elif names & FOR and tag != "body":
                hint += 1.0
        own = hint < 0 or tag in LANDMARKS
        self.landmark = number if own or parent is None else up.landmark
        # What leans away does so wherever it stands; leaning towards content does not add up.
        inherited = up.lean if parent is not None else 0.0
        total = lean + hint
        self.lean = min(inherited, 0.0) + total if total < 0 else (inherited if inherited < 0 else max(inherited, min(inherited + total, 3.5)))
        if total < 0 and inherited > 0:
            self.lean = total + 0.5


class Block:
    __slots__ = ("text", "score", "parent", "landmark")

    def __init__(self, text: str, score: float, parent: int, landmark: int):
        self.text, self.score, self.parent, self.landmark = text, score, parent, landmark


def score(text: str, linked: int, lean: float, heading: bool) -> float:
    """Classifier: how much more likely the block is content, as log-odds."""
    words = text.count(" ") + 1
    ended = text[-1] in ".!?…:;\"'”»)。"
    return -1.0 + lean + 0.45 * math.log1p(words) + 0.8 * ended + 0.6 * heading - 4.0 * linked / len(text)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order. Markup may be broken: what is never closed ends with the page."""
    top = Element("#page", None, 0, "")
    stack, open_tags, out = [top], Counter(), []
    parts: list[str] = []
    linked: list[str] = []
    count = 0

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            parts.clear()
            if text:
                raw = "".join(linked)
                of_links = len(" ".join((html.unescape(raw) if "&" in raw else raw).split())) if linked else 0
                home = stack[-1]
                while home.parent is not None and home.tag not in BLOCK:
                    home = home.parent
                parent = home.parent or home
                out.append(Block(text, score(text, min(of_links, len(text)), stack[-1].lean, home.tag[:1] == "h" and home.tag[1:].isdigit()), parent.number, stack[-1].landmark))
            linked.clear()

    def close(to: int) -> None:
        for gone in stack[to:]:
            open_tags[gone.tag] -= 1
        del stack[to:]

    at, size, pieces = 0, len(page), Pieces(page)
    while at < size:
        at, tag, closing, attributes, piece = pieces.next(at)
        if tag is None:
            if (piece[0] != "<" or piece == "<") and not stack[-1].mute:
                parts.append(piece)
                if stack[-1].link:
                    linked.append(piece)
            continue
        tag = tag.lower()
        if closing:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if tag in BLOCK or stack[-1].landmark != stack[k - 1].landmark:
                    flush()
                close(k)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].mute:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if open_tags["p"]:
                k = len(stack) - 1
                while stack[k].tag not in ("p", "td", "th", "table", "button"):
                    k -= 1
                if stack[k].tag == "p":
                    close(k)
            if tag in ENDS:
                ended, shields = ENDS[tag]
                if any(open_tags[t] for t in ended):
                    k = len(stack) - 1
                    while k and stack[k].tag not in ended and stack[k].tag not in shields:
                        k -= 1
                    if stack[k].tag in ended:
                        close(k)
            if tag == "body" and open_tags["head"]:
                while stack[-1].tag != "head":
                    close(len(stack) - 1)
                close(len(stack) - 1)
        count += 1
        made = Element(tag, stack[-1], count, attributes)
        if made.landmark == count or made.mute != stack[-1].mute:
            flush()
        if attributes[-1:] == "/" and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            if end:
                shut = page.find(">", at)
                at = shut + 1 if shut >= 0 else size
            continue
        stack.append(made)
        open_tags[tag] += 1
    flush()
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: successive blocks, and successive blocks under one parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            out.append((i - 1, i, 0.05 if a.landmark != b.landmark else 1.0 if a.parent == b.parent else 0.5))
        before = last.get((b.parent, b.landmark))
        if before is not None and before < i - 1:
            out.append((before, i, 0.5))
        last[(b.parent, b.landmark)] = i
    return out


def least_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: sum of |score| over blocks that go against their score, plus the weights
    of edges between different labels. A block whose score outweighs all its edges keeps its side in every
    minimum cut; such blocks are settled first, then the rest by maximum flow."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    left = list(scores)
    label: list[bool | None] = [None] * n
    ready = deque(range(n))
    while ready:
        i = ready.popleft()
        if label[i] is None and abs(left[i]) >= sum(near[i].values()) and (left[i] or not near[i]):
            label[i] = left[i] > 0
            for j, w in near[i].items():
                left[j] += w if label[i] else -w
                del near[j][i]
                ready.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _source_side(rest, left, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _source_side(rest: list[int], left: list[float], near: list[dict[int, float]]) -> set[int]:
    """Blocks on the content side after a maximum flow, by blocking flows on level graphs.

    Every round sends all that shortest paths hold at once, so there are as many rounds as path lengths.
    """
    supply = {i: max(left[i], 0.0) for i in rest}
    demand = {i: max(-left[i], 0.0) for i in rest}
    room = {i: dict(near[i]) for i in rest}
    tiny = 1e-9
    while True:
        level = {i: 0 for i in rest if supply[i] > tiny}
        order = list(level)
        for i in order:
            for j, w in room[i].items():
                if w > tiny and j not in level:
                    level[j] = level[i] + 1
                    order.append(j)
        if not any(demand[i] > tiny for i in order):
            return set(order)
        ways = {i: [j for j in room[i] if level.get(j) == level[i] + 1] for i in order}
        for start in order:
            if level[start]:
                break
            path = [start]
            while path and supply[start] > tiny:
                i = path[-1]
                if demand[i] > tiny:
                    flow = min([supply[start], demand[i], *(room[a][b] for a, b in zip(path, path[1:]))])
                    supply[start] -= flow
                    demand[i] -= flow
                    full = None
                    for k in range(len(path) - 1):
                        a, b = path[k : k + 2]
                        room[a][b] -= flow
                        room[b][a] += flow
                        if full is None and room[a][b] <= tiny:
                            full = k
                    if full is not None:
                        del path[full + 1 :]
                elif ways[i] and room[i][ways[i][-1]] > tiny:
                    path.append(ways[i][-1])
                else:
                    # Nothing more goes this way: the last step is given up, for this round.
                    if ways[i]:
                        ways[i].pop()
                    else:
                        path.pop()
                        if path:
                            ways[path[-1]].pop()


def main_text(page: str | None) -> str:
    """The content blocks of a page, one to a line; empty for null, for blank pages and for those without content."""
    blocks = blocks_of(page) if page else []
    keeps = least_cut([b.score for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, keeps, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html; other columns are ignored).

    Text is whole: character references are decoded, white space within a block is one space, blocks
    are lines. A null or blank html gives an empty text; broken markup is read as far as it goes.
    Repeated rows stay. An empty table gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page.as_py()) for page in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(each, "page_id long, url string, text string, n_chars long")
