"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks at block-level tags. A classifier of what a block looks
like (length, end of a sentence, share of links, heading,
paragraph), fitted on blocks of
pages that mark their content, gives its log odds; the region of the page that it
lies in (elements, roles, names of class and id) adds a bounded weight. A name
counts as a region if all its words are such as pages name regions and their parts
by; a name with other words in it ("share-price-analysis") is one weak sign. The
costs of calling a block boilerplate or content are capacities to the two
terminals. Neighbours in page order and neighbours within one parent are joined by
smoothness edges; the minimum cut labels the blocks. The blocks on the content
side are the text.

Blocks whose terminal capacities differ by more than all their edges can carry
are labelled beforehand, which changes no minimum cut and leaves few to Dinic's
algorithm.

Scale: a map over the pages, no shuffle; memory is that of one page.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of HTML, and words by which pages name their regions.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of which no text is read: to the end of the page if they aren't closed, or only if they are closed.
RAW = frozenset("script style".split())
UNREAD = frozenset("noscript template iframe svg canvas object textarea title audio video select datalist annotation annotation-xml".split())
UNREAD_RAW = UNREAD | RAW
REGION_TAGS = frozenset("nav footer aside form menu dialog button search".split())
REGION_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status tablist toolbar".split())
REGION_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs byline captcha comment commentlist comments complementary consent cookie cookies copyright cta disclaimer discussion disqus feedback footer footnav form gdpr header hidden hint infobar leaderboard legal login masthead menu menubar message modal nav navbar navigation navlinks newsletter notice notification notifications overlay pager pagination popup privacy promo promoted promotion promotions recommended related replies reply respond responses search share sharing shoutbox sidebar sidenav signin signup skip skyscraper social sponsor sponsored sponsors subscribe subscription survey tabs tagcloud teaser toolbar topbar tracking warning widget widgets".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article articlebody content entry main post story storybody".split())

#: Words by which pages name parts of any region.
PART_WORDS = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content div el element entry fixed form grid group heading holder icon icons img inner item items label large left level line link links list lists main mini mobile new nested next out outer page pane panel post posts prev previous primary right row secondary section site slot small sticky sub tag tags text title toggle top unit view wrap wrapper x y z".split()
)
#: With one of these a header is that of an article.
HEADED_WORDS = frozenset("article entry post story".split())

_NAME = re.compile(r"[a-z][a-z0-9:-]*+", re.IGNORECASE)
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Costs: what a region says for or against a block, a block outside the content of a page that marks it, a name that only
#: hints at boilerplate, and cutting between neighbours and within one parent.
REGION, OUTSIDE, HINT, NEXT, KIN = 8.0, 3.0, 1.5, 0.6, 0.6
#: Scripts that don't part words by spaces; two of their letters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Log odds that a block is content: constant, logarithm of its words (at most 50), end of a sentence, share of links, heading,
#: paragraph. Taken where no page tells; ``fit_weights`` gives those of a table.
WEIGHTS = (-2.6, 1.2, 1.0, -5.0, 1.6, 1.2)
#: Pages and blocks that the weights are fitted on at most, and the largest log odds of what a block looks like.
SAMPLE_PAGES, SAMPLE_BLOCKS, LOOKS = 4_000, 50_000, 4.0


class Element:
    __slots__ = ("tag", "region", "hint", "holder", "number")

    def __init__(self, tag: str, region: int, hint: bool, holder: bool, number: int):
        self.tag, self.region, self.hint, self.holder, self.number = tag, region, hint, holder, number


class Block:
    """region: 1 content, -1 boilerplate, 0 unknown; hint: a name around it has a word of boilerplate; parent: number of the element it lies in."""

    __slots__ = ("pieces", "linked", "region", "hint", "parent", "heading", "paragraph")

    def __init__(self, region: int, hint: bool, parent: int, heading: bool):
        self.pieces: list[str] = []
        self.linked, self.region, self.hint, self.parent, self.heading, self.paragraph = 0, region, hint, parent, heading, False


def named_region(names: str) -> tuple[int, bool]:
    """(region, hint) by the names of a class or an id."""
    found, hint = 0, False
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        bad = words & REGION_WORDS
        if bad:
            others = words - bad
            if bad == {"header"} and not HEADED_WORDS.isdisjoint(others):
                continue
            if others <= PART_WORDS or others <= CONTENT_WORDS:
                return -1, False
            hint = True
        elif not CONTENT_WORDS.isdisjoint(words):
            found = 1
    return found, hint


def _region(tag: str, attrs: str, outer: int, hint: bool) -> tuple[int, bool]:
    """What an element says of its inside, and whether a name hints at boilerplate; the inner element wins."""
    found = 0
    if tag in CONTENT_TAGS:
        found = 1
    elif tag in REGION_TAGS or tag == "header":
        found = -1
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                return -1, hint
            if name == "role":
                words = value.lower().split()
                if not REGION_ROLES.isdisjoint(words):
                    return -1, hint
                if "main" in words or "article" in words:
                    found = found or 1
            elif name in ("class", "id") and tag not in CONTENT_TAGS and tag not in ("body", "html"):
                named, hinted = named_region(value)
                if named < 0:
                    return -1, hint
                hint = hint or hinted
                if named and not found and outer >= 0:
                    found = 1
    return found or outer, hint


class Tokens:
    """The tags of a page in one pass: what scans to the end of the page in vain is remembered, so that unclosed tags, quotes and elements cost no second scan."""

    def __init__(self, page: str):
        self.page, self.last_gt, self.last_lt = page, page.rfind(">"), page.rfind("<")
        self.failed: list[tuple[list[int], list[int]]] = []
        self.closed: dict[str, tuple[int, int] | None] = {}

    def _tag_end(self, at: int) -> int:
        """The first > outside quotes from ``at`` on, -1 for none.

        A scan that ends in vain leaves the stretches in which it was outside quotes;
        one that starts in such a stretch would end alike. At any place scans can
        be in three states only, so no more than three of them are in vain.
        """
        for starts, ends in self.failed:
            i = bisect_right(starts, at) - 1
            if i >= 0 and at <= ends[i]:
                return -1
        starts, ends = [], []
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            starts.append(at)
            ends.append(m.start())
            after = self.page.find(m[0], m.end())
            if after < 0:
                break
            at = after + 1
        else:
            starts.append(at)
            ends.append(len(self.page))
        self.failed.append((starts, ends))
        return -1

    def end_of(self, tag: str, begin: int) -> int:
        """Where an element that is not read ends; -1 if it is never closed."""
        known = self.closed.get(tag, (-1, -1))
        if known is not None and known[0] < begin:
            m = re.compile(f"</{tag}", re.IGNORECASE).search(self.page, begin)
            gt = self.page.find(">", m.end()) if m and m.end() <= self.last_gt else -1
            known = self.closed[tag] = (m.start(), gt + 1) if gt >= 0 else None
        return known[1] if known else -1

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, name, whether it is an end, attributes) of each tag; the last has no name. Elements of ``RAW`` and comments are passed over."""
        page, at, begin = self.page, 0, 0
        while (lt := page.find("<", at)) >= 0:
            at = lt + 1
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                yield page[begin:lt], "", False, ""
                begin = at = end + 3 if end >= 0 else len(page)
                continue
            ending = page.startswith("/", at)
            name = _NAME.match(page, at + ending)
            if name is None and not page.startswith(("!", "?", "/"), at):
                continue
            if lt > self.last_gt:
                # Nothing closes it; the last such piece is a tag cut off, others are text.
                if lt == self.last_lt:
                    yield page[begin:lt], "", False, ""
                    begin = len(page)
                    break
                continue
            inner = name.end() if name else at
            gt = self._tag_end(inner) if name else -1
            # Broken quotes, and what is no element, end at the next >.
            gt = gt if gt >= 0 else page.find(">", inner)
            tag = name[0].lower() if name else ""
            yield page[begin:lt], tag, ending, page[inner:gt]
            begin = at = gt + 1
            if tag in UNREAD_RAW and not ending:
                end = self.end_of(tag, at)
                if end >= 0 or tag in RAW:
                    begin = at = end if end >= 0 else len(page)
        yield page[begin:], "", False, ""


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """The blocks of a page with text, and whether it marks its content."""
    stack = [Element("", 0, False, False, 0)]
    opened: Counter[str] = Counter()
    number, anchors, marked = 0, 0, False
    out: list[Block] = []
    now = Block(0, False, 0, False)

    def cut(heading: bool = False) -> None:
        nonlocal now
        if now.pieces:
            out.append(now)
        top = stack[-1]
        now = Block(top.region, top.hint, top.number, heading)

    def push(e: Element) -> None:
        stack.append(e)
        opened[e.tag] += 1

    def pop() -> Element:
        e = stack.pop()
        opened[e.tag] -= 1
        return e

    def close(tag: str) -> bool:
        if not opened[tag]:
            return False
        while pop().tag != tag:
            pass
        return True

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            now.pieces.append(entities.unescape(raw) if "&" in raw else raw)
            if anchors:
                now.linked += len(raw)
        elif raw and now.pieces:
            now.pieces.append(" ")

    for before, tag, ending, attrs in Tokens(page):
        text(before)
        if not tag or tag in UNREAD_RAW:
            continue
        if tag == "a":
            anchors = max(0, anchors + (-1 if ending else 1))
        if tag == "br":
            text(" ")
            continue
        inline = tag not in BLOCK
        if inline and tag != "button":
            # An inline element may be a region of its own, such as a hidden span or an advert.
            if ending:
                if any(e.tag == tag and e.holder for e in stack[-3:]):
                    close(tag)
                    cut()
            elif tag not in VOID and attrs:
                region, hint = _region(tag, attrs, stack[-1].region, stack[-1].hint)
                if region < 0 <= stack[-1].region:
                    number += 1
                    push(Element(tag, region, hint, True, number))
                    cut()
            continue
        if ending:
            if tag == "p" or close(tag):
                if tag == "p" and stack[-1].tag == "p":
                    pop()
                cut()
            continue
        while stack[-1].tag == "p":  # a block ends the paragraph before it
            pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            pop()
        top = stack[-1]
        if tag in VOID:
            cut()
            continue
        region, hint = _region(tag, attrs, top.region, top.hint)
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        # A heading within the header of an article belongs to the article.
        if heading and top.tag == "header" and any(opened[t] for t in CONTENT_TAGS):
            region = 1
        marked = marked or tag in CONTENT_TAGS
        number += 1
        push(Element(tag, region, hint, False, number))
        anchors = 0 if tag in ("article", "main", "nav", "footer", "section") else anchors
        cut(heading)
        now.paragraph = tag == "p"
        if heading or tag == "p":
            now.parent = top.number
    cut()
    return out, marked


def looks(text: str, block: Block) -> tuple[float, float, float, float, float]:
    """What a block looks like: logarithm of its words, end of a sentence, share of links, heading, paragraph."""
    words = text.count(" ") + 1
    if not text.isascii():
        words += len(_UNSPACED.findall(text)) // 2
    ends = float(text[-1] in ".!?…\"”»。！？」』")
    return math.log(min(50, words)), ends, min(1.0, block.linked / len(text)), float(block.heading), float(block.paragraph)


def costs(text: str, block: Block, marked: bool, weights: tuple[float, ...] = WEIGHTS) -> tuple[float, float]:
    """(cost of boilerplate, cost of content): the log odds of the looks, and what the region says."""
    odds = weights[0] + sum(w * x for w, x in zip(weights[1:], looks(text, block), strict=True))
    odds = max(-LOOKS, min(LOOKS, odds))
    boiler, content = max(0.0, odds), max(0.0, -odds)
    if block.region > 0:
        boiler += REGION
    elif block.region < 0:
        content += REGION
    elif marked:
        content += OUTSIDE
    if block.hint:
        content += HINT
    return boiler, content


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays on the source's side; source[i] is the capacity from the source, sink[i] to the sink. Ties go to the sink."""
    n = len(source)
    lead = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    load = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:  # a node that its edges cannot turn is settled, and pulls on its neighbours
        i = todo.popleft()
        if side[i] is not None or not (lead[i] > load[i] or lead[i] <= -load[i]):
            continue
        side[i] = lead[i] > load[i]
        for j, c in near[i].items():
            if side[j] is None:
                lead[j] += c if side[i] else -c
                load[j] -= c
                todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, s in zip(left, _dinic(left, lead, near, side), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def _dinic(left: list[int], lead: list[float], near: list[dict[int, float]], side: list) -> list[bool]:
    at = {i: k for k, i in enumerate(left)}
    s, t = len(left), len(left) + 1
    graph: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, i in enumerate(left):
        if lead[i] > 0:
            join(s, k, lead[i], 0.0)
        elif lead[i] < 0:
            join(k, t, -lead[i], 0.0)
        for j, c in near[i].items():
            if j > i and side[j] is None:
                join(k, at[j], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(left))]
        step = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while step[a] < len(graph[a]):
                e = graph[a][step[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                step[a] += 1
            if step[a] < len(graph[a]):
                path.append(graph[a][step[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                step[a] += 1
            else:
                break


def _written(page: str) -> tuple[list[tuple[Block, str]], bool]:
    """The blocks of a page that have text, with it, and whether the page marks its content."""
    found, marked = blocks_of(page)
    texts = [" ".join("".join(b.pieces).split()) for b in found]
    return [(b, x) for b, x in zip(found, texts, strict=True) if x], marked


def main_text(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The blocks on the content side, one to a line; '' if there are none."""
    if not page:
        return ""
    kept, marked = _written(page)
    source, sink = [], []
    for b, x in kept:
        boiler, content = costs(x, b, marked, weights)
        source.append(boiler)
        sink.append(content)
    edges, last = [], {}
    for k, (b, _) in enumerate(kept):
        if k:
            edges.append((k - 1, k, NEXT if kept[k - 1][0].region == b.region else NEXT / 4))
        if b.parent in last:
            edges.append((last[b.parent], k, KIN))
        last[b.parent] = k
    side = minimum_cut(source, sink, edges)
    return "\n".join(x for (_, x), s in zip(kept, side, strict=True) if s)


def fit_weights(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_BLOCKS) -> tuple[float, ...]:
    """Weights of the looks by logistic regression over blocks of pages that mark their content: blocks of content regions against those of boilerplate regions.

    About ``SAMPLE_PAGES`` distinct pages are read, those of least hash, and of their
    blocks ``sample`` at most; with fewer than 100 of a kind the fixed weights stay.
    The regions label the blocks and are no part of their looks.
    """
    # A page that occurs very often is one page.
    share = min(1.0, SAMPLE_PAGES / max(1, pages.count()))
    pages = pages.select(html_col).filter(F.pmod(F.xxhash64(html_col), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page in b.column(0):
                kept, marked = _written(page.as_py() or "")
                rows += [(zlib.crc32(x.encode("utf-8", "replace")), float(k.region > 0), *looks(x, k)) for k, x in kept if marked and k.region]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([list(r[1:]) for r in rows], pa.list_(pa.float64()))], names=["h", "x"])

    # A bounded number of rows.
    some = pages.select(html_col).mapInArrow(run, "h long, x array<double>").orderBy("h", "x").limit(sample).collect()
    data = np.array([r["x"] for r in some]).reshape(-1, len(WEIGHTS))
    y = data[:, 0]
    if min(y.sum(), len(y) - y.sum()) < 100:
        return WEIGHTS
    x = np.c_[np.ones(len(data)), data[:, 1:]]
    # Both kinds weigh alike.
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = np.zeros(len(WEIGHTS))
    for _ in range(25):  # Newton's steps, with a little weight on small weights
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (each * (y - p)) - 1e-3 * w)
        w += step
    return tuple(float(round(v, 6)) for v in w)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``pages`` without the html, with its main text.

    A null page is empty, and so is the text of a page without content. A column
    named as the text is replaced, any other stays, whatever its name. Repeated
    rows are rows of their own; an empty table gives none.
    """
    others = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    schema = T.StructType([*others, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = b.column(b.schema.get_field_index(html_col))
            text = pa.array([main_text(x.as_py(), weights) for x in html], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in others), text], names=[f.name for f in schema.fields])

    return pages.select(*(F.col(f.name) for f in others), F.col(html_col)).mapInArrow(run, schema)
