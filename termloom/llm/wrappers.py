"""HTML extraction by union-free wrappers: a regular expression of tags and text slots for each host, inferred from its pages.

A page is a stream of structural tags and texts. Neighbouring equal blocks fold into repeated groups, and the wrapper of a host
grows by aligning it with one page's stream after another: what both have is kept, what one of them lacks becomes optional,
texts that differ become slots. Tasks infer partial wrappers from the pages they read, and those are aligned in turn, so a
host's pages never have to meet. All pages are then read by it to count, over the whole host, how many different ones have each
slot's text. The wrapper so says which of its slots hold the article, and reads them off every page: those that differ from page
to page, in the element that has most of the host's text of that kind. What a page marks as its article counts where the
wrapper can't tell: on hosts of one or two pages, and on pages that it doesn't match.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import written

#: Tags inside a block of text; of those that start a block, the ones whose end may be left out; and those without content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
OPEN_ENDED = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article, those that do, and words in class, id or role that say so.
ASIDE = frozenset("head title nav header footer aside form button select textarea label fieldset noscript template iframe object svg canvas audio video dialog menu".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|footer|sidebar|aside|widget|cookies?|consent|notices?|alert|popup|modal|comments?|replies|disqus|share|social|related|recommend\w*|newsletter|subscribe|login|search|pagination|pager|navigation|contentinfo|complementary)(?:$|[\s_-])", re.I)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:main|article-?body|entry-?content|post-?content|article-?content|story-?body)(?:$|[\s_-])", re.I)
LONGEST_BLOCK, BROADCAST_BYTES, SALTS = 12, 32 << 20, 64
#: A text is a host's own, not a page's, if this part of the host's different pages have it, and there are so many at least: of all
#: that counted() is given; an Inference by itself keeps those with the least hashes alone, up to SAMPLED. Tokens that a task holds
#: before aligning.
NEARLY_ALL, FEWEST, SAMPLED, HELD_TOKENS = 0.9, 3, 64, 200_000
#: The part of a host's changing text that the article's element has at least; cells of a table that an alignment fills at once.
MOST_TEXT, TABLE_CELLS = 0.8, 1 << 14
_COMMENT, _SCRIPT, _MARK = r"<!--.*?(?:-->|\Z)", r"<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)", r"<[!?][^>]*+>"
_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>"
#: A token; one that is no whole tag; and one behind which there is no > any more.
_TOKEN, _LOOSE, _LAST = (re.compile(f"{x}|[^<]+|<", re.S | re.I) for x in (f"{_COMMENT}|{_SCRIPT}|{_MARK}|{_TAG}", f"{_COMMENT}|{_SCRIPT}|{_MARK}", _COMMENT))
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile("[\"'>]")
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


@lru_cache(maxsize=20_000)
def _kind(name: str, attributes: str) -> tuple[str, int]:
    """A start tag's symbol, with its class, and whether it is aside (-1) of the article, holds it (1) or neither (0)."""
    named = " ".join(v.strip("\"'") for _, v in _NAMED.findall(attributes))
    own = re.search(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", attributes, re.I)
    symbol = f"{name}.{re.sub(r'[0-9]+', '', own[1]).strip(chr(34) + chr(39))}" if own else name
    if name in ASIDE or named and ASIDE_WORDS.search(named):
        return symbol, -1
    return symbol, int(name in MAIN or bool(named and MAIN_WORDS.search(named)))


class _Closed:
    """Tells which tags of a page are closed by a > outside of quotes, from one pass over quotes and > from the end."""

    def __init__(self, page: str):
        self.page, self.name_end = page, -1
        self.at, out, double, single = [], False, False, False
        self.closed: list[bool] = []  # for each of them: whether a tag that reads it outside of quotes is closed
        for m in reversed(list(_SPECIAL.finditer(page))):
            c = m[0]
            out, double, single = (True if c == ">" else double if c == '"' else single), (out if c == '"' else double), (out if c == "'" else single)
            self.at.append(m.start())
            self.closed.append(out)
        self.at.reverse()
        self.closed.reverse()

    def __call__(self, at: int) -> bool:
        """Whether the tag that begins at a place is; places come in order."""
        if self.name_end <= at:
            end = _NAME_END.search(self.page, at + 2)
            self.name_end = end.start() if end else len(self.page)
        k = bisect.bisect_left(self.at, self.name_end)
        return k < len(self.at) and self.closed[k]


def tokens(page: str) -> Iterator[re.Match]:
    """The page's tokens, as _TOKEN matches them, in time that grows with its length alone: a tag that nothing closes is text, and
    once there is one, others are looked up before they are read to the end."""
    at, last, closed = 0, page.rfind(">"), None
    while at < len(page):
        if at > last:
            m = _LAST.match(page, at)
        elif closed and page[at] == "<" and not closed(at):
            m = _LOOSE.match(page, at)
        else:
            m = _TOKEN.match(page, at)
            if m[0] == "<" and closed is None:
                closed = _Closed(page)
        yield m
        at = m.end()


def stream(page: str | None) -> list[tuple]:
    """A page's structural tags, as (symbol,), and blocks of text, as ("", zone, text): zone is -1 aside, 1 in an article, else 0.

    Outside of articles, blocks that are links alone are aside."""
    out, parts, held, aside, main, link, unlinked = [], [], [], 0, 0, 0, False

    def close_text() -> None:
        nonlocal unlinked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(("", -1 if aside else 1 if main else 0 if unlinked else -1, text))
        unlinked = False

    for m in tokens(page or ""):
        name = m[3] if m.re is _TOKEN else None
        if name is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                parts.append(html.unescape(raw) if "&" in raw else raw)
                unlinked = unlinked or not link and not raw.isspace()
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        symbol, zone = _kind(name, m[4] or "") if not m[2] else ("/" + name, 0)
        if name == "a":
            link = not m[2]
        if name in INLINE and not zone:
            if m[2] and held and held[-1][0] == name:  # an inline element that is aside
                close_text()
                aside -= held.pop()[1] < 0
            continue
        close_text()
        if not m[2]:
            out.append((symbol,))
            if name not in VOID and (zone or name not in OPEN_ENDED):
                held.append((name, zone))
                aside, main = aside + (zone < 0), main + (zone > 0)
        elif any(n == name for n, _ in held):
            while True:
                n, zone = held.pop()
                aside, main = aside - (zone < 0), main - (zone > 0)
                if n == name:
                    break
            if name not in OPEN_ENDED:
                out.append((symbol,))
    close_text()
    return out


# A wrapper is a list of nodes [kind, ...]: ["t", symbol, optional], ["x", zone, text or None, optional, pages that had the text or
# how many did, characters of all pages' texts there], ["+", nodes, optional].


def _shape(node: list) -> tuple:
    return ("+", *map(_shape, node[1])) if node[0] == "+" else tuple(node[:2])


def fold(nodes: list[list]) -> list[list]:
    """nodes with runs of equal blocks as repeated groups, the shortest blocks first, and again while that changes anything."""
    while True:
        shapes, out, i, changed = [_shape(n) for n in nodes], [], 0, False
        while i < len(nodes):
            for k in range(1, min(LONGEST_BLOCK, (len(nodes) - i) // 2) + 1):
                times = 1
                while shapes[i : i + k] == shapes[i + times * k : i + (times + 1) * k]:
                    times += 1
                if times > 1 and not (k == 1 and nodes[i][0] != "t"):
                    block = nodes[i : i + k]
                    for t in range(1, times):
                        block = [_merged(a, b) for a, b in zip(block, nodes[i + t * k : i + (t + 1) * k], strict=True)]
                    out.append(["+", block, False])
                    i, changed = i + times * k, True
                    break
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
        if not changed:
            return nodes


def of_page(tokens: list[tuple], groups: set[tuple] = frozenset(), pages: list[int] = ()) -> list[list]:
    """A page's own wrapper, or that of `pages` of one shape; single blocks of a shape in `groups` are repeated groups too."""
    nodes = fold([["x", t[1], t[2], False, [] if t[2] is None else list(pages), t[3] if len(t) > 3 else len(t[2])] if t[0] == "" else ["t", t[0], False] for t in tokens])
    for g in sorted(groups, key=len, reverse=True):
        i = 0
        while i + len(g) <= len(nodes):
            if tuple(map(_shape, nodes[i : i + len(g)])) == g:
                nodes[i : i + len(g)] = [["+", nodes[i : i + len(g)], False]]
            i += 1
    return nodes


def _least(pages: set[int]) -> list[int]:
    return sorted(pages)[:SAMPLED]


def _optional(node: list) -> bool:
    return node[3] if node[0] == "x" else node[2]


def _as_option(node: list) -> list:
    at = 3 if node[0] == "x" else 2
    return [*node[:at], True, *node[at + 1 :]]


def _merged(a: list, b: list) -> list:
    """Two nodes of one kind as one."""
    if a[0] == "t":
        return ["t", a[1], a[2] or b[2]]
    if a[0] == "x":
        same = a[2] is not None and a[2] == b[2]
        return ["x", a[1], a[2] if same else None, a[3] or b[3], _least({*a[4], *b[4]}) if same else [], a[5] + b[5]]
    return ["+", align(a[1], b[1]), a[2] or b[2]]


def _key(node: list) -> tuple:
    return ("+", _key(node[1][0])) if node[0] == "+" else tuple(node[:2])


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of a with every start of b."""
    best = np.zeros(len(b) + 1, np.int32)
    for x in a:
        best[1:] = np.maximum.accumulate(np.where(b == x, best[:-1] + 1, best[1:]))
    return best


def _common(a: np.ndarray, b: np.ndarray, i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Tables larger than TABLE_CELLS are halved, so that space grows with the lengths
    alone, and time with their product, a row of it at once."""
    same = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:same] == b[:same], False)))
    start = [(i + k, j + k) for k in range(head)]
    a, b, i, j, same = a[head:], b[head:], i + head, j + head, same - head
    tail = int(np.argmin(np.append(a[len(a) - same :][::-1] == b[len(b) - same :][::-1], False)))
    end = [(i + len(a) - tail + k, j + len(b) - tail + k) for k in range(tail)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return start + end
    if len(a) > 1 and len(a) * len(b) > TABLE_CELLS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return start + _common(a[:half], b[:cut], i, j) + _common(a[half:], b[cut:], i + half, j + cut) + end
    rows = [np.zeros(len(b) + 1, np.int32)]
    for x in a[::-1]:
        last = rows[-1]
        rows.append(np.append(np.maximum.accumulate(np.where(b == x, last[1:] + 1, last[:-1])[::-1])[::-1], 0))
    best, x, y, found = [r.tolist() for r in rows[::-1]], 0, 0, []
    while x < len(a) and y < len(b):
        if a[x] == b[y]:
            found.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return start + found + end


def align(a: list[list], b: list[list]) -> list[list]:
    """The least general common wrapper along a longest common subsequence; nodes of one side alone become optional."""
    numbers: dict[tuple, int] = {}
    ka, kb = (np.array([numbers.setdefault(_key(n), len(numbers)) for n in x], np.int64) for x in (a, b))
    out, i, j = [], 0, 0
    for x, y in [*_common(ka, kb), (len(a), len(b))]:
        out += [_as_option(n) for n in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _groups(nodes: list[list]) -> set[tuple]:
    return {x for n in nodes if n[0] == "+" for x in ({tuple(map(_shape, n[1]))} | _groups(n[1]))}


def _page(tokens: list[tuple]) -> int | None:
    """A page's number: a hash of its texts that aren't aside, so that copies with other advertisements are one page; None
    without any."""
    texts = [t[2] for t in tokens if t[0] == "" and t[1] >= 0]
    return int.from_bytes(hashlib.blake2b("\0".join(texts).encode("utf-8", "replace"), digest_size=6).digest(), "big") if texts else None


def _limit(nodes: list[list], last: int) -> None:
    """Leaves those pages of slots that are not beyond the last sampled one."""
    for n in nodes:
        if n[0] == "x":
            n[4] = [p for p in n[4] if p <= last]
        elif n[0] == "+":
            _limit(n[1], last)


class Inference:
    """A host's wrapper as pages come: `nodes`, and `pages`, a sample of its different pages that copies don't change; without
    `sampled` no pages, for counted() to count all.

    Pages of one shape are held together, each compared with those before it text by text, until they are aligned."""

    def __init__(self, sampled: bool = True):
        self.aligned, self.pages, self.groups, self.sampled = None, [], set(), sampled
        self.held: dict[tuple, tuple[list, list, set]] = {}

    @property
    def nodes(self) -> list[list] | None:
        self.settle()
        return self.aligned

    @property
    def n(self) -> int:
        """How many different pages the wrapper's slots are counted over."""
        self.settle()
        return len(self.pages)

    def add(self, tokens: list[tuple]) -> int:
        """How many tokens more are held."""
        page, shape = _page(tokens) if self.sampled else None, tuple(t[:2] for t in tokens)
        texts, chars, pages = self.held.get(shape) or (None, None, set())
        if page is not None:
            pages.add(page)
        if len(pages) > 4 * SAMPLED:
            least = _least(pages)
            pages.clear()
            pages.update(least)
        if texts is None:
            self.held[shape] = [t[2] if t[0] == "" else None for t in tokens], [len(t[2]) if t[0] == "" else 0 for t in tokens], pages
            return len(tokens)
        for i, t in enumerate(tokens):
            if t[0] == "":
                chars[i] += len(t[2])
                if texts[i] is not None and texts[i] != t[2]:
                    texts[i] = None
        return 0

    def settle(self) -> None:
        """Aligns the pages that are held."""
        held, self.held = self.held, {}
        for shape, (texts, chars, pages) in held.items():
            least = _least(pages)
            self.merge(of_page([(*t, x, n) if t[0] == "" else t for t, x, n in zip(shape, texts, chars, strict=True)], self.groups, least), least)

    def merge(self, nodes: list[list], pages: list[int]) -> None:
        self.aligned = nodes if self.aligned is None else align(self.aligned, nodes)
        self.groups |= _groups(nodes)
        self.pages = _least({*self.pages, *pages})
        if len(self.pages) == SAMPLED:
            _limit(self.aligned, self.pages[-1])

    def dumps(self) -> str:
        self.settle()
        return json.dumps([self.pages, self.aligned], separators=(",", ":"))


def slots(nodes: list[list]) -> Iterator[list]:
    """A wrapper's slots, in order."""
    for x in nodes:
        if x[0] == "x":
            yield x
        elif x[0] == "+":
            yield from slots(x[1])


def match(nodes: list[list], tokens: list[tuple], at: int, taken: list) -> int | None:
    """The place after what nodes read from tokens[at:], adding (slot, text); None if they can't."""
    for node in nodes:
        if node[0] == "+":
            times = 0
            while (end := match(node[1], tokens, at, own := [])) is not None and end > at:
                taken += own
                at, times = end, times + 1
            if not times and not _optional(node):
                return None
        elif at < len(tokens) and (tokens[at][0] == node[1] if node[0] == "t" else tokens[at][:2] == ("", node[1])):
            if node[0] == "x":
                taken.append((node, tokens[at][2]))
            at += 1
        elif not _optional(node):
            return None
    return at


class Reader:
    """Tells which of a wrapper's slots with one text a page has with it, by their numbers among its slots."""

    def __init__(self, nodes: list[list]):
        self.nodes = nodes
        self.numbers = {id(x): i for i, x in enumerate(slots(nodes)) if x[2] is not None}
        self.texts: dict[tuple, list[int]] = {}
        for i, x in enumerate(slots(nodes)):
            if x[2] is not None:
                self.texts.setdefault((x[1], x[2]), []).append(i)

    def __call__(self, tokens: list[tuple]) -> list[int]:
        """As the wrapper matches the page; if it doesn't, all slots whose text the page has in their zone."""
        taken: list = []
        if match(self.nodes, tokens, 0, taken) == len(tokens):
            return sorted({self.numbers[id(x)] for x, text in taken if x[2] == text})
        return sorted({i for t in tokens if t[0] == "" for i in self.texts.get((t[1], t[2]), ())})


class Extractor:
    """Reads a host's pages by its wrapper."""

    def __init__(self, n: int, nodes: list[list]):
        self.n, self.nodes = n, nodes
        self.article = self._article(nodes or [])
        self.hosts = {tuple(x[1:3]): x for x in slots(nodes or []) if self.is_host_text(x, x[2])}

    def is_host_text(self, slot: list, text: str) -> bool:
        """Whether a slot's text is the same on nearly all of the host's different pages, of which there have to be some."""
        having = slot[4] if isinstance(slot[4], int) else len(slot[4])
        return text is not None and text == slot[2] and self.n >= FEWEST and having >= NEARLY_ALL * self.n

    def _article(self, nodes: list[list]) -> set[int]:
        """The slots (by identity) of the article, as the wrapper alone tells: of the innermost element that has MOST_TEXT of
        the changing text which isn't aside, and of headings before it; from the first main heading on, if there is one. Where
        that element's slots are marked as an article, all of them."""
        slots: list[tuple[list, tuple]] = []
        open_: list[tuple[int, str]] = []
        numbers = iter(range(1 << 62))

        def walk(nodes: list[list]) -> None:
            for x in nodes:
                if x[0] == "+":
                    walk(x[1])
                elif x[0] == "x":
                    slots.append((x, tuple(open_)))
                elif x[1].startswith("/"):
                    while any(name == x[1][1:] for _, name in open_) and open_.pop()[1] != x[1][1:]:
                        pass
                elif (name := x[1].partition(".")[0]) not in VOID | OPEN_ENDED | INLINE:
                    open_.append((next(numbers), name))

        walk(nodes)
        held = [(x, path) for x, path in slots if x[1] >= 0 and not self.is_host_text(x, x[2])]
        mass: dict[int, int] = {}
        for x, path in held:
            for number, name in path:
                mass[number] = mass.get(number, 0) + x[5] * (name not in HEADINGS)
        enough = MOST_TEXT * sum(x[5] for x, _ in held)  # a heading holds no article
        tell = self.n >= FEWEST  # of fewer pages all that isn't aside is taken
        inner = max((number for number, m in mass.items() if tell and m and m >= enough), default=None)  # numbers rise inwards
        within = [inner is None or any(number == inner for number, _ in path) for _, path in held]
        first = within.index(True) if True in within else 0
        heads = [bool(path) and path[-1][1] in HEADINGS for _, path in held]
        main = next((k for k, (_, path) in enumerate(held) if tell and path and path[-1][1] == "h1" and (within[k] or k < first)), None)
        marked = {id(x) for x, path in slots if x[1] == 1 and inner is not None and any(number == inner for number, _ in path)}
        return marked | {id(x) for k, (x, _) in enumerate(held) if (within[k] or heads[k] and k < first) and (main is None or k >= main)}

    def holds_article(self, slot: list, text: str, marked: bool, matched: bool) -> bool:
        """Whether a slot's text is part of the main text: not the host's, and within the article that the wrapper tells; on hosts
        with fewer than FEWEST different pages, which tell too little, and on pages that the wrapper doesn't match, within the
        one that the page marks, if it does."""
        tells = matched and self.n >= FEWEST or not marked
        return (slot[1] >= 0 and id(slot) in self.article if tells else slot[1] == 1) and not self.is_host_text(slot, text)

    def text(self, page: str | None) -> str:
        tokens = stream(page)
        marked = any(t[:2] == ("", 1) for t in tokens)
        taken: list = []
        if match(self.nodes, tokens, 0, taken) == len(tokens):
            return " ".join(t for slot, t in taken if self.holds_article(slot, t, marked, True))
        # The wrapper's choices, made one at a time, didn't lead through: the page is its own wrapper, and texts are the host's if
        # one of its slots says so.
        own, alone = self.hosts, Extractor(self.n, of_page(tokens))
        return " ".join(t for slot, t in alone.read(tokens) if alone.holds_article(slot, t, marked, False) and (slot[1], t) not in own)

    def read(self, tokens: list[tuple]) -> list[tuple[list, str]]:
        """(slot, text) of a page's texts by its own wrapper."""
        taken: list = []
        match(self.nodes, tokens, 0, taken)
        return taken


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host of pages (url, html); which pages have a slot's text, counted() says."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        found: dict[str, Inference] = {}
        held = 0
        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                held += found.setdefault(name, Inference(sampled=False)).add(stream(page))
                if held > HELD_TOKENS:
                    for x in found.values():
                        x.settle()
                    held = 0
            if len(found) > 2000:  # what a task holds doesn't grow with the hosts
                yield rows(found)
                found = {}
        if found:
            yield rows(found)

    def rows(found: dict[str, Inference]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.dumps() for x in found.values()], pa.string())], names=["host", "wrapper"])

    def together(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Inference(sampled=False)
        for batch in batches:
            for x in sorted(batch.column("wrapper").to_pylist()):
                pages, nodes = json.loads(x)
                own.merge(nodes, pages)
        yield rows({key[0].as_py(): own})

    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(partial, "host string, wrapper string")
    some = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "salt").applyInArrow(together, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(together, "host string, wrapper string")


def _known(pages: DataFrame, wrappers: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[str]]]:
    """pages, and what gives the wrappers (as JSON) of a batch of them."""
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if size > BROADCAST_BYTES:  # too many hosts to hold: each page gets its wrapper by a join
        return pages.join(wrappers, "host", "left"), lambda batch: batch.column("wrapper").to_pylist()
    known = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
    return pages, lambda batch: [known.value.get(h) for h in batch.column("host").to_pylist()]


def counted(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """wrappers (host, wrapper) with the numbers of the host's different pages, and of those with a slot's text, over all of pages
    (host, html). A page has a text if one of its copies does."""
    kept, given = _known(pages.select("host", "html"), wrappers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Reader] = {}
        for batch in batches:
            out: dict[tuple, None] = {}
            if len(ready) > 2000:
                ready = {}
            for h, wrapper, page in zip(batch.column("host").to_pylist(), given(batch), batch.column("html").to_pylist(), strict=True):
                if h not in ready:
                    ready[h] = Reader(json.loads(wrapper)[1])
                tokens = stream(page)
                if (number := _page(tokens)) is not None:
                    out[h, number, tuple(ready[h](tokens))] = None
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.list_(pa.int32())))], names=["host", "page", "slots"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wrapper, numbers in zip(batch.column("wrapper").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                nodes, having = json.loads(wrapper)[1], {x["slot"]: x["n"] for x in numbers or ()}
                for i, x in enumerate(slots(nodes)):
                    x[4] = having.get(i, 0)
                out.append(json.dumps([having.get(-1, 0), nodes], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], names=["host", "wrapper"])

    found = kept.mapInArrow(read, "host string, page long, slots array<int>")
    each = found.groupBy("host", "page").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("slots")))).alias("slots"))
    alike = each.groupBy("host", "slots").count()  # pages of a host with the same slots
    numbers = alike.withColumn("slot", F.explode(F.concat(F.array(F.lit(-1)), "slots"))).groupBy("host", "slot").agg(F.sum("count").alias("n"))
    of_host = numbers.groupBy("host").agg(F.collect_list(F.struct("slot", "n")).alias("numbers"))
    return wrappers.join(of_host, "host", "left").mapInArrow(fill, "host string, wrapper string")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page of pages (page_id, url, html). Null or empty html gives an empty text; pages without
    a host in their URL are one host together; repeated rows are pages of their own."""
    kept = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    kept, given = _known(kept, written(counted(kept, written(infer(pages), "wrappers")), "counted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Extractor] = {}
        for batch in batches:
            texts = []
            if len(ready) > 2000:
                ready = {}
            for h, wrapper, page in zip(batch.column("host").to_pylist(), given(batch), batch.column("html").to_pylist(), strict=True):
                if h not in ready:
                    ready[h] = Extractor(*json.loads(wrapper))
                texts.append(ready[h].text(page))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null or empty html gives an empty text, tags that nothing closes are text, long pages are read
    whole, and rows that repeat are pages of their own; other columns play no part."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
