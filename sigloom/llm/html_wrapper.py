"""Main text of web pages by union-free regular-expression wrappers.

A page is a stream of tags and texts. For each host a wrapper is inferred from all of its pages: elements become groups
and neighbours that begin alike one repeated group, then streams are aligned one after the other; what one side lacks
becomes an optional group, texts become slots, and neighbours are folded again after each alignment. Slots know the elements that hold them, and the
text that is the same on all pages. Pages are then read along the wrapper, and a slot is template only if no page has another
text there. A page of the host is read along its wrapper; where it leaves the wrapper, its own elements decide.

A slot knows whether it is in the article or main element, apart, or neither, and a text has the place of its slot; where
pages of a host differ in that, a text takes the next slot of its own place, if its element has one. Main text is what fills slots in the article or main element, or, on a page that has none, the slots whose text
varies outside all else; never menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and
reader comments, which are known by element, role, or a name in class or id. A name counts if all its words say so (site-header,
ad_box); one that also says something else (side-note, market-share) does not. Character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined by line feeds in page order.

Pages of a host that fold to the same groups are one shape, which is aligned once. Shapes are dealt by hash to units of about
`FAN`, aligned in the order of their text, then so many units to one, and so on; so a host of many shapes takes many tasks, and
the wrapper depends on the set of pages, not on their order or partitions. Every page is aligned and extracted whole. Elements
within `DEEP` others stay tokens.

Defined cases: null html is empty and has an empty text; pages without an address form one host; markup that is cut off or
badly nested is read as far as it goes, a cut-off tag is dropped; equal pages get equal texts; pages that repeat an id
are all extracted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, extended, written

#: Shapes or wrappers that one task aligns, on average.
FAN = 32
#: Characters of shapes that a task holds before it hands them on.
HELD = 1 << 24
DEEP = 100
#: Rows of an alignment's table between those that are kept; others are worked out again.
STEP = 256
TEXT = "#"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|svg|iframe|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z\[](?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)|<[/!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names of HTML by what they mean here, and words in class and id that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
APART = frozenset("nav footer aside form button dialog menu header head".split())
MAIN = frozenset("article main".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
APART_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu topbar sidebar side rail widget footer header masthead breadcrumb breadcrumbs cookie cookies consent notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond discussion disqus pagination pager toolbar".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
#: Words that say where or how something is laid out, and nothing of what it is.
LAYOUT_WORDS = frozenset("site page global main content inner outer wrapper wrap container box block section area region zone slot unit bar strip panel column col row grid left right top bottom upper lower sticky fixed float list lists item items link links button buttons icon icons menu text title label holder group list thread form feed the a my js is has show hidden desktop mobile small large big wide narrow default primary secondary post posts article articles story stories entry google dfp mpu leaderboard skyscraper rectangle".split())

Node = list  # ["T", tag] | ["S", text or None, place] | ["G", how often (1 ? + *), nodes]


def stream(html: str | None) -> list[tuple[str, str, str]]:
    """(kind, name, detail): kind is +, - or #; of an opening tag the detail is what its attributes mean, of a text the text.
    Scripts, styles, comments and the like leave no trace."""
    out = []
    for m in _TOKEN.finditer(html or ""):
        token = m[0]
        if token[0] != "<" or token == "<":
            if out and out[-1][0] == TEXT:
                out[-1] = (TEXT, "", out[-1][2] + token)
            else:
                out.append((TEXT, "", token))
        elif m[1] is None and token[-1] == ">" and (name := _NAME.match(token)):
            name = name[1].lower()
            if token[1] == "/":
                out.append(("-", name, ""))
            else:
                out.append(("+", name, meaning(name, token)))
    return out


@lru_cache(maxsize=4096)
def named(value: str) -> frozenset[str]:
    """The telling words of a class or id: those of names that hold nothing but such words, words of layout and numbers."""
    found: set[str] = set()
    for name in value.split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words <= APART_WORDS | LAYOUT_WORDS:
            found |= words & APART_WORDS
    return frozenset(found)


def meaning(name: str, tag: str) -> str:
    """main, apart, comments or nothing, by element, role and the words of class and id."""
    role, words, prop = "", set(), ""
    if "=" in tag:
        for m in _ATTRIBUTE.finditer(tag):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                role = value
            elif key == "itemprop":
                prop = value
            elif key in ("class", "id"):
                words |= named(value)
            elif value == "true" or key == "hidden":
                return "apart"
    if words & COMMENT_WORDS:
        return "comments"
    if name in MAIN or role == "main" or prop == "articlebody":
        return "main" if not words & APART_WORDS else "apart"
    return "apart" if name in APART or role in APART_ROLES or words & APART_WORDS and name not in ("body", "html") else ""


class Context:
    """The open elements; says where a text stands: main, rest, or nothing if it is apart."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str]] = []

    def take(self, kind: str, name: str, detail: str) -> None:
        if kind == "+" and name not in VOID and (name not in INLINE or detail):
            if detail == "main" and all(d != "comments" for _, d in self.open):
                self.open = [x for x in self.open if x[1] != "apart"]  # left open before the main part
            elif name == "header" and any(d == "main" for _, d in self.open):
                detail = ""  # an article's own heading
            self.open.append((name, detail))
        elif kind == "-":
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == name:
                    del self.open[k:]
                    break

    def place(self) -> str:
        kinds = {d for _, d in self.open}
        return "" if kinds & {"apart", "comments"} else "main" if "main" in kinds else "rest"


# Inference


def tag_of(token: tuple[str, str, str]) -> str:
    return token[0] + token[1] + ("." + token[2] if token[2] else "")


def shaped(tokens: list[tuple[str, str, str]]) -> list[Node]:
    context, nodes = Context(), []
    for token in tokens:
        if token[0] == TEXT:
            if text := " ".join(unescape(token[2]).split()):
                nodes.append(["S", text, context.place()])
        else:
            context.take(*token)
            nodes.append(["T", tag_of(token)])
    return nodes


def first_of(node: Node) -> object:
    """What decides whether nodes stand for each other: a tag, a slot's place, or how a group begins."""
    return ("S", node[2]) if node[0] == "S" else ("T", node[1]) if node[0] == "T" else ("G", first_of(node[2][0]))


def grouped(nodes: list[Node], depth: int = 0) -> list[Node]:
    """Elements become groups, from an opening tag to its end, to the next of its kind or to where its parent ends;
    neighbours that begin alike become one repeated group."""
    if depth == DEEP:
        return nodes
    out: list[Node] = []
    k = 0
    while k < len(nodes):
        node = nodes[k]
        if node[0] != "T" or node[1][0] != "+" or (name := node[1][1:].partition(".")[0]) in VOID:
            out.append(node)
            k += 1
            continue
        inner, count, to = [name], Counter([name]), k + 1
        while to < len(nodes):
            if nodes[to][0] == "T":
                sign, other = nodes[to][1][0], nodes[to][1][1:].partition(".")[0]
                if sign == "-" and not count[other] and other not in INLINE or nodes[to][1] == node[1] and inner == [name]:
                    break
                if sign == "-" and count[other]:
                    closed = None
                    while closed != other:
                        count[closed := inner.pop()] -= 1
                    if not inner:
                        to += 1
                        break
                elif sign == "+" and other not in VOID and other not in INLINE:
                    inner.append(other)
                    count[other] += 1
            to += 1
        out.append(["G", "1", [node, *grouped(nodes[k + 1 : to], depth + 1)]])
        k = to
    return repeated(out)


def repeated(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for node in nodes:
        if out and node[0] == out[-1][0] == "G" and first_of(node) == first_of(out[-1]):
            some = "+" if "1" in (q := node[1] + out[-1][1]) or "+" in q else "*"
            out[-1] = ["G", some, aligned(out[-1][2], node[2])]
        else:
            out.append(node)
    return out


def _both(a: Node, b: Node) -> Node:
    """A node for two that stand for each other."""
    if a[0] == "S":
        return ["S", a[1] if a[1] == b[1] else None, a[2]]
    if a[0] == "T":
        return a
    many, none = bool(set("+*") & {a[1], b[1]}), bool(set("?*") & {a[1], b[1]})
    return ["G", "*" if many and none else "+" if many else "?" if none else "1", aligned(a[2], b[2])]


def _optional(node: Node) -> Node:
    if node[0] == "S":
        return ["S", None, node[2]]  # a slot may be empty anyway, but its text is not on all pages
    return ["G", "?", [node]] if node[0] == "T" else ["G", {"1": "?", "+": "*"}.get(node[1], node[1]), node[2]]


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """The least general wrapper of both: what they share, and optional groups for what one of them lacks.

    The longest common sequence is found by bits: of row i, the zeros in the lowest m - j bits count what a[i:] and b[j:]
    share. Every `STEP`-th row is kept, so long lists take little memory."""
    n, m = len(a), len(b)
    x, y = [first_of(v) for v in a], [first_of(v) for v in b]
    masks: dict[object, int] = {}
    for j in range(m):
        masks[y[j]] = masks.get(y[j], 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1

    def before(row: int, i: int) -> int:
        both = row & masks.get(x[i], 0)
        return (row + both | row - both) & full

    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = before(row, i)
        if i % STEP == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def best(i: int, j: int) -> int:
        nonlocal rows
        if i not in rows:
            low, top = min(i, n - 1) // STEP * STEP, min(n, (min(i, n - 1) // STEP + 1) * STEP)
            rows = {top: kept[top]}
            for k in range(top - 1, low - 1, -1):
                rows[k] = before(rows[k + 1], k)
        return m - j - (rows[i] & (1 << (m - j)) - 1).bit_count()

    out: list[Node] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(_both(a[i], b[j]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best(i, j + 1) <= best(i + 1, j)):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return repeated(out)


def infer(pages: list[str | None]) -> list[Node]:
    """The wrapper of pages, aligned in their order."""
    wrapper: list[Node] | None = None
    for html in pages:
        sample = grouped(shaped(stream(html)))
        wrapper = sample if wrapper is None else aligned(wrapper, sample)
    return wrapper or []


def sketched(nodes: list[Node]) -> tuple[str, list[str | None]]:
    """The shape of a wrapper or page (JSON without texts), and for each slot what its text hashes to, if it could be template:
    outside main and apart, optional and repeated groups."""
    texts: list[str | None] = []

    def bare(nodes: list[Node], once: bool) -> list[Node]:
        out = []
        for node in nodes:
            if node[0] == "S":
                texts.append(node[1] if once and node[2] == "rest" else None)
                out.append(["S", None, node[2]])
            else:
                out.append(node if node[0] == "T" else [*node[:2], bare(node[2], once and node[1] == "1")])
        return out

    return json.dumps(bare(nodes, True), separators=(",", ":")), texts


def unsketched(shape: str, texts: list[str | None]) -> list[Node]:
    rest = iter(texts)

    def fill(nodes: list[Node]) -> list[Node]:
        return [["S", next(rest), n[2]] if n[0] == "S" else n if n[0] == "T" else [*n[:2], fill(n[2])] for n in nodes]

    return fill(json.loads(shape))


class Sketches:
    """Sketches of pages. A slot that could be template holds one text of the page, because what is folded is repeated; so
    pages of equal tags and places have equal shapes, and which text is in which slot is worked out once for them."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, ...], tuple[str, list[int | None]]] = {}
        self.weight = 0

    def of(self, html: str | None) -> tuple[str, list[str | None]]:
        nodes = shaped(stream(html))
        key = tuple(n[1] if n[0] == "T" else TEXT + n[2] for n in nodes)
        if key not in self.known:
            shape, texts = sketched(grouped([["S", str(k), n[2]] if n[0] == "S" else n for k, n in enumerate(nodes)]))
            self.weight += len(key) + len(shape) // 8
            if self.weight > HELD // 16:
                self.known, self.weight = {}, len(key) + len(shape) // 8
            self.known[key] = shape, [None if k is None else int(k) for k in texts]
        shape, texts = self.known[key]
        return shape, [None if k is None else _hash(nodes[k][1]) for k in texts]


# Extraction


def places(tokens: list[tuple[str, str, str]]) -> list[str]:
    """The place that a page's own elements give each text."""
    context, out = Context(), []
    for token in tokens:
        if token[0] != TEXT:
            context.take(*token)
        out.append(context.place() if token[0] == TEXT else "")
    return out


def along(nodes: list[Node], tokens: list[tuple[str, str, str]], at: int, slots: dict[int, Node], own: list[str] | None = None) -> tuple[int, bool]:
    """Read tokens along a wrapper from `at`; fills in the slot of each text, returns where it ends and whether it fits. With
    the texts' own places, a slot of another place leaves a text to a later one of its place among its neighbours."""
    for k, node in enumerate(nodes):
        while at < len(tokens) and tokens[at][0] == TEXT and not tokens[at][2].strip():
            at += 1
        if node[0] == "S":
            if at < len(tokens) and tokens[at][0] == TEXT and (own is None or node[2] == own[at] or all(n[0] != "S" or n[2] != own[at] for n in nodes[k + 1 :])):
                slots[at] = node
                at += 1
        elif node[0] == "T":
            if at >= len(tokens) or tag_of(tokens[at]) != node[1]:
                return at, False
            at += 1
        else:
            times = 0
            while at < len(tokens) and (not times or node[1] in "+*"):
                found: dict[int, Node] = {}
                to, fits = along(node[2], tokens, at, found, own)
                if not fits or to == at:
                    if not times and node[1] in "1+":
                        slots |= found
                        return to, False
                    break
                slots |= found
                at, times = to, times + 1
    return at, True


def has_main(tokens: list[tuple[str, str, str]]) -> bool:
    """Whether a page has an article or main element outside reader comments."""
    context = Context()
    for token in tokens:
        if token[0] != TEXT:
            context.take(*token)
            if token[0] == "+" and token[2] == "main" and all(d != "comments" for _, d in context.open):
                return True
    return False


def main_text(html: str | None, wrapper: list[Node]) -> str:
    tokens = stream(html)
    slots: dict[int, Node] = {}
    own = places(tokens)
    along(wrapper, tokens, 0, slots, own)
    by_main = has_main(tokens)
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if text := " ".join(unescape("".join(line)).split()):
            blocks.append(text)
        line.clear()

    for k, token in enumerate(tokens):
        if token[0] == TEXT:
            slot = slots.get(k)
            place = own[k] if slot is None else slot[2]
            if place == "main" or place == "rest" and not by_main and not (slot is not None and len(slot) > 3 and slot[1] == digest(token[2])):
                line.append(token[2])
        else:
            if token[1] == "br":
                line.append(" ")
            elif token[1] not in INLINE:
                close()
    close()
    return "\n".join(blocks)


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def digest(text: str) -> str:
    return _hash(" ".join(unescape(text).split()))


def _fixed(nodes: list[Node], number: int = 0) -> int:
    """Number the slots outside main and apart whose text was the same on all pages, outside optional and repeated
    groups; returns the next number."""
    for node in nodes:
        if node[0] == "S" and node[1] is not None and node[2] == "rest":
            node.append(number)
            number += 1
        elif node[0] == "G" and node[1] == "1":
            number = _fixed(node[2], number)
    return number


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan: int = FAN) -> DataFrame:
    """host and wrapper (JSON), from all pages of the host; `fan` shapes or wrappers on average are aligned by one task."""
    source = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    shapes = source.mapInArrow(_shapes, _SHAPE).repartition("host", "shape").sortWithinPartitions("host", "shape")
    shapes = written(shapes.mapInArrow(_once, _SHAPE), "page-shapes")
    counts = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / fan).alias("units"))
    units = shapes.join(counts, "host").withColumn("unit", F.pmod(F.xxhash64("shape"), F.col("units")))
    left, made = counts.agg(F.max("units")).first()[0] or 1, [shapes]
    while True:
        units = units.select("host", "unit", "shape", "texts", "pages").repartition("host", "unit").sortWithinPartitions("host", "unit", "shape")
        units = units.mapInArrow(_aligned_units, "unit long, " + _SHAPE)
        if left <= 1:
            break
        made.append(written(units, "wrappers-of-units"))
        units, left = made[-1].withColumn("unit", F.floor(F.col("unit") / fan)), -(-left // fan)
    found = written(units.select("host", "shape", "texts", "pages").mapInArrow(_numbered, "host string, wrapper string, fixed long"), "wrappers")
    discard(*made)
    if found.where("fixed > 0").isEmpty():
        return found.select("host", "wrapper")
    varying = written(_varying(pages, found.where("fixed > 0"), url_col, html_col), "varying-slots")
    return written(found.join(varying, "host", "left").select("host", "wrapper", "numbers").mapInArrow(_freed, "host string, wrapper string"), "wrappers")


def _same(a: list[str | None], b: list[str | None]) -> list[str | None]:
    return [x if x == y else None for x, y in zip(a, b, strict=True)]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabytes; the text `shape` is what is large."""
    held, size, at = [], 0, schema.get_field_index("shape")
    for row in rows:
        held.append(row)
        size += len(row[at]) + 100
        if size > HELD // 4:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shapes of pages, a row for each that a task meets until it holds `HELD` characters. `texts` are those that all its
    pages share, `pages` the least three hashes of different pages."""

    def rows() -> Iterator[tuple]:
        known: dict[tuple[str, str], tuple[list[str | None], list[str]]] = {}
        weight, sketches = 0, Sketches()
        for host, html in _rows(batches):
            shape, texts = sketches.of(html)
            page = [_hash(html or "")]
            if (old := known.get((host, shape))) is None:
                weight += len(shape) + 100 * (1 + len(texts))
                known[host, shape] = texts, page
            else:
                known[host, shape] = _same(old[0], texts), sorted({*old[1], *page})[:3]
            if weight > HELD:
                yield from ((*k, *v) for k, v in known.items())
                known, weight = {}, 0
        yield from ((*k, *v) for k, v in known.items())

    return _batches(rows(), _SHAPES)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a host and shape, of rows sorted by both."""

    def rows() -> Iterator[tuple]:
        last = None
        for row in _rows(batches):
            if last is not None and last[:2] == row[:2]:
                row = (*row[:2], _same(last[2], row[2]), sorted({*last[3], *row[3]})[:3])
            elif last is not None:
                yield last
            last = row
        if last is not None:
            yield last

    return _batches(rows(), _SHAPES)


def _aligned_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each unit, of rows sorted by host, unit and shape."""

    def rows() -> Iterator[tuple]:
        key, wrapper, seen = None, [], []
        for host, unit, shape, texts, pages in _rows(batches):
            if key == (unit, host):
                wrapper, seen = aligned(wrapper, unsketched(shape, texts)), sorted({*seen, *pages})[:3]
                continue
            if key is not None:
                yield *key, *sketched(wrapper), seen
            key, wrapper, seen = (unit, host), unsketched(shape, texts), pages
        if key is not None:
            yield *key, *sketched(wrapper), seen

    return _batches(rows(), _UNITS)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, wrapper (JSON) and how many of its slots have the same text on all pages; none if the host has less than three
    different pages."""
    for batch in batches:
        out = []
        for host, shape, texts, pages in _rows([batch]):
            wrapper = unsketched(shape, texts)
            fixed = _fixed(wrapper) if len(pages) >= 3 else 0
            out.append({"host": host, "wrapper": json.dumps(_stored(wrapper)), "fixed": fixed})
        yield pa.RecordBatch.from_pylist(out, _WRAPPERS)


def _packed(found: DataFrame) -> DataFrame:
    """host and wrapper, compressed, because it goes with each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(w.encode()) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["host", "wrapper"])

    return found.select("host", "wrapper").mapInArrow(run, "host string, wrapper binary")


class Parsed:
    """Wrappers that a task has unpacked, up to a few million characters of them."""

    def __init__(self) -> None:
        self.known: dict[bytes, list[Node]] = {}
        self.weight = 0

    def of(self, packed: bytes | None) -> list[Node]:
        if packed is None:
            return []
        if packed not in self.known:
            text = zlib.decompress(packed)
            self.weight += len(text)
            if self.weight > HELD // 4:
                self.known, self.weight = {}, len(text)
            self.known[packed] = json.loads(text)
        return self.known[packed]


def _varying(pages: DataFrame, found: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host and the numbers of its fixed slots in which some page has another text. A task tells of a slot once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[str, int]] = set()
        parsed = Parsed()
        for batch in batches:
            new: set[tuple[str, int]] = set()
            for host, html, wrapper in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens, slots = stream(html), {}
                along(parsed.of(wrapper), tokens, 0, slots, places(tokens))
                new |= {(host, n[3]) for at, n in slots.items() if len(n) > 3 and (host, n[3]) not in told and digest(tokens[at][2]) != n[1]}
            told = (told if len(told) < 100_000 else set()) | new
            yield pa.RecordBatch.from_pylist([{"host": h, "number": n} for h, n in new], _NUMBERS)

    each = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).join(_packed(found), "host").select("host", "html", "wrapper")
    return each.mapInArrow(run, "host string, number long").groupBy("host").agg(F.collect_set("number").alias("numbers"))


def _freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers whose slots `numbers` are no longer fixed."""

    def free(nodes: list[Node], numbers: set[int]) -> list[Node]:
        return [(["S", None, n[2]] if len(n) > 3 and n[3] in numbers else n) if n[0] == "S" else n if n[0] == "T" else [*n[:2], free(n[2], numbers)] for n in nodes]

    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        yield pa.RecordBatch.from_pylist([{"host": h, "wrapper": json.dumps(free(json.loads(w), set(numbers))) if numbers else w} for h, w, numbers in rows], _FREED)


def _stored(nodes: list[Node]) -> list[Node]:
    return [["S", n[1] if len(n) > 3 else None, n[2], *n[3:]] if n[0] == "S" else n if n[0] == "T" else [*n[:2], _stored(n[2])] for n in nodes]


_SHAPE = "host string, shape string, texts array<string>, pages array<string>"
_SHAPES = pa.schema([("host", pa.string()), ("shape", pa.string()), ("texts", pa.list_(pa.string())), ("pages", pa.list_(pa.string()))])
_UNITS = pa.schema([("unit", pa.int64()), *_SHAPES])
_WRAPPERS = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("fixed", pa.int64())])
_FREED = pa.schema([("host", pa.string()), ("wrapper", pa.string())])
_NUMBERS = pa.schema([("host", pa.string()), ("number", pa.int64())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = _packed(wrappers(pages, url_col, html_col))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    joined = source.join(found, "host", "left").select("page_id", "url", "html", "wrapper")
    schema = extended(joined.select("page_id", "url").schema, "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = Parsed()
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(main_text(html, parsed.of(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
