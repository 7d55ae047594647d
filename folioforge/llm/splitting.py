"""Splitting oversized texts at natural boundaries, by packing a structure tree.

A text is parsed into a tree: sections by the depth of their headings, elements of markup from their opening to their
closing tags, paragraphs, and list items with the items below them. Only a node that is larger than the limit is
descended into; then siblings merge bottom-up, the two neighbours that are smallest together first, up to the limit. A
leaf that is too large is cut at lines, sentences, clauses, words, and at last characters, by the same merging.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 500
DEFAULT_OVERLAP = 100

_HASH = re.compile(r"^(#{1,6})[ \t]+\S", re.M)
_UNDERLINED = re.compile(r"^(?=[^\n]*\S)[^\n]++\n(={3,}|-{3,})[ \t]*$", re.M)
_NUMBERED = re.compile(r"(?:\A|(?<=\n))(\d{1,3}(?:\.\d{1,3}){0,5})\.?[ \t]+[^\W\d_][^\n]{0,100}(?<![.!?;:,\n])(?=\n|\Z)")
_TAG_HEADING = re.compile(r"<h([1-6])\b", re.I)
_TAG = re.compile(r"<(/?)(p|div|section|article|main|ul|ol|dl|table|tbody|blockquote|pre|li|tr|h[1-6])\b[^<>]{0,1000}>", re.I)
_ANY_TAG = re.compile(r"<[^<>]{0,1000}>")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•–]|\d{1,3}[.)]|[a-z][.)])[ \t]+\S")
#: Levels of nesting that are told apart; what is nested deeper belongs to the last of them.
DEPTH = 40
_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"(?<![.!?…])[.!?…]++[\"'»”’)\]]*\s+(?=[\"'«“‘(\[¿¡]*[^\W\d_a-z])|[。！？]+\s*")
_CLAUSE = re.compile(r"[;:,][\"'»”]*\s+|\s[–—-]\s")
_WORD = re.compile(r"\s+")
#: Abbreviations that don't end a sentence.
_ABBREVIATIONS = frozenset("al approx art bd bzw ca cap cf dr etc evtl ed eg e.g fig figs gem ggf i.e inc jr mr mrs ms n nr no nos núm p pp pag pág prof s sec sig sr sra st tab usw vgl vol vs z.b d.h".split())


@dataclass
class Node:
    """A span of the text with the nodes that it consists of; a leaf has none."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)


def _headings(text: str) -> list[tuple[int, int]]:
    """Start and depth of every heading."""
    found = {m.start(): len(m[1]) for m in _HASH.finditer(text)}
    found |= {m.start(): 1 if m[1][0] == "=" else 2 for m in _UNDERLINED.finditer(text)}
    found |= {m.start(): int(m[1]) for m in _TAG_HEADING.finditer(text)}
    for m in _NUMBERED.finditer(text):
        found.setdefault(m.start(), 1 + m[1].count("."))
    return sorted(found.items())


def _elements(text: str) -> list[Node]:
    """The outermost elements of block-level markup, each with those within it; what isn't closed ends with its parent."""
    root = Node(0, len(text))
    path: list[tuple[str, Node]] = [("", root)]
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if not m[1]:
            if name in ("p", "li", "tr") and path[-1][0] == name:  # opened again: closed without saying so
                path.pop()[1].end = m.start()
            node = Node(m.start(), path[-1][1].end)
            if len(path) <= DEPTH:
                path[-1][1].children.append(node)
                path.append((name, node))
        elif any(name == open_name for open_name, _ in path[1:]):
            while True:
                open_name, node = path.pop()
                node.end = m.end() if open_name == name else m.start()
                if open_name == name:
                    break
    return root.children


def _lines(text: str, start: int, end: int) -> list[Node]:
    """Paragraphs and list items of a span without markup; an item holds the items that are indented under it."""
    out: list[Node] = []
    path: list[tuple[int, Node]] = []  # open items by indent
    at, blank, fresh = start, True, True
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop + 1
        line = text[at:stop]
        item = _ITEM.match(line)
        if not line.strip():
            blank = True
        elif item:
            indent = len(item[1].expandtabs(4))
            while path and (path[-1][0] >= indent or len(path) >= DEPTH):
                path.pop()
            node = Node(at, end)
            if path:
                parent = path[-1][1]
                if not parent.children:
                    parent.children.append(Node(parent.start, at))  # the item's own text
                parent.children.append(node)
            else:
                out.append(node)
            path.append((indent, node))
            blank, fresh = False, False
        else:
            if path and blank and not line[0].isspace():
                path, fresh = [], True
            if not path and (blank or fresh):
                out.append(Node(at, end))
            blank, fresh = False, False
        at = stop
    return out


def _close(nodes: list[Node], start: int, end: int) -> list[Node]:
    """Siblings that cover a span: each ends where the next begins."""
    if nodes:
        nodes[0].start = start
    for node, stop in zip(nodes, [*(n.start for n in nodes[1:]), end]):
        node.end = stop
        _close(node.children, node.start, stop)
    return nodes


def _blocks(text: str, start: int, end: int, elements: list[Node]) -> list[Node]:
    """Elements, and the paragraphs and items between them."""
    out: list[Node] = []
    at = start

    def gap(a: int, b: int) -> list[Node]:
        # Tags alone go with their neighbours.
        return _lines(text, a, b) if _ANY_TAG.sub("", text[a:b]).strip() else []

    for e in elements:
        out += gap(at, e.start)
        out.append(Node(e.start, e.end, _blocks(text, e.start, e.end, e.children) if e.children else []))
        at = e.end
    return out + gap(at, end)


def parse(text: str) -> Node:
    """The structure tree of a text."""
    elements = _elements(text)
    marks = _headings(text)
    opens = [e.start for e in elements]
    # Headings within an element that holds more than them divide that element, not the text.
    marks = [(x, d) for x, d in marks if not ((k := bisect_right(opens, x) - 1) >= 0 and elements[k].start < x < elements[k].end)]
    root = Node(0, len(text))
    path: list[tuple[int, Node]] = [(0, root)]
    bounds = [x for x, _ in marks] + [len(text)]

    def own(section: Node, start: int, end: int) -> None:
        inside = elements[bisect_left(opens, start) : bisect_left(opens, end)]
        blocks = _blocks(text, start, end, inside)
        # A heading belongs to what follows it.
        if len(blocks) > 1 and section is not root and blocks[0].start == start:
            del blocks[0]
        section.children += blocks

    own(root, 0, bounds[0])
    for (x, depth), stop in zip(marks, bounds[1:]):
        while path[-1][0] >= depth:
            path.pop()
        section = Node(x, len(text))
        path[-1][1].children.append(section)
        path.append((depth, section))
        own(section, x, stop)
    _close([root], 0, len(text))
    return root


def _sentence_ends(text: str, start: int, end: int) -> list[int]:
    out = []
    for m in _SENTENCE.finditer(text, start, end):
        if text[m.start()] == ".":
            word = text[max(start, m.start() - 8) : m.start()].rsplit(None, 1)[-1:] or [""]
            last = word[0].lstrip("(\"'").lower()
            if last in _ABBREVIATIONS or (len(last) == 1 and last.isalpha()):
                continue
        out.append(m.end())
    return out


def _after(pattern: re.Pattern[str]) -> Callable[[str, int, int], list[int]]:
    return lambda text, start, end: [m.end() for m in pattern.finditer(text, start, end)]


def _levels(text: str) -> list[Callable[[str, int, int], list[int]]]:
    """For each way to cut a leaf, the coarsest first, a function of its span that gives the cuts."""
    # The ends of lines are natural where lines are items of their own, not where they wrap sentences.
    lines = [x for x in text.split("\n") if x.strip()]
    closed = sum(x.rstrip()[-1:] in ".!?:;,|)\"'»”" for x in lines)
    wrapped = len(lines) > 2 and closed * 2 < len(lines) and sum(map(len, lines)) > 45 * len(lines)
    return [*([_sentence_ends, _after(_LINE)] if wrapped else [_after(_LINE), _sentence_ends]), _after(_CLAUSE), _after(_WORD)]


def _merge(units: list[tuple[int, int, bool]], room: int) -> list[tuple[int, int, bool]]:
    """Neighbours put together up to ``room``, the two that are smallest together first.

    Units are (start, end, whole). A part of a node that had to be cut only joins a neighbour if one of the two is
    small, so that pieces don't run across the tree.
    """
    n = len(units)
    span = [list(u) for u in units]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def joined(i: int, j: int) -> int:
        (a, b, whole), (c, d, other) = span[i], span[j]
        return d - a if d - a <= room and ((whole and other) or min(b - a, d - c) * 4 <= room) else -1

    heap = [(size, i, i + 1, span[i][1], span[i + 1][1]) for i in range(n - 1) if (size := joined(i, i + 1)) >= 0]
    heapify(heap)
    alive = [True] * n
    while heap:
        _, i, j, b, d = heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and span[i][1] == b and span[j][1] == d):
            continue
        span[i] = [span[i][0], d, span[i][2] and span[j][2]]
        alive[j], after[i] = False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (size := joined(x, y)) >= 0:
                heappush(heap, (size, x, y, span[x][1], span[y][1]))
    return [(a, b, w) for (a, b, w), live in zip(span, alive) if live]


def _cut_characters(text: str, start: int, end: int, room: int) -> list[tuple[int, int]]:
    """The last resort: parts of ``room`` characters, not within a joined or accented character if that can be."""
    out = []
    while end - start > room:
        at = start + room
        while at > start + room // 2 and (unicodedata.category(text[at]) in ("Mn", "Me", "Mc") or "‍" in (text[at], text[at - 1]) or text[at] in "︎️"):
            at -= 1
        if at == start + room // 2:
            at = start + room
        out.append((start, at))
        start = at
    return [*out, (start, end)]


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` code points that cover ``text`` in order.

    Each but the first begins exactly ``overlap`` characters before the end of the last. An overlap of the limit or
    more, which would let no piece get on, counts as half the limit; a negative one as 0. A text within the limit is
    one span, also the empty one.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, overlap) if overlap < limit else limit // 2
    room = limit - overlap
    levels = _levels(text)

    def leaf(start: int, end: int, level: int) -> list[tuple[int, int, bool]]:
        cuts: list[int] = []
        while level < len(levels) and not cuts:
            cuts = [x for x in levels[level](text, start, end) if start < x < end]
            level += 1
        if not cuts:
            return [(a, b, False) for a, b in _cut_characters(text, start, end, room)]
        units: list[tuple[int, int, bool]] = []
        for a, b in zip([start, *cuts], [*cuts, end]):
            units += [(a, b, True)] if b - a <= room else leaf(a, b, level)
        return [(a, b, False) for a, b, _ in _merge(units, room)]

    def pack(node: Node) -> list[tuple[int, int, bool]]:
        if node.end - node.start <= room:
            return [(node.start, node.end, True)]
        if len(node.children) == 1:
            return pack(node.children[0])
        if not node.children:
            return leaf(node.start, node.end, 0)
        units = _merge([u for child in node.children for u in pack(child)], room)
        return [(a, b, False) for a, b, _ in units]

    bodies = [(a, b) for a, b, _ in pack(parse(text))]
    # The first piece holds the overlap of the second; there is room for it, as nothing comes before.
    while len(bodies) > 1 and (bodies[0][1] < overlap or bodies[1][1] <= limit and bodies[0][1] * 4 <= room):
        bodies[:2] = [(0, bodies[1][1])]
    return [(max(0, a - overlap), b) for a, b in bodies]


def limits(metadata: Column) -> tuple[Column, Column]:
    """Limit and overlap of a chunk's metadata: ``chunk_size`` and ``chunk_overlap`` at the top or within ``splitter``.

    Numbers or numeric strings; 500 and 100 where absent, not positive (the overlap: negative), or where the metadata
    is null or not valid JSON. The overlap is the one beside the size.
    """
    parsed = F.try_parse_json(metadata)

    def number(path: str) -> Column:
        return F.floor(F.try_variant_get(parsed, path, "string").try_cast("double")).cast("bigint")

    top, inner = number("$.chunk_size"), number("$.splitter.chunk_size")
    top, inner = F.when(top > 0, top), F.when(inner > 0, inner)
    top_overlap, inner_overlap = number("$.chunk_overlap"), number("$.splitter.chunk_overlap")
    overlap = F.when(top.isNotNull(), top_overlap).when(inner.isNotNull(), inner_overlap).otherwise(F.coalesce(top_overlap, inner_overlap))
    return F.coalesce(top, inner, F.lit(DEFAULT_LIMIT)), F.coalesce(F.when(overlap >= 0, overlap), F.lit(DEFAULT_OVERLAP))


def _pieces(texts: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
    out = []
    for t, size, overlap in zip(texts.to_pylist(), sizes.to_pylist(), overlaps.to_pylist()):
        out.append([{"start": a, "end": b, "piece": t[a:b]} for a, b in split_spans(t, size, overlap)])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])))


def split_oversized(df: DataFrame, id_col: str, text_col: str, metadata_col: str) -> DataFrame:
    """``id, piece_no, start, end, piece`` for every row whose text is longer than the limit in its metadata.

    Lengths are in code points; ``piece`` is the text from ``start`` to before ``end``. Rows whose id or text is null,
    or whose text is within its limit, give none. Repeated rows of an id count once (the longest text, and of equally
    long ones the least). Texts reach Python only where they are too long. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    size, overlap = limits(F.col("m"))
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(metadata_col).cast("string").alias("m")).where("id is not null and t is not null")
    long = src.select("id", "t", size.alias("size"), overlap.alias("overlap")).where(F.length("t") > F.col("size"))
    cut = F.arrow_udf(_pieces, "array<struct<start: int, end: int, piece: string>>")
    once = long.groupBy("id").agg(F.max_by(F.struct("t", "size", "overlap"), F.struct(F.length("t"), F.col("t"))).alias("x")).select("id", "x.*")
    pieces = once.select("id", F.posexplode(cut("t", "size", "overlap")).alias("piece_no", "p"))
    return pieces.select("id", F.col("piece_no").cast("bigint").alias("piece_no"), F.col("p.start").cast("bigint").alias("start"), F.col("p.end").cast("bigint").alias("end"), F.col("p.piece").alias("piece"))
