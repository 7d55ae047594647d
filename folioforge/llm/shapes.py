"""Keyword-stuffed and link-list pages, by the shapes of their lines.

Every line, and within lines every sentence, is reduced to a shape: its number of words, how many of them are
capitalised, numbers, repeated or function words, its separators, links and marks, and whether it opens and closes as a sentence
does. Shapes are counted over the whole corpus among segments that are sentences or list entries beyond doubt, which
gives each part of a shape its weight; the weights together tell which shapes are no sentences. A page is flagged when
few such shapes hold at least half of its characters. All is done on arrays of character classes, for a batch of pages
at once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.codepoints import decode
from folioforge.llm.wordlists import function_words

#: Kinds of segments; the first is what sentences, headings, reference lists, contents and figures are.
KINDS = ("text", "link", "tag", "trail", "keywords", "products")
MIN_SHARE = 0.5
#: Shapes of a page, by kind and length, that may hold that share between them.
FEW = 5
#: Parts of a shape, with the number of values of each.
PARTS = {"size": 8, "capitals": 4, "numbers": 4, "separators": 4, "links": 4, "marks": 4, "closed": 2, "repeated": 4, "function": 4}
#: Counts of list entries and of sentences by the values of each part that the corpus's own are added to, so that a small one is read, too.
PRIOR = {
    "size": ((4, 6, 7, 7, 5, 4, 4, 3), (1, 2, 5, 12, 14, 4, 1, 1)),
    "capitals": ((14, 10, 8, 8), (32, 6, 1, 1)),
    "numbers": ((30, 6, 3, 1), (37, 1, 1, 1)),
    "separators": ((16, 12, 8, 4), (34, 4, 1, 1)),
    "links": ((30, 6, 2, 2), (39, 0.4, 0.3, 0.3)),
    "marks": ((28, 4, 4, 4), (39, 0.4, 0.3, 0.3)),
    "closed": ((36, 4), (6, 34)),
    "repeated": ((16, 8, 8, 8), (37, 2, 0.5, 0.5)),
    "function": ((34, 4, 1.5, 0.5), (0.5, 1.5, 4, 34)),
}
#: Bounds of the weight of a part, and of the sum for a segment to be decided by itself.
MOST, SURE = 3.0, 2.0

_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _BREAK, _END, _SEPARATOR, _HASH, _OPEN = range(10)
_classes: np.ndarray | None = None
_hashes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        t = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(0x20000):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LM":
                t[c] = _UPPER if kind in ("Lu", "Lt") else _LOWER
            elif kind[0] == "N":
                t[c] = _DIGIT
            elif kind == "Zs" or c == 9:
                t[c] = _SPACE
        t[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = _BREAK
        t[[ord(x) for x in ".!?…。"]] = _END
        t[[ord(x) for x in ",;|/>:·•»›=~"]] = _SEPARATOR
        t[ord("#")] = _HASH
        t[ord("(")] = _OPEN
        _classes = t
    return _classes


def _word_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's code points."""
    size = np.diff(np.append(starts, len(values)))
    at = np.arange(len(values)) - np.repeat(starts, size)
    powers = np.cumprod(np.full(int(size.max(initial=1)) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
    return np.add.reduceat(values.astype(np.uint64) * powers[at], starts) if len(starts) else np.zeros(0, np.uint64)


def _function_hashes() -> np.ndarray:
    global _hashes
    if _hashes is None:
        words = sorted(function_words())
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in points])[:-1]])
        _hashes = np.sort(_word_hash(np.concatenate(points), starts))
    return _hashes


def _find(points: np.ndarray, text: str) -> np.ndarray:
    """Positions at which a short lower-case text begins, whatever its case."""
    hit = np.ones(max(0, len(points) - len(text) + 1), bool)
    for k, ch in enumerate(text):
        part = points[k : k + len(hit)]
        hit &= (part == ord(ch)) | (part == ord(ch.upper()))
    return np.nonzero(hit)[0]


def segment_shapes(texts: pa.Array) -> dict[str, np.ndarray]:
    """Every segment of every text: its row, characters, words and the parts of its shape."""
    points, offsets = decode(texts)
    n = len(points)
    if n == 0:
        return {k: np.zeros(0, bool if k == "ordinary" else np.int64) for k in ("row", "chars", "words", "functions", "ordinary", "trails", *PARTS)}
    cls = _class_table()[points]
    # Segments end after a line break, and after a sentence's end (a short number's point is none) that a space and a word follow.
    new = np.zeros(n, bool)
    inner = offsets[:-1][np.diff(offsets) > 0]
    new[inner] = True
    new[1:] |= (cls[:-1] == _BREAK) & (cls[1:] != _BREAK)
    if n > 5:
        digits = cls == _DIGIT
        long_number = np.zeros(n - 3, bool)
        long_number[2:] = digits[: n - 5] & digits[1 : n - 4] & digits[2 : n - 3]
        space = np.nonzero((cls[2:-1] == _SPACE) & (cls[1:-2] == _END) & (~digits[:-3] | long_number))[0] + 3
        new[space[cls[space] != _SPACE]] = True
    seg = np.cumsum(new) - 1
    starts = np.nonzero(new)[0]
    count = len(starts)
    chars = np.diff(np.append(starts, n))
    row = np.searchsorted(offsets, starts, side="right") - 1

    def tally(where: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(seg[where], weights, count).astype(np.int64)

    # Words: runs of letters and digits.
    wordy = (cls >= _LOWER) & (cls <= _DIGIT)
    first = wordy.copy()
    first[1:] &= ~wordy[:-1] | new[1:]
    begin = np.nonzero(first)[0]
    lower = points[wordy].copy()
    upper = cls[wordy] == _UPPER
    lower[upper & (lower < 0x250)] += 32  # Latin capitals; Latin Extended-A only shifts hashes of words that aren't listed
    word_at = np.searchsorted(np.nonzero(wordy)[0], begin)
    hashes = _word_hash(lower, word_at)
    listed = _function_hashes()
    function = listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] == hashes
    words, functions = tally(begin), tally(begin[function])
    capitals, numbers = tally(begin[cls[begin] == _UPPER]), tally(begin[cls[begin] == _DIGIT])
    separators = tally(np.nonzero(cls == _SEPARATOR)[0])
    hashes_ = tally(np.nonzero(cls == _HASH)[0])
    counts_in_brackets = tally(np.nonzero((cls[:-1] == _OPEN) & (cls[1:] == _DIGIT))[0])
    links = tally(np.concatenate([_find(points, "http"), _find(points, "www.")]))
    leaders = tally(_find(points, "...."))
    bracketed = np.zeros(count, bool)
    bracketed[:] = (points[starts] == ord("[")) & (cls[np.minimum(starts + 1, n - 1)] == _DIGIT)
    broken = tally(np.nonzero(cls == _BREAK)[0])
    stops = np.nonzero(cls == _END)[0]
    ended = tally(stops[cls[np.minimum(stops + 1, n - 1)] != _DIGIT])
    # Trails: items between spaced separators other than commas.
    spaced = np.zeros(n, bool)
    spaced[1:-1] = (cls[:-2] == _SPACE) & (cls[2:] == _SPACE) & np.isin(points[1:-1], [ord(x) for x in ">|/»›·•→"])
    double = np.zeros(n, bool)
    double[1:-2] = (cls[:-3] == _SPACE) & (points[1:-2] == 58) & (points[2:-1] == 58) & (cls[3:] == _SPACE)
    trails = tally(np.nonzero(spaced | double)[0])
    per_word = np.maximum(words, 1)
    # The letter of a link's tags is no function word.
    tags = tally(_find(points, "<a ")) + tally(_find(points, "</a>"))
    functions = np.maximum(functions - tags, 0)
    opening = np.full(count, n - 1)
    opening[seg[begin[::-1]]] = begin[::-1]
    share = lambda x: np.minimum(3, (4 * x) // per_word)
    # Words other than function words, and how many of them differ within a segment.
    content = tally(begin[~function])
    order = np.lexsort((hashes[~function], seg[begin[~function]]))
    of, word = seg[begin[~function]][order], hashes[~function][order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
    distinct = np.bincount(of[fresh], minlength=count)
    counted = (counts_in_brackets * 4 >= words) & (counts_in_brackets > 0)
    tagged = (hashes_ >= 2) & (hashes_ * 4 >= words)
    parts = {
        "size": np.minimum(np.log2(per_word).astype(np.int64), 7),
        "capitals": share(capitals),
        "numbers": share(numbers),
        "separators": np.searchsorted([1 / 16, 1 / 6, 1 / 3], separators / per_word, side="right"),
        "links": np.minimum(3, links),
        "marks": np.where(counted, 3, np.where(tagged, 2, (trails > 0).astype(np.int64))),
        "closed": ((cls[opening] != _LOWER) & (ended > 0)).astype(np.int64),
        "repeated": np.searchsorted([0.15, 0.3, 0.5], 1 - distinct / np.maximum(content, 1), side="right") * (content > 0),
        "function": function_level(functions, per_word),
    }
    # Reference lists, contents and figures are lists of ordinary documents.
    figures = (numbers * 10 >= words * 7) & (links == 0)
    return {"row": row, "chars": chars - broken, "words": words, "functions": functions, "ordinary": bracketed | (leaders > 0) | figures, "trails": trails, **parts}


def function_level(functions: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Under a tenth, 16 %, 24 % of function words, or more."""
    return np.searchsorted([0.1, 0.16, 0.24], functions / words, side="right")


def seeds(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which segments are list entries, and which sentences, beyond doubt.

    A list entry has a link, a mark, many separators or much that is repeated, or stands open with the shape of the one before it on its page
    and separators, and few function words; a sentence opens and closes as one and has none of these, whatever its
    words: how far few function words speak for a list is learned, too.
    """
    same = np.zeros(len(s["row"]), bool)
    same[1:] = s["row"][1:] == s["row"][:-1]
    for part in PARTS:
        same[1:] &= s[part][1:] == s[part][:-1]
    held = (s["words"] >= 3) & ~s["ordinary"]
    entry = held & (s["function"] <= 1) & ((s["links"] > 0) | (s["marks"] > 0) | (s["repeated"] >= 2) | ((s["closed"] == 0) & ((s["separators"] >= 2) | same & (s["separators"] >= 1))))
    sentence = held & (s["closed"] == 1) & (s["words"] >= 6) & (s["links"] == 0) & (s["marks"] == 0) & (s["separators"] <= 1)
    return entry, sentence


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the values of each part among list entries and sentences; a few dozen rows a task."""
    total = {part: np.zeros((2, n), np.int64) for part, n in PARTS.items()}
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            s = segment_shapes(whole.column("t").slice(lo, 1000))
            if len(s["row"]):
                for k, chosen in enumerate(seeds(s)):
                    for part, n in PARTS.items():
                        total[part][k] += np.bincount(s[part][chosen], minlength=n)
    rows = [(part, v, int(x[0, v]), int(x[1, v])) for part, x in total.items() for v in range(x.shape[1]) if x[:, v].any()]
    yield pa.RecordBatch.from_pydict(dict(zip(("part", "value", "entries", "sentences"), map(list, zip(*rows)) if rows else ([],) * 4, strict=True)), schema=pa.schema([("part", pa.string()), ("value", pa.int64()), ("entries", pa.int64()), ("sentences", pa.int64())]))


def learn_weights(src: DataFrame) -> dict[str, np.ndarray]:
    """The weight of every value of every part, from the texts ``t`` of the whole corpus: log odds of list entries, bounded."""
    counts = {part: np.array(PRIOR[part], float) for part in PARTS}
    for r in src.select("t").where("t is not null").mapInArrow(_evidence, "part string, value bigint, entries bigint, sentences bigint").groupBy("part", "value").agg(F.sum("entries").alias("entries"), F.sum("sentences").alias("sentences")).collect():
        counts[r.part][:, r.value] += r.entries, r.sentences
    return {part: np.clip(np.log(c[0] / c[0].sum()) - np.log(c[1] / c[1].sum()), -MOST, MOST) for part, c in counts.items()}


def listed_kinds(s: dict[str, np.ndarray], weights: dict[str, np.ndarray]) -> np.ndarray:
    """The kind of each segment; 0 for sentences and what else ordinary documents hold."""
    count = len(s["row"])
    if not count:
        return np.zeros(0, np.int64)
    shape = sum(weights[part][s[part]] for part in PARTS if part != "function")
    own = shape + weights["function"][s["function"]]
    apart = s["ordinary"] | ((own < -SURE) & (s["closed"] == 1) & (s["words"] >= 4))
    # The rest is pooled over runs of neighbouring segments: wrapped prose has function words in its runs, lists have not.
    edge = np.ones(count, bool)
    edge[1:] = (s["row"][1:] != s["row"][:-1]) | (apart[1:] != apart[:-1])
    run = np.cumsum(edge) - 1
    pooled = lambda x: np.bincount(run, x)[run]
    words = pooled(s["words"])
    level = function_level(pooled(s["functions"]), np.maximum(words, 1))
    mean = pooled(shape * s["words"]) / np.maximum(words, 1) + weights["function"][level]
    listed = ~apart & ((words >= 8) & (mean > 0) | (s["links"] > 0) & (own > SURE))
    numbers = np.asarray(s["numbers"])
    kind = np.zeros(count, np.int64)
    kind[listed] = KINDS.index("keywords")
    kind[listed & (numbers >= 1)] = KINDS.index("products")
    kind[listed & (s["marks"] == 1)] = KINDS.index("trail")
    kind[listed & (s["marks"] >= 2)] = KINDS.index("tag")
    kind[listed & (s["links"] > 0)] = KINDS.index("link")
    return kind


def _profiles(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                s = segment_shapes(b.column("t"))
                kind = listed_kinds(s, weights)
                listed = kind > 0
                shape = kind * 4 + s["size"] // 2
                key, inverse = np.unique(np.stack([s["row"][listed], shape[listed]], 1), axis=0, return_inverse=True) if listed.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                chars = np.bincount(inverse.ravel(), s["chars"][listed], len(key)).astype(np.int64)
                total = np.bincount(s["row"], s["chars"], b.num_rows).astype(np.int64)
                starts = np.searchsorted(key[:, 0], np.arange(b.num_rows + 1)).astype(np.int32)
                shapes = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(chars), pa.array(key[:, 1])], ["chars", "shape"]))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(total), shapes], ["id", "total", "shapes"])

    return run


def line_shapes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, total, shapes``: the characters of each text, and of each of its non-sentence shapes (kind x 4 + level of length)."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    return src.mapInArrow(_profiles(learn_weights(src)), f"id {kind}, total bigint, shapes array<struct<chars: bigint, shape: bigint>>")


def stuffed_pages(df: DataFrame, id_col: str, text_col: str, min_share: float = MIN_SHARE, few: int = FEW) -> DataFrame:
    """``id, share, kind``: pages of whose characters the ``few`` largest non-sentence shapes hold at least ``min_share``.

    ``kind`` is that of the largest shape. A null, empty or blank text is no such page; rows with a null id
    are left out; repeated rows come out once. Whole texts are read, twice: the weights of shapes come from all of them
    first. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    largest = F.slice(F.sort_array("shapes", asc=False), 1, few)
    held = F.aggregate(largest, F.lit(0).cast("bigint"), lambda a, x: a + x.chars)
    named = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.shiftright(F.array_max("shapes").shape, 2) + 1).cast("int"))
    pages = line_shapes(df, id_col, text_col).where("total > 0 and size(shapes) > 0").withColumn("share", held / F.col("total"))
    return pages.where(F.col("share") >= min_share).select("id", "share", named.alias("kind")).groupBy("id").agg(F.max("share").alias("share"), F.max("kind").alias("kind"))
