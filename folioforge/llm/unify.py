"""One form for texts that look alike, on arrays of code points.

A batch of Arrow text becomes one numpy array of code points. Lookup tables give each point its class and its
replacement; replacements of several points expand through offsets; marks are put in canonical order and composed with
their letters by a search in the table of compositions, a round for all texts at once. Rows without any point of
concern keep their Arrow values.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.codepoints import decode, encode

#: Kinds of differences, as bits of ``kinds``.
COMPATIBILITY, COMBINING, INVISIBLE, BLANK, FOREIGN_LETTER = 1, 2, 4, 8, 16

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ь": "b", "п": "n", "г": "r", "ӏ": "l", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D", "Һ": "h",
    # Greek
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "զ": "q", "ռ": "n", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U",
    # Cherokee, Coptic, Lisu
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꮖ": "I", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
}

_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, 0xFEFF, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
_JOINERS = (0x200C, 0x200D)
# Classes of code points; the lowest, 0, needs nothing.
_REPLACE, _GONE, _SPACE, _MARK, _LATIN, _FOREIGN, _OTHER_LETTER, _PICTURE, _RETURN, _SELECTOR, _CONTROL = range(1, 12)


class _Tables:
    """Lookup tables over all code points, built from the Unicode character database by rule."""

    def __init__(self) -> None:
        size = sys.maxunicode + 1
        self.kind = np.zeros(size, np.uint8)
        self.length = np.ones(size, np.uint8)
        self.at = np.zeros(size, np.int32)
        self.flag = np.zeros(size, np.uint8)
        self.fold = np.arange(size, dtype=np.uint32)
        self.ccc = np.zeros(size, np.uint8)
        pool: list[int] = []
        pairs: dict[tuple[int, int], int] = {}

        def replacement(c: int, text: str) -> None:
            self.kind[c], self.length[c], self.at[c] = _REPLACE, len(text), len(pool)
            pool.extend(map(ord, text))

        self.split: dict[int, str] = {}
        for c in range(0x323B0):
            ch = chr(c)
            category = unicodedata.category(ch)
            if category in ("Cn", "Cs", "Co"):
                continue
            self.ccc[c] = unicodedata.combining(ch)
            if category[0] == "L":
                self.kind[c] = _LATIN if unicodedata.name(ch, "").startswith("LATIN") else _OTHER_LETTER
            elif category[0] == "M":
                self.kind[c] = _MARK
            elif category in ("So", "Sk") and c >= 0x2190 or 0x1F000 <= c < 0x20000:
                self.kind[c] = _PICTURE
            elif category == "Zs" and c != 32:
                self.kind[c], self.flag[c] = _SPACE, BLANK
            elif category == "Cc" and c not in (9, 10, 11, 12, 13, 0x85):
                self.kind[c], self.flag[c] = _CONTROL, INVISIBLE
            form = unicodedata.decomposition(ch)
            if not form:
                continue
            if form[0] != "<":
                parts = [int(x, 16) for x in form.split()]
                whole = unicodedata.normalize("NFD", ch)
                if len(parts) == 2 and unicodedata.normalize("NFC", whole) == ch:
                    pairs[parts[0], parts[1]] = c
                elif unicodedata.normalize("NFC", ch) != ch:
                    replacement(c, unicodedata.normalize("NFC", ch))  # a singleton, or never composed
                    continue
                self.split[c] = whole
            else:
                tag = form[1 : form.index(">")]
                plain = unicodedata.normalize("NFKC", ch)
                letters = all(unicodedata.category(x)[0] in "LM" for x in plain)
                # Width and style, and ligatures and single styled letters; not what bears a meaning, such as superscripts.
                if tag in ("wide", "narrow", "font", "initial", "medial", "final", "isolated") or (tag == "compat" and letters and category[0] == "L") and not 0x1100 <= c < 0x1200:
                    if c != 0x3000:
                        replacement(c, plain)
                        self.flag[c] = COMPATIBILITY
        for c in _INVISIBLE:
            self.kind[c], self.flag[c] = _GONE, INVISIBLE
        self.kind[0xFE00:0xFE10] = _SELECTOR
        self.kind[[13, 11, 12, 0x85, 0x2028, 0x2029]] = _RETURN
        self.pool = np.array(pool, np.uint32)
        # Look-alikes, and accented letters on them.
        marked = {c: s for c, s in self.split.items() if s[0] in LOOK_ALIKES}
        folds = LOOK_ALIKES | {chr(c): f for c, s in marked.items() if len(f := unicodedata.normalize("NFC", LOOK_ALIKES[s[0]] + s[1:])) == 1}
        for ch, latin in folds.items():
            if self.kind[ord(ch)] == _OTHER_LETTER:
                self.kind[ord(ch)] = _FOREIGN
                self.fold[ord(ch)] = ord(latin)
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair, self.whole = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        self.quiet = np.isin(self.kind, (0, _LATIN, _OTHER_LETTER, _PICTURE))

    def composed(self, first: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The composed letter of each pair, 0 where there is none."""
        key = (first.astype(np.int64) << 21) | mark.astype(np.int64)
        k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[k] == key, self.whole[k], 0)


@lru_cache(1)
def _tables() -> _Tables:
    return _Tables()


def _expand(t: _Tables, p: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces points by their expansions."""
    hit = t.kind[p] == _REPLACE
    if not hit.any():
        return p, row
    size = np.where(hit, t.length[p], 1).astype(np.int64)
    stop = np.cumsum(size)
    source = np.repeat(np.arange(len(p)), size)
    within = np.arange(stop[-1]) - np.repeat(stop - size, size)
    out = p[source]
    big = hit[source]
    out[big] = t.pool[t.at[p[source[big]]] + within[big]]
    return out, row[source]


def _unify_points(t: _Tables, p: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unified points with their rows, and the kinds of differences of each row."""
    kinds = np.zeros(rows, np.int32)

    def mark(at: np.ndarray, flags: np.ndarray | int) -> None:
        np.bitwise_or.at(kinds, row[at], flags)

    def neighbours(values: np.ndarray, default: int) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.full(len(p), default, values.dtype), np.full(len(p), default, values.dtype)
        same = row[1:] == row[:-1]
        before[1:][same], after[:-1][same] = values[:-1][same], values[1:][same]
        return before, after

    # Invisible points go, but joiners and selectors within emoji, and joiners between letters of scripts that shape by them.
    k = t.kind[p]
    before, after = neighbours(k, 0)
    point_before, point_after = neighbours(p, 0)
    gone = (k == _GONE) | (k == _CONTROL) | (k == _SELECTOR)
    shaped = ((before == _OTHER_LETTER) | (before == _MARK)) & (point_before >= 0x600) & (point_before < 0x2000)
    emoji = ((before == _PICTURE) | (before == _SELECTOR)) & ((after == _PICTURE) | (p != 0x200D))
    emoji |= (point_before >= 0x1F3FB) & (point_before <= 0x1F3FF)
    gone &= ~(np.isin(p, _JOINERS) & (shaped | ((p == 0x200D) & emoji)))
    gone &= ~((k == _SELECTOR) & ((before == _PICTURE) | shaped | ((p == 0xFE0F) & (after == 0) & (point_before < 0x80) & (point_before > 0x20))))
    gone &= ~((p >= 0xE0020) & (p < 0xE0080) & (before == _PICTURE))
    # A carriage return before a line feed goes; other line breaks become one.
    returns = k == _RETURN
    mark(gone, INVISIBLE)
    keep = ~(gone | (returns & (p == 13) & (point_after == 10)))
    p = np.where(returns, np.uint32(10), p)
    p = np.where(k == _SPACE, np.uint32(32), p)
    mark(k == _SPACE, BLANK)
    mark(keep & (t.flag[p] == COMPATIBILITY), COMPATIBILITY)
    p, row = p[keep], row[keep]
    p, row = _expand(t, p, row)
    # Letters of other scripts in words that are Latin otherwise.
    k = t.kind[p]
    foreign = k == _FOREIGN
    if foreign.any():
        letter = (k >= _MARK) & (k <= _OTHER_LETTER)
        new = letter.copy()
        new[1:] &= ~letter[:-1] | (row[1:] != row[:-1])
        word = np.cumsum(new) - 1
        n = int(word[-1]) + 1
        tally = lambda where: np.bincount(word[where], minlength=n)
        mixed = (tally(k == _LATIN) > 0) & (tally(k == _OTHER_LETTER) == 0)
        hit = foreign & mixed[np.maximum(word, 0)]
        mark(hit, FOREIGN_LETTER)
        p = np.where(hit, t.fold[p], p)
        k = t.kind[p]
    # Marks: letters before them are taken apart, marks ordered by class, then composed again.
    marks = k == _MARK
    if marks.any():
        follows = np.zeros(len(p), bool)
        follows[:-1] = marks[1:] & (row[1:] == row[:-1])
        apart = follows & np.isin(p, np.fromiter(t.split, np.uint32, len(t.split)))
        was = p.copy()
        own = np.zeros(len(p), bool)  # composed letters taken apart only to see whether their marks order differently
        if apart.any():
            parts = {int(c): [ord(x) for x in t.split[int(c)]] for c in np.unique(p[apart])}
            size = np.ones(len(p), np.int64)
            size[apart] = [len(parts[int(c)]) for c in p[apart]]
            out = np.repeat(p, size)
            stop = np.cumsum(size)
            for c, s in parts.items():
                at = (stop - size)[apart & (was == c)]
                for i, x in enumerate(s):
                    out[at + i] = x
            own = np.repeat(apart, size)
            p, row = out, np.repeat(row, size)
            own[stop - size] = False
            # A mark that was there before, and not the letter's own, makes the difference.
        # Marks in the order of their classes, each run by itself; equal ones keep their order.
        ccc = t.ccc[p]
        run = (ccc == 0) | np.concatenate([[True], row[1:] != row[:-1]])
        order = np.argsort(np.cumsum(run) * 256 + ccc, kind="stable")
        p, own = p[order], own[order]
        while True:
            ccc = t.ccc[p]
            start = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(p)), -1))
            here = np.nonzero((ccc > 0) & (start >= 0))[0]
            here = here[row[start[here]] == row[here]]
            blocked = (here - 1 != start[here]) & (ccc[here - 1] >= ccc[here])
            here = here[~blocked]
            whole = t.composed(p[start[here]], p[here])
            here, whole = here[whole > 0], whole[whole > 0]
            if not len(here):
                break
            _, one = np.unique(start[here], return_index=True)
            here, whole = here[one], whole[one]
            mark(here[~own[here]], COMBINING)
            p[start[here]] = whole
            keep = np.ones(len(p), bool)
            keep[here] = False
            p, row, own = p[keep], row[keep], own[keep]
    return p, row, kinds


def unify(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Unified texts, null where null, and the kinds of differences of each as bits."""
    t = _tables()
    points, offsets = decode(texts)
    kinds = np.zeros(len(texts), np.int32)
    loud = np.nonzero(~t.quiet[points])[0]
    if not len(loud):
        return texts, kinds
    touched = np.zeros(len(texts), bool)
    touched[np.searchsorted(offsets, loud, side="right") - 1] = True
    size = np.diff(offsets)
    which = np.repeat(touched, size)
    row = np.repeat(np.cumsum(touched) - 1, size)[which]
    n = int(touched.sum())
    p, row, found = _unify_points(t, points[which], row, n)
    kinds[touched] = found
    new = encode(p, np.searchsorted(row, np.arange(n + 1)))
    return pc.replace_with_mask(texts.cast(pa.string()), pa.array(touched), new), kinds


def _unify_batches(texts: pa.Array) -> pa.Array:
    text, kinds = [], []
    for lo in range(0, len(texts), 1000):
        part, found = unify(texts.slice(lo, 1000))
        text.append(part.cast(pa.string()))
        kinds.append(found)
    whole = pa.concat_arrays(text) if text else pa.array([], pa.string())
    return pa.StructArray.from_arrays([whole, pa.array(np.concatenate([np.zeros(0, np.int32), *kinds]))], ["text", "kinds"])


def unified(text: Column | str) -> Column:
    """A struct of the text in its one form and the kinds of differences it had (bits, 0 for none).

    Width, style and ligature forms become ordinary letters; combining marks compose; invisible characters go, but
    joiners within emoji; blanks other than space, tab and line break become spaces; look-alike letters of other
    scripts become Latin in words that are Latin otherwise; line breaks become line feeds (which counts as no
    difference). Null stays null with kinds 0; the empty text stays empty. Unified text doesn't change again.
    """
    return F.arrow_udf(_unify_batches, "struct<text: string, kinds: int>")(text)


def lookalike_values(df: DataFrame, id_col: str, text_col: str, field: str) -> DataFrame:
    """``field, record_id, kinds, text`` of the values that had any difference; repeated rows come out once.

    Rows with a null id or text are left out. Other columns are ignored, whatever their names.
    """
    src = df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).cast("string").alias("t")).where("record_id is not null and t is not null")
    found = src.select("record_id", unified("t").alias("u")).where("u.kinds <> 0")
    return found.select(F.lit(field).alias("field"), "record_id", F.col("u.kinds").alias("kinds"), F.col("u.text").alias("text")).groupBy("field", "record_id").agg(F.max("kinds").alias("kinds"), F.min("text").alias("text"))
