"""Noise in text read from scanned pages: divided words, misread words, running headers and page numbers.

Words of the whole corpus are counted. Each has an anagram hash, the sum of the fifth powers of its code points, so
that a confusion of characters changes the hash by a fixed difference wherever it occurs: rare words join frequent
ones on hash less difference, in SQL, and the most frequent fitting one is the correction. Lines at the edges of pages
go if their skeleton, in which confusable characters are one, recurs on other pages, or if they number pages. Words
divided at line ends are joined unless the corpus writes them with a hyphen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import broadcast_if_small, materialize

#: What is printed and what recognition makes of it.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("t", "f"), ("f", "t"), ("o", "0"), ("i", "l"), ("l", "i"), ("n", "ri"), ("s", "5"), ("l", "1"), ("i", "1"), ("u", "ii"), ("m", "rn"), ("d", "cl"),
    ("g", "q"), ("q", "g"), ("h", "b"), ("b", "h"), ("in", "m"), ("w", "vv"), ("li", "h"), ("é", "6"), ("cl", "d"), ("ü", "ii"), ("ii", "u"), ("ii", "ü"), ("rn", "m"), ("b", "8"), ("nn", "m"), ("ri", "n"), ("m", "in"), ("h", "li"),
    ("vv", "w"), ("z", "2"), ("g", "9"), ("b", "6"), ("s", "8"), ("m", "nn"), ("n", "u"), ("u", "n"), ("i", "j"), ("y", "v"), ("ä", "a"), ("fi", "h"),
]
#: How many times as frequent as a misread word its correction is, whatever the size of the corpus.
RATIO = 25
#: A word with two confusions has at least so many characters, and no more occurrences than this.
TWICE_LENGTH, TWICE_COUNT = 7, 2
#: Pages from one occurrence of a header to the next, on average, at most.
HEADER_GAP = 4
BROADCAST_ROWS = 200_000

_DASH = r"(?:-|\x{AC}|\x{AD}) ?"
_BREAK = rf"(?<![\p{{L}}\p{{M}}])([\p{{L}}\p{{M}}]++)({_DASH})\n\s*([\p{{Ll}}\p{{M}}]++)"
_WORDS = r"[\p{L}\p{M}\p{N}]+"
_NUMBER = r"(?:[0-9OolISB]{0,4}[0-9][0-9OolISB]{0,4}|[ivxlcIVXLC]{1,8})"
_WORD_FOR_PAGE = r"(?:page|pag|pág|página|pagina|seite|p|s|pg|blatt|folio|f)\.?"
_OF = r"(?:\s*(?:of|von|de|di|sur|da|/)\s*[0-9]{1,4})?"


def _joined(text: Column) -> Column:
    """Text with words divided at line ends put together, for counting."""
    return F.regexp_replace(text, rf"([\p{{L}}\p{{M}}]){_DASH}\n\s*([\p{{Ll}}])", "$1$2")


def anagram_hash(word: Column) -> Column:
    """The sum of the fifth powers of a word's code points, these modulo 2,000 so that no sum overflows."""

    def fifth(c: Column) -> Column:
        x = F.ascii(c).cast("bigint") % 2000
        return x * x * x * x * x

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(fifth(c), F.lit(0).cast("bigint")))


def _python_hash(text: str) -> int:
    return sum((ord(c) % 2000) ** 5 for c in text)


def word_counts(chunks: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` of every word in lower case over all texts, with two characters or more and a letter."""
    words = F.explode(F.regexp_extract_all(F.lower(_joined(F.col(text_col))), F.lit(_WORDS), F.lit(0)))
    return chunks.select(words.alias("word")).where(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n")).where(F.col("word").rlike(r"[\p{L}]"))


def _confusions() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("no"), F.lit(a).alias("printed"), F.lit(b).alias("read"), F.lit(_python_hash(b) - _python_hash(a)).alias("difference")) for i, (a, b) in enumerate(CONFUSIONS)])


def _misread(right: Column, printed: Column, read: Column) -> Column:
    """All forms of a word with one occurrence of what is printed as it is read."""
    at = F.filter(F.sequence(F.lit(1), F.length(right)), lambda p: F.substring(right, p, F.length(printed)) == printed)
    return F.transform(at, lambda p: F.concat(F.substring(right, F.lit(1), p - 1), read, F.substring(right, p + F.length(printed), F.length(right))))


def _rare(counts: DataFrame) -> DataFrame:
    """Words that may be misread; of two characters those that mix letters and digits."""
    return counts.where((F.length("word") >= 3) | F.col("word").rlike("[0-9]")).withColumn("hash", anagram_hash(F.col("word")))


def _frequent(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n") >= RATIO).select(F.col("word").alias("correct"), F.col("n").alias("m"), anagram_hash(F.col("word")).alias("h"))


def corrections(counts: DataFrame) -> DataFrame:
    """``word, correct``: rare words that one confusion makes of a frequent one.

    Where several fit, the rank is a noisy channel's: how many words of the corpus a confusion alone explains, times
    how frequent the correction is.
    """
    # Every word with the differences of the confusions that it can hold.
    held = _rare(counts).select("word", "n", "hash", F.explode(F.filter(_confusions(), lambda c: F.contains(F.col("word"), c.read))).alias("c"))
    rare = held.select("word", "n", "c.no", "c.printed", "c.read", (F.col("hash") - F.col("c.difference")).alias("h"))
    # Catalyst doesn't see that the words are multiplied by their confusions, so it would broadcast them by the size of the words alone.
    met = rare.hint("merge").join(_frequent(counts), "h").where(F.col("m") >= F.col("n") * RATIO)
    fits = materialize(met.where(F.array_contains(_misread(F.col("correct"), F.col("printed"), F.col("read")), F.col("word"))).select("word", "no", "correct", "m"), "fits")
    alone = fits.groupBy("word").agg(F.count("*").alias("k"), F.min("no").alias("no")).where("k = 1")
    support = alone.groupBy("no").agg(F.count("*").alias("support"))  # a row a confusion
    ranked = fits.join(F.broadcast(support), "no", "left").withColumn("score", (F.coalesce("support", F.lit(0)) + 1) * F.col("m"))
    return ranked.groupBy("word").agg(F.max_by("correct", F.struct("score", "m", "correct")).alias("correct"))


def double_corrections(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``word, correct`` of those of ``words`` (word, n) that two confusions make of a frequent one; the most frequent, if several fit."""
    held = words.withColumn("hash", anagram_hash(F.col("word"))).withColumn("c", F.filter(_confusions(), lambda c: F.contains(F.col("word"), c.read)))
    one = held.select("word", "n", "hash", "c", F.explode("c").alias("x"))
    two = one.select("word", "n", "hash", "x", F.explode(F.filter("c", lambda c: c.no >= F.col("x.no"))).alias("y"))
    met = two.withColumn("h", F.col("hash") - F.col("x.difference") - F.col("y.difference")).hint("merge").join(_frequent(counts), "h").where(F.col("m") >= F.col("n") * RATIO)
    once = _misread(F.col("correct"), F.col("x.printed"), F.col("x.read"))
    again = F.flatten(F.transform(once, lambda w: _misread(w, F.col("y.printed"), F.col("y.read"))))
    return met.where(F.array_contains(again, F.col("word"))).groupBy("word").agg(F.max_by("correct", F.struct("m", "correct")).alias("correct"))


def skeleton(line: Column) -> Column:
    """A line's letters with those that recognition confuses made one, without blanks, marks and case."""
    x = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]", "")
    for of, one in (("áàâãäåaóòôõö0", "o"), ("íìîïi1", "l"), ("éèêëe6ç", "c"), ("úùûüu8b", "h"), ("f", "t"), ("q9", "g"), ("5", "s"), ("2", "z"), ("ñ", "n")):
        x = F.translate(x, of, one * len(of))
    for read, one in (("ll", "h"), ("rl", "n"), ("rn", "m"), ("ln", "m"), ("nn", "m"), ("cl", "d"), ("vv", "w")):
        x = F.replace(x, F.lit(read), F.lit(one))
    return x


def edge_lines(chunks: DataFrame) -> DataFrame:
    """The first and last two lines of every page of at least three lines, as ``id, document_id, page, side, line_no, line``.

    ``chunks`` has id, document_id, page and text. Lines longer than a page is wide are no edge lines.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"[\r\t\x{A0}]", " "))), lambda x: F.trim(x) != "")
    pages = chunks.where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) >= 2).withColumn("lines", lines).where(F.size("lines") >= 3)
    n = F.size("lines")
    edges = F.array(*[F.struct(F.lit(side).alias("side"), no.cast("int").alias("line_no"), F.element_at("lines", no.cast("int")).alias("line")) for side, no in (("head", F.lit(1)), ("head", F.lit(2)), ("foot", n), ("foot", n - 1))])
    # Wrapped pages: apart from the last line and two at the edges, lines come near the longest.
    longest = F.array_max(F.transform("lines", lambda x: F.length(x)))
    full = F.size(F.filter("lines", lambda x: F.length(x) * 10 >= longest * 7))
    wrapped = (longest <= 110) & (full * 4 >= (n - 3) * 3)
    return pages.where(wrapped).select("id", "document_id", "page", n.alias("n_lines"), F.explode(edges).alias("e")).select("id", "document_id", "page", "n_lines", "e.*").distinct()


_MARGIN = rf"^\s*{_NUMBER}\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}{_NUMBER}\s*$"


def running_headers(edges: DataFrame) -> DataFrame:
    """``id, line_no`` of edge lines that recur on other pages of their document, however they were read.

    A line recurs if its whole skeleton, or two of its beginning, middle and end, stand on the same side of several
    pages, which are at least a fifth of those of the document, or follow each other at HEADER_GAP pages or less.
    """
    text = F.regexp_replace("line", _MARGIN, "")
    lines = edges.withColumn("s", skeleton(text)).where((F.length("s") >= 5) & ~F.col("line").rlike(r"[-.,;:\x{AC}\x{AD}]\s*$") & ~F.col("line").rlike(rf"(?i)^\W*{_WORD_FOR_PAGE}?\W*{_NUMBER}{_OF}\W*$"))
    third = F.greatest(F.lit(3), F.ceil(F.length("s") / 3)).cast("int")
    start, middle, end = F.substring("s", F.lit(1), third), F.substring("s", third + 1, third), F.substring("s", -third, third)
    keys = F.array(F.concat(F.lit("="), F.col("s")), F.concat(F.lit("1"), start, F.lit(" "), middle), F.concat(F.lit("2"), start, F.lit(" "), end), F.concat(F.lit("3"), middle, F.lit(" "), end))
    parts = lines.select("id", "document_id", "page", "side", "line_no", F.explode(F.when(F.length("s") >= 9, keys).otherwise(F.slice(keys, 1, 1))).alias("key"))
    pages = edges.groupBy("document_id").agg(F.count_distinct("id").alias("n_pages"))
    recurring = parts.groupBy("document_id", "side", "key").agg(F.count_distinct("id").alias("n"), (F.max("page") - F.min("page")).alias("span")).where("n >= 2").join(pages, "document_id").where((F.col("n") * 5 >= F.col("n_pages")) | (F.col("span") <= HEADER_GAP * (F.col("n") - 1))).select("document_id", "side", "key")
    return parts.join(recurring, ["document_id", "side", "key"], "left_semi").select("id", "line_no").distinct()


def _value(number: Column) -> Column:
    """The number that digits, as they may be misread, or Roman numerals stand for; null for others."""
    digits = F.translate(number, "OolISB", "001158")
    roman = F.lower(number)
    each = F.transform(F.split(roman, ""), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100)) for x in p]), c), F.lit(0)))
    shifted = F.concat(F.slice(each, F.lit(2), F.greatest(F.size(each) - 1, F.lit(0))), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(each, shifted, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda a, x: a + x)
    return F.when(number.rlike("[0-9]"), digits.try_cast("int")).when(roman.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"), total)


def page_numbers(edges: DataFrame, headers: DataFrame) -> DataFrame:
    """``id, line_no, alone`` of edge lines that hold a page number, alone or beside a running header.

    A number that is marked as one (dashes, brackets, a word for page) counts by itself; a bare one where it goes with
    the page's place in its document on several pages, or stands alone beyond doubt.
    """
    line = F.trim("line")
    marked = rf"(?i)^(?:[-–—~*•\[(<|]+\s*{_NUMBER}{_OF}\s*[-–—~*•\])>|]*|{_NUMBER}\s*[-–—~*•\])>|]+|{_WORD_FOR_PAGE}\s*{_NUMBER}{_OF}|{_NUMBER}\s*/\s*[0-9]{{1,4}})$"
    bare = rf"^{_NUMBER}$"
    margin = rf"^({_NUMBER})\s{{2,}}\S|\S\s{{2,}}({_NUMBER})$"
    inner = F.regexp_extract(line, rf"(?i)^\W*(?:{_WORD_FOR_PAGE}\s*)?({_NUMBER})", 1)
    beside = F.coalesce(F.nullif(F.regexp_extract(line, margin, 1), F.lit("")), F.regexp_extract(line, margin, 2))
    kind = F.when(line.rlike(marked), "marked").when(line.rlike(bare), "bare").when(line.rlike(margin), "beside")
    found = edges.withColumn("kind", kind).where("kind is not null")
    found = found.withColumn("value", _value(F.when(F.col("kind") == "beside", beside).otherwise(inner))).where("value is not null")
    found = found.withColumn("place", F.col("value") - F.col("page"))
    steady = found.groupBy("document_id", "place").agg(F.count_distinct("id").alias("n")).where("n >= 2").select("document_id", "place", F.lit(True).alias("steady"))
    found = found.join(steady, ["document_id", "place"], "left").join(headers.withColumn("header", F.lit(True)), ["id", "line_no"], "left")
    sure = (F.col("kind") == "marked") | F.coalesce("steady", F.lit(False)) | ((F.col("kind") == "beside") & F.coalesce("header", F.lit(False))) | ((F.col("kind") == "bare") & F.col("line").rlike("^\\s*[0-9]{1,4}\\s*$"))
    return found.where(sure).groupBy("id", "line_no").agg(F.min(F.col("kind") != "beside").alias("alone"))


def divided_words(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, left, dash, right, divided`` of every letter run broken by a hyphen at a line end.

    A break is a word's division unless the corpus has the two parts with a hyphen more often than as one word.
    """
    has = F.col("text").rlike(rf"[\p{{L}}\p{{M}}]{_DASH}\n\s*[\p{{Ll}}]")
    breaks = chunks.where(has).select("id", F.explode(F.regexp_extract_all("text", F.lit(_BREAK), F.lit(0))).alias("b")).distinct()
    breaks = breaks.select("id", *[F.regexp_extract("b", _BREAK, k + 1).alias(c) for k, c in enumerate(("left", "dash", "right"))])
    # The corpus's hyphenated words within lines; the end of a line within one isn't counted as evidence.
    compounds = chunks.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{M}])[\p{L}\p{M}]++-[\p{L}\p{M}]++"), F.lit(0))).alias("compound")).groupBy("compound").agg(F.count("*").alias("n_compound"))
    parts = materialize(breaks.select(F.lower(F.concat_ws("-", "left", "right")).alias("compound"), F.lower(F.concat("left", "right")).alias("word")).distinct(), "breaks")
    known = parts.join(compounds, "compound", "left").join(counts, "word", "left").select("compound", (F.col("n_compound") > F.coalesce("n", F.lit(0))).alias("hyphenated"))
    joined = breaks.withColumn("compound", F.lower(F.concat_ws("-", "left", "right"))).join(broadcast_if_small(materialize(known, "hyphens"), BROADCAST_ROWS), "compound", "left")
    return joined.select("id", "left", "dash", "right", (~(F.coalesce("hyphenated", F.lit(False)) & (F.trim("dash") == "-"))).alias("divided"))


def misread_words(chunks: DataFrame, counts: DataFrame, scanned: DataFrame) -> DataFrame:
    """``id, word, correct`` of words in wrapped texts that are misread.

    One alone is evidence only in a document that shows other traces of scanning (``scanned``: document_id). Words with
    two confusions are looked for in documents that have such traces, or other misread words.
    """
    fixes = materialize(corrections(counts), "corrections")
    pages = chunks.where(F.col("text").contains("\n"))
    split = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_joined(F.col("text"))), F.lit(_WORDS), F.lit(0))))
    words = pages.select("id", "document_id", split.alias("word"))
    hits = materialize(words.join(broadcast_if_small(fixes, BROADCAST_ROWS), "word").distinct(), "misread")
    several = hits.groupBy("document_id").agg(F.count_distinct("word").alias("forms")).where("forms >= 2").select("document_id")
    enough = materialize(several.union(scanned.select("document_id")).distinct(), "scanned")
    single = hits.join(enough, "document_id", "left_semi")
    # Only pages of such documents are split again.
    within = pages.join(broadcast_if_small(enough, BROADCAST_ROWS), "document_id", "left_semi")
    left = materialize(within.select("id", split.alias("word")).where(F.length("word") >= TWICE_LENGTH), "scanned_words")
    open_words = left.select("word").distinct().join(counts.where(F.col("n") <= TWICE_COUNT), "word").join(fixes, "word", "left_anti")
    twice = materialize(double_corrections(open_words, counts), "double_corrections")
    return single.select("id", "word", "correct").union(left.join(broadcast_if_small(twice, BROADCAST_ROWS), "word").select("id", "word", "correct")).distinct()


def _parts(df: DataFrame, id_col: str, document_col: str, page_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    src = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(document_col).cast("string")), F.lit("")).alias("document_id"), F.col(page_col).cast("bigint").alias("page"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    counts = materialize(word_counts(src, "text"), "words")
    edges = materialize(edge_lines(src), "edges")
    headers = materialize(running_headers(edges), "headers")
    numbers = materialize(page_numbers(edges, headers), "numbers")
    scanned = headers.select("id").union(numbers.select("id")).distinct().join(edges.select("id", "document_id").distinct(), "id").select("document_id")
    return src, headers, numbers, divided_words(src, counts), misread_words(src, counts, scanned)


def page_noise(df: DataFrame, id_col: str, document_col: str, page_col: str, text_col: str) -> DataFrame:
    """``id, noise``: a row for each text and kind of noise in it (hyphenation, misread, running_header, page_number).

    ``page_col`` orders a document's pages. Rows with a null id or text are left out; a null document is a document;
    repeated rows come out once. Words are counted over all texts, whole. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    _, headers, numbers, divided, misread = _parts(df, id_col, document_col, page_col, text_col)
    kinds = [(divided.where("divided"), "hyphenation"), (misread, "misread"), (headers, "running_header"), (numbers, "page_number")]
    found = None
    for part, kind in kinds:
        rows = part.select("id", F.lit(kind).alias("noise")).distinct()
        found = rows if found is None else found.unionByName(rows)
    return found


def _repair_text(text: str, drop: set[int], kept_hyphens: set[tuple[str, str]], fixes: dict[str, str], cut: set[int]) -> str:
    """One page without its edge lines, with whole words, corrections and one line a paragraph."""
    lines, no = [], 0
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.strip():
            no += 1
            if no in drop:
                continue
            if no in cut:
                line = re.sub(rf"^\s*{_NUMBER}\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}{_NUMBER}\s*$", "", line)
        lines.append(line.rstrip())
    body = "\n".join(lines)

    def join(m: re.Match[str]) -> str:
        return f"{m[1]}-{m[3]}" if (m[1], m[3]) in kept_hyphens else m[1] + m[3]

    body = re.sub(r"([^\W\d_]+)([-\xac\xad] ?)\n\s*([^\W\d_]+)", lambda m: join(m) if m[3][0].islower() else m[0], body)
    body = re.sub(r"[ \t]*\n(?!\s*\n)(?<!\n\n)[ \t]*(?=\S)", lambda m: "\n" if m.start() == 0 or body[m.start() - 1] == "\n" else " ", body)
    body = re.sub(r"\n{2,}", "\n\n", body).strip()
    if fixes:

        def fix(m: re.Match[str]) -> str:
            right = fixes.get(m[0].lower())
            if right is None:
                return m[0]
            return right.upper() if m[0].isupper() and len(m[0]) > 1 else right.capitalize() if m[0][0].isupper() else right

        body = re.sub(r"[^\W_]+", fix, body)
    return body


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        out = [
            _repair_text(r["text"], set(r["dropped"] or ()), {(x["left"], x["right"]) for x in r["hyphens"] or ()}, {x["word"]: x["correct"] for x in r["fixes"] or ()}, set(r["trimmed"] or ()))
            for r in rows
        ]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "text"])


def repair_pages(df: DataFrame, id_col: str, document_col: str, page_col: str, text_col: str) -> DataFrame:
    """``id, text``: every text that holds noise, repaired: no edge lines, whole words, corrections, paragraphs on one line.

    Texts without noise aren't listed; the rest as in page_noise().
    """
    src, headers, numbers, divided, misread = _parts(df, id_col, document_col, page_col, text_col)
    divided = materialize(divided, "divided")
    out = headers.select("id", "line_no").union(numbers.where("alone").select("id", "line_no")).groupBy("id").agg(F.collect_set("line_no").alias("dropped"))
    trimmed = numbers.where("not alone").groupBy("id").agg(F.collect_set("line_no").alias("trimmed"))
    hyphens = divided.where("not divided").groupBy("id").agg(F.collect_set(F.struct("left", "right")).alias("hyphens"))
    fixes = misread.groupBy("id").agg(F.collect_set(F.struct("word", "correct")).alias("fixes"))
    noisy = divided.select("id").distinct()
    marks = noisy.join(out, "id", "full").join(trimmed, "id", "full").join(hyphens, "id", "full").join(fixes, "id", "full")
    once = src.select("id", "text").join(marks.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return once.join(marks, "id").mapInArrow(_repair, "id string, text string")
