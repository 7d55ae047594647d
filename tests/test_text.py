import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import tokens
from folioforge.operators.chunking import fixed_windows, recursive_chunks, split_recursively


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_white_space_is_pythons(spark):
    odd = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.match(r"\s", chr(c)))
    assert one(spark, T.clean_text(F.col("t")), t=f"{odd}a{odd}b{odd}") == "a b"
    assert one(spark, T.strip(F.col("t")), t=f"{odd}a b{odd}") == "a b"


def test_sizes(spark):
    cases = {"100MB": 100 << 20, "1.5 kb": 1536, "7B": 7, "10 TB": 10 << 40, "MB": None, "5 XB": None, "": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.parse_file_size(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_fences(spark):
    cases = {
        'x ```json {"a": 1} ``` y': '{"a": 1}',
        "```\nplain\n```": "plain",
        "```json open": "```json open",
        "```json open ``` more": "open",
        " none ": "none",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.fenced_json(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == cases
    assert one(spark, T.json_object(F.col("t")), t="[1]") == "{}"
    assert one(spark, T.json_object(F.col("t")), t='{"a":1}') == '{"a":1}'
    assert one(spark, T.json_object(F.col("t")), t="nonsense") == "{}"


def test_authors_and_lists(spark):
    assert one(spark, T.split_authors(F.col("t")), t="A; B, C") == ["A", "B", "C"]
    assert one(spark, T.split_authors(F.col("t")), t=";;") == []
    assert one(spark, T.split_list(F.col("t")), t="a,, b ") == ["a", "", "b"]
    assert one(spark, T.title_words(F.col("t")), t="publication_date") == "Publication Date"


def test_names(spark):
    assert one(spark, T.guess_mime(F.col("t")), t="A.PDF") == "application/pdf"
    assert one(spark, T.guess_mime(F.col("t")), t="none") == "application/octet-stream"
    assert one(spark, T.stem(F.col("t")), t="/x/y.tar.gz") == "y.tar"
    assert one(spark, T.stem(F.col("t")), t=".hidden") == ".hidden"


def test_tokens(spark):
    assert one(spark, tokens.count(F.col("t")), t="  a b c ") == 3
    assert one(spark, tokens.count(F.col("t")), t=" ") == 0
    assert one(spark, tokens.first(F.col("t"), F.lit(2)), t="a b c") == "a b"
    assert one(spark, tokens.first(F.col("t"), F.lit(-1)), t="a b c") == "a b"


def windows(text, size, overlap):
    if len(text) <= size:
        return [text]
    return [text[i : i + size] for i in range(0, len(text), size - overlap)]


def test_fixed_windows(spark):
    texts = ["", "x", "😀é" * 1999 + "z", "a" * 3999, "a" * 4000, "a" * 4001, "b" * 7600, "b" * 7601]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fixed_windows(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [windows(t, 4000, 200) for t in texts]


def model(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The recursive splitter's definition, without sharing its code."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[k], separators[k + 1 :]
    pieces = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    if sep:
        pieces = []
        bits = text.split(sep)
        for i, b in enumerate(bits):
            p = b if i == 0 else sep + b
            if p:
                pieces.append(p)

    def merge(parts):
        out, window = [], []
        for p in parts:
            if window and sum(map(len, window)) + len(p) > size:
                joined = "".join(window).strip()
                if joined:
                    out.append(joined)
                while sum(map(len, window)) > overlap or (sum(map(len, window)) + len(p) > size and window and sum(map(len, window)) > 0):
                    window = window[1:]
            window.append(p)
        joined = "".join(window).strip()
        return out + ([joined] if joined else [])

    out, short = [], []
    for p in pieces:
        if len(p) < size:
            short.append(p)
        else:
            out += merge(short)
            short = []
            out += model(p, size, overlap, rest) if rest else [p]
    return out + merge(short)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(4, 30), st.integers(0, 3))
def test_recursive_splitter(text, size, overlap):
    got = split_recursively(text, size, overlap)
    assert got == model(text, size, overlap)
    assert all(0 < len(c) <= size for c in got)


def test_recursive_chunks_in_spark(spark):
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "one two three " * 60)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", recursive_chunks(F.col("t"), 50, 10).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [None, [], [], split_recursively(rows[3][1], 50, 10)]
