import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import shapes, splitting, unify
from folioforge.llm.codepoints import decode, encode


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=6))
def test_code_points_round_trip(texts):
    points, offsets = decode(pa.array(texts, pa.string()))
    assert encode(points, offsets).to_pylist() == [t or "" for t in texts]


C = unify
CASES = {
    "ｗｏｒｋ １２": ("work 12", C.COMPATIBILITY),
    "conﬁrms": ("confirms", C.COMPATIBILITY),
    "benötigt": ("benötigt", C.COMBINING),
    "ậ ậ": ("ậ ậ", C.COMBINING),
    "Pfl​ege­": ("Pflege", C.INVISIBLE),
    "a b c　d": ("a b c d", C.BLANK),
    "caрítulо": ("capítulo", C.FOREIGN_LETTER),
    "«отчёт» σχέδιο": (None, 0),
    "\U0001f469‍\U0001f3eb ✅️ \U0001f468‍\U0001f469‍\U0001f467": (None, 0),
    "“x” — … m² ½ ª": (None, 0),
    "x\r\ny\rz": ("x\ny\nz", 0),
    "μm β": (None, 0),
    "": (None, 0),
    "tab\there\nline": (None, 0),
}


def test_unify_cases():
    out, kinds = unify.unify(pa.array([*CASES, None], pa.string()))
    assert out.to_pylist() == [w if w is not None else t for t, (w, _) in CASES.items()] + [None]
    assert kinds.tolist() == [k for _, k in CASES.values()] + [0]
    again, more = unify.unify(out)
    assert again.equals(out) and not more.any()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=[*"aeoncqZ ạéệ", *(chr(c) for c in range(0x300, 0x330))], max_size=8), min_size=1, max_size=4))
def test_marks_compose_like_nfc(texts):
    out, _ = unify.unify(pa.array(texts, pa.string()))
    assert out.to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_many_marks_compose_like_nfc():
    texts = ["a" + "\u0301" * 80 + "\u0323" * 80, "\u0323\u0301" * 70, "q" + "\u0316\u0301\u0327" * 50]
    out, _ = unify.unify(pa.array(texts, pa.string()))
    assert out.to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=4))
def test_unify_is_idempotent(texts):
    once, _ = unify.unify(pa.array(texts, pa.string()))
    twice, kinds = unify.unify(once)
    assert twice.equals(once) and not kinds.any()


def test_unify_in_spark(spark):
    rows = [("a", "ｘ"), ("a", "ｘ"), ("b", "x"), (None, "ｘ"), ("c", None), ("d", ""), ("e", "lóng " * 20000)]
    df = spark.createDataFrame(rows, "id string, v string").select("id", "v", F.lit(1).alias("field"), F.lit(2).alias("kinds"), F.lit(3).alias("t"))
    got = unify.lookalike_values(df, "id", "v", "name").collect()
    assert {(r.field, r.record_id, r.kinds) for r in got} == {("name", "a", 1), ("name", "e", 2)} and len(got) == 2
    assert unify.lookalike_values(df.limit(0), "id", "v", "name").count() == 0


def check_spans(text, limit, overlap, spans):
    o = max(0, overlap) if overlap < limit else limit // 2
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert d > b and b - c == o
    assert all(b - a <= limit for a, b in spans)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n#-1,́", max_size=200), st.integers(2, 40), st.integers(-1, 50))
def test_spans(text, limit, overlap):
    check_spans(text, limit, overlap, splitting.split_spans(text, limit, overlap))


def test_natural_boundaries():
    text = "# One\n\nFirst sentence here. Second no. 5 sentence here.\n\n# Two\n\n- item one is long\n- item two is long\n- item three\n"
    pieces = [text[a:b] for a, b in splitting.split_spans(text, 60, 0)]
    assert pieces[-2].startswith("# Two") or pieces[-1].startswith("# Two")
    assert all(not p.endswith("no. ") for p in pieces) and any(p.startswith("- item") or "# Two" in p for p in pieces)
    words = "word " * 100
    assert all(words[a:b].endswith(" ") for a, b in splitting.split_spans(words, 52, 0))
    check_spans("x" * 1000, 100, 10, splitting.split_spans("x" * 1000, 100, 10))


NESTED = """# Alpha

Opening words of the first part.

## Beta

- apples are red and round
  - gala apples keep long
  - boskop apples are sour
- pears are green and long
  - conference pears are thin

## Gamma

<div><table><tr><td>one two three</td></tr><tr><td>four five six</td></tr></table><p>A paragraph within the div.</p></div>

Closing words of the whole text.
"""


def shape(text, node):
    return (text[node.start : node.end].strip().split("\n")[0][:12], [shape(text, c) for c in node.children])


def test_structure_tree():
    tree = splitting.parse(NESTED)
    (alpha,) = tree.children
    assert [NESTED[c.start :][:6] for c in alpha.children] == ["# Alph", "## Bet", "## Gam"]
    beta, gamma = alpha.children[1:]
    assert shape(NESTED, beta)[1] == [("## Beta", [("## Beta", []), ("- gala apple", []), ("- boskop app", [])]), ("- pears are ", [("- pears are ", []), ("- conference", [])])]
    div = gamma.children[0]
    assert [len(c.children) for c in div.children] == [2, 0] and NESTED[div.end :].strip() == "Closing words of the whole text."


def test_siblings_stay_together():
    """Pieces are subtrees: a greedy cutter from left to right would fill each piece up to the limit instead."""
    pieces = [NESTED[a:b] for a, b in splitting.split_spans(NESTED, 170, 0)]
    assert [p.split("\n")[0][:7] for p in pieces][:2] == ["# Alpha", "## Beta"] or pieces[0].startswith("# Alpha")
    assert any(p.startswith("## Beta") and p.rstrip().endswith("thin") for p in pieces)
    table = next(p for p in pieces if "<table>" in p)
    assert "</table>" in table and "## Gamma" in "".join(pieces[: pieces.index(table) + 1])
    items = "".join(f"- item {i} of the list\n  - below {i}\n" for i in range(20))
    assert all(p.startswith("- item") for p in (items[a:b] for a, b in splitting.split_spans(items, 90, 0)))
    html = "<ul>" + "".join(f"<li>entry {i}<ul><li>sub {i}</li></ul></li>" for i in range(12)) + "</ul>"
    assert all(p.count("<li>") == p.count("</li>") for p in [html[a:b] for a, b in splitting.split_spans(html, 100, 0)])
    sections = "".join(f"## Part {i}\n\n{'words of this part. ' * 4}\n\n" for i in range(9))
    assert all(p.startswith("## Part") for p in (sections[a:b] for a, b in splitting.split_spans(sections, 250, 0)))


def test_overlap_is_the_one_given():
    text = "A sentence of some words stands here. " * 30
    for limit, overlap in ((100, 80), (150, 100), (120, 119), (100, 0)):
        check_spans(text, limit, overlap, splitting.split_spans(text, limit, overlap))


def test_deep_nesting():
    for text in ("<div>" * 3000 + "x " * 500 + "</div>" * 3000, "".join(" " * i + "- item\n" for i in range(600)), "# a\n" * 3000):
        check_spans(text, 300, 30, splitting.split_spans(text, 300, 30))


METADATA = {
    None: (500, 100), "": (500, 100), "{}": (500, 100), "{'chunk_size': 9, 'chunk_overlap': 9": (500, 100), '{"chunk_size": 70}': (70, 100), '{"chunk_size": "70", "chunk_overlap": "5"}': (70, 5),
    '{"splitter": {"chunk_size": "33", "chunk_overlap": 3}}': (33, 3), '{"chunk_size": null, "splitter": {"chunk_size": 12}}': (12, 100), '{"chunk_size": true}': (500, 100), '{"chunk_size": 0, "chunk_overlap": -1}': (500, 100), "[1]": (500, 100), '{"chunk_size": 9, "splitter": {"chunk_overlap": 2}}': (9, 100),
}


def test_limits(spark):
    df = spark.createDataFrame([(k,) for k in METADATA], "m string")
    size, overlap = splitting.limits(F.col("m"))
    assert {r.m: (r.s, r.o) for r in df.select("m", size.alias("s"), overlap.alias("o")).collect()} == METADATA


def test_split_in_spark(spark):
    rows = [("a", "y" * 501, None), ("a", "y" * 501, None), ("b", "y" * 500, None), ("c", None, None), (None, "y" * 900, None), ("d", "", "{}"), ("e", "w. " * 12000, '{"chunk_size": 1000}'), ("f", "😀" * 11, '{"chunk_size": 10, "chunk_overlap": 2}')]
    df = spark.createDataFrame(rows, "id string, t string, m string").select("*", F.lit(1).alias("size"), F.lit(2).alias("piece"), F.lit(3).alias("overlap"))
    got = splitting.split_oversized(df, "id", "t", "m").collect()
    assert {r.id for r in got} == {"a", "e", "f"}
    for key in ("a", "e", "f"):
        text, size = next((t, {"a": 500, "e": 1000, "f": 10}[i]) for i, t, _ in rows if i == key)
        parts = sorted((r.piece_no, r.start, r.end, r.piece) for r in got if r.id == key)
        assert [p[0] for p in parts] == list(range(len(parts))) and all(text[a:b] == p for _, a, b, p in parts)
        check_spans(text, size, {"a": 100, "e": 100, "f": 2}[key], [(a, b) for _, a, b, _ in parts])
    assert splitting.split_oversized(df.limit(0), "id", "t", "m").count() == 0


PROSE = "The committee met in May and decided that the report should be written by the end of the year. Nobody objected to the plan, although the budget was small. "
PAGES = {
    "prose": PROSE * 3,
    "references": PROSE * 2 + "\n[1] A. Writer, Report. 1970. https://a.example/1\n[2] B. Writer, Plan. 1971. https://b.example/2",
    "contents": "1.1 First chapter ........ 3\n1.2 Second chapter ........ 9\n\n" + PROSE,
    "figures": "174 | 938 | 988\n541 | 726 | 107\n" + PROSE,
    "keywords": "best cheap shoes Town, buy cheap shoes Village, cheap red shoes online, best red boots Town, buy boots cheap, red boots Village, cheap shoes",
    "phrases": "small archive Town. shared phase City Village. small archive Port. small archive Hill. shared phase City Lake. small archive Bay. small archive Ford.",
    "links": "<a href=\"http://x.example/a\">shoes</a>\n<a href=\"http://y.example/b\">boots</a>\nhttps://z.example/c",
    "tags": "#shoes #boots #red #cheap #town #village #sale #shop #online #best",
    "trail": "home > shop > shoes > red\nhome > shop > boots > black\nhome :: sale :: boots :: brown\nhome > shop > coats > long",
    "products": "Alpha Z592 205.26 red shoes; Beta Z371 316.09 brown boots; Gamma B335 188.83 long coat; Delta X360 41.45 hat",
    "counts": "shoes (281) boots (327) coats (316) hats (312) scarves (183) gloves (70) belts (154) socks (24) ties (137)",
}
SPAM = {"keywords", "phrases", "links", "tags", "trail", "products", "counts"}


def test_stuffed_pages(spark):
    rows = list(PAGES.items()) + [("tags", PAGES["tags"]), (None, PAGES["tags"]), ("null", None), ("empty", ""), ("blank", " \n "), ("dash", "-"), ("long", PROSE * 2000), ("longspam", PAGES["products"] * 2000)]
    df = spark.createDataFrame(rows, "id string, t string").select("*", F.lit(1).alias("shapes"), F.lit(2).alias("share"))
    got = [r.id for r in shapes.stuffed_pages(df, "id", "t").collect()]
    assert sorted(got) == sorted(SPAM | {"longspam"})
    assert shapes.stuffed_pages(df.limit(0), "id", "t").count() == 0


def test_stuffed_page_of_many_shapes(spark):
    """However many shapes the links of a page have, all of them count."""
    lines = []
    for size in (1, 3, 6, 12, 24):
        for capitals in range(4):
            for numbers in range(4):
                words = ["Offer" if i % 4 < capitals else "77" if i % 4 < capitals + numbers else "cheap" for i in range(size)]
                lines += [f"{' '.join(words)} {'| ' * bars}http://shop" for bars in (0, size // 2, size)]
    links = "\n".join(lines)
    page = links + "\n" + PROSE * (len(links) * 17 // 20 // len(PROSE))
    df = spark.createDataFrame([("many", page)], "id string, t string")
    got = shapes.line_shapes(df, "id", "t").first()
    assert 2 * sum(x.chars for x in got.shapes) > got.total and len(got.shapes) <= shapes.FEW
    assert [r.share for r in shapes.stuffed_pages(df, "id", "t").collect()] == [sum(x.chars for x in got.shapes) / got.total]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_segments_cover_texts(texts):
    s = shapes.segment_shapes(pa.array(texts, pa.string()))
    assert (s["chars"] >= 0).all() and s["chars"].sum() <= sum(map(len, texts))


@pytest.mark.parametrize("text", ["", " ", "\n", ".", "a"])
def test_short_pages(text):
    s = shapes.segment_shapes(pa.array([text]))
    weights = {part: np.zeros(n) for part, n in shapes.PARTS.items()}
    assert not shapes.listed_kinds(s, weights).any() and all(len(x) == len(s["row"]) for x in s.values())


def test_weights_come_from_the_corpus(spark):
    """What speaks for a list is counted: the same page is judged by the corpus that it is in."""
    src = spark.createDataFrame([(t,) for t in PAGES.values()] * 3 + [(None,), ("",)], "t string")
    weights = shapes.learn_weights(src)
    assert set(weights) == set(shapes.PARTS) and all(len(weights[p]) == n and abs(weights[p]).max() <= shapes.MOST for p, n in shapes.PARTS.items())
    assert weights["links"][1] > 0 > weights["links"][0] and weights["function"][0] > 0 > weights["function"][3] and weights["closed"][1] < 0
    prior = shapes.learn_weights(src.limit(0))
    assert any(abs(weights[p] - prior[p]).max() > 0.1 for p in shapes.PARTS)
    s = shapes.segment_shapes(pa.array(list(PAGES.values()) * 3))
    entries, sentences = shapes.seeds(s)
    assert entries.any() and sentences.any() and not (entries & sentences).any()


def test_few_shapes_hold_the_share(spark):
    """Many kinds and lengths of entries, none of them large, are no stuffed page by few shapes."""
    got = shapes.stuffed_pages(spark.createDataFrame([(k, PAGES[k]) for k in SPAM], "id string, t string"), "id", "t", few=1)
    assert {r.id for r in got.collect()} <= SPAM
    mixed = "\n".join(PAGES[k] for k in ("tags", "trail", "products", "counts", "links"))
    df = spark.createDataFrame([("mixed", mixed)], "id string, t string")
    assert shapes.stuffed_pages(df, "id", "t", few=1).count() == 0 and shapes.stuffed_pages(df, "id", "t").count() == 1
