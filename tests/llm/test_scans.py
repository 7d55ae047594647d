import random
import textwrap

import pytest
from pyspark.sql import functions as F

from folioforge.llm import scans as S
from folioforge.session import broadcast_if_small

WORDS = "committee report archive budget follow decided meeting library market northern planning village window machine garden question member building session teacher".split()
SCHEMA = "id string, document_id string, page bigint, text string"


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def wrap(text, width=50):
    return "\n".join(textwrap.wrap(text, width, break_on_hyphens=False))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(f"c{d}-{p}", f"clean{d}", p, wrap(prose(rng))) for d in range(30) for p in range(4)]
    for p in range(4):
        body = wrap(prose(rng))
        body = body.replace("committee", "cornmittee").replace("archive", "archlve").replace("budget", "budqet").replace("session", "se55ion", 1)
        head = "Annual Report of the Village" if p else "Annua1 Rep0rt of the Vi1lage"
        out.append((f"n-{p}", "noisy", p, f"{head}\n{body}\n- {p + 17} -"))
    out.append(("h-0", "hyphens", 0, f"{prose(rng, 7)[:-1]} plan-\nning the {prose(rng, 6)[:-1]}\n{prose(rng, 8)}"))
    out.append(("h-1", "hyphens", 1, f"{prose(rng, 7)[:-1]} long-\nterm {prose(rng, 6)[:-1]}\n{prose(rng, 8)}"))
    out += [(f"k{i}", f"kk{i}", 0, f"a long-term {prose(rng, 5)}") for i in range(5)]
    body = wrap(prose(rng)).replace("committee", "cornmitfee", 1)
    out += [("w-0", "twice", 0, f"Minutes of the Garden Club\n{body}\n- 3 -"), ("w-1", "twice", 1, f"Minutes of the Garden Club\n{wrap(prose(rng))}\n- 4 -")]
    out += [("l-0", "lone", 0, wrap(prose(rng)).replace("archive", "archlve", 1)), ("x-0", "xx", 0, wrap(prose(rng)).replace("committee", "cornmitfee", 1))]
    out += [(f"m-{p}", None, p, f"Paper of Nobody in Town\n{wrap(prose(rng))}\n- {p + 2} -") for p in range(3)]
    out += [(f"z-{p}", "chapters", p, (f"Chapter on the Northern Machine\n" if 20 <= p < 23 else "") + wrap(prose(rng))) for p in range(40)]
    out += [(f"b-{p}", "bare", p, f"{p + 8}   Bulletin of the Garden\n{wrap(prose(rng))}") for p in range(3)]
    return out


def found(df):
    return {(r.id, r.noise) for r in S.page_noise(df, "id", "document_id", "page", "text").collect()}


def test_kinds(spark, rows):
    got = found(spark.createDataFrame(rows, SCHEMA))
    # Two confusions in one word count in a scanned document; in another not, nor does a document's only misread word.
    assert {i for i, n in got if n == "misread"} == {f"n-{p}" for p in range(4)} | {"w-0"}
    numbered = {f"n-{p}" for p in range(4)} | {f"b-{p}" for p in range(3)} | {f"m-{p}" for p in range(3)} | {"w-0", "w-1"}
    assert {i for i, n in got if n == "page_number"} == numbered
    assert {i for i, n in got if n == "running_header"} == numbered | {"z-20", "z-21", "z-22"}
    assert {i for i, n in got if n == "hyphenation"} == {"h-0"}  # the corpus writes long-term with a hyphen
    assert not {i for i, _ in got if i.startswith("c")}


def test_repair(spark, rows):
    out = {r.id: r.text for r in S.repair_pages(spark.createDataFrame(rows, SCHEMA), "id", "document_id", "page", "text").collect()}
    for p in range(4):
        assert "\n" not in out[f"n-{p}"] and "Report" not in out[f"n-{p}"] and f"{p + 17}" not in out[f"n-{p}"] and "cornmittee" not in out[f"n-{p}"]
    assert "planning the" in out["h-0"] and "long-term" in out["h-1"]
    assert "Garden" not in out["b-1"] and "committee" in out["w-0"] and "cornmitfee" not in out["w-0"] and "Nobody" not in out["m-1"]


def test_corrections_rank_by_the_corpus(spark):
    """Of two corrections, the one whose confusion the corpus shows more often, though it is a little rarer."""
    words = [("modem", 300), ("modern", 310), ("rnodern", 2), ("barn", 200), ("bam", 190), ("corn", 100), ("com", 1), ("darn", 90), ("dam", 1), ("tarn", 80), ("tam", 1), ("clog", 100), ("dog", 100), ("dcg", 1)]
    got = {r.word: r.correct for r in S.corrections(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert got["com"] == "corn" and got["dam"] == "darn" and got["tam"] == "tarn" and got["rnodern"] == "modern" and "modem" not in got


def test_edges(spark, rows):
    odd = [(None, "x", 0, "a\nb\nc"), ("e1", "x", 0, None), ("e2", "x", 1, ""), ("e3", None, None, "a\nb\nc"), ("e4", "x", 3, "word " * 20000), *rows[:3], *rows[:3]]
    df = spark.createDataFrame(odd, SCHEMA).select("*", F.lit(1).alias("noise"), F.lit(2).alias("word"), F.lit(3).alias("n"), F.lit(4).alias("lines"))
    assert found(df) == set()
    assert found(df.limit(0)) == set()
    assert S.repair_pages(df.limit(0), "id", "document_id", "page", "text").count() == 0


def test_anagram_hash_differences(spark):
    df = spark.createDataFrame([("modern", "modem"), ("clear", "dear")], "a string, b string")
    rows = df.select((S.anagram_hash(F.col("a")) - S.anagram_hash(F.col("b"))).alias("d")).collect()
    rn, m = sum(ord(c) ** 5 for c in "rn"), ord("m") ** 5
    assert rows[0].d == rn - m and rows[1].d == sum(ord(c) ** 5 for c in "cl") - ord("d") ** 5


def test_roman_and_misread_numbers(spark):
    cases = {"xiv": 14, "lvii": 57, "12": 12, "l2": 12, "1O": 10, "abc": None, "iiii": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.n for r in df.select("v", S._value(F.col("v")).alias("n")).collect()} == cases


def test_words_times_confusions_are_not_broadcast(spark, monkeypatch):
    """The driver never holds every rare word with all of its confusions, however small the words' own table is."""
    written = S.materialize
    plans = []

    def kept(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(S, "materialize", kept)
    words = [("committee", 100), ("cornmittee", 1), ("cornmitfee", 1)] + [(f"w{i}ecoatfin", 1) for i in range(500)]
    counts = written(spark.createDataFrame(words, "word string, n bigint"))
    assert {(r.word, r.correct) for r in S.corrections(counts).collect()} == {("cornmittee", "committee")}
    twice = S.double_corrections(counts.where("word = 'cornmitfee'"), counts)
    plans.append(twice._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    assert [(r.word, r.correct) for r in twice.collect()] == [("cornmitfee", "committee")]


def test_long_strings_are_not_broadcast(spark):
    df = spark.createDataFrame([("a" * 1000,), (None,)], "word string")
    hinted = [broadcast_if_small(df, rows, size)._jdf.queryExecution().analyzed().toString() for rows, size in ((10, 1000), (10, 999), (1, 1000))]
    assert ["ResolvedHint" in p for p in hinted] == [True, False, False]
