import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="the vocabulary isn't here")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=5))
def test_equals_the_library(ranks, reference, texts):
    encoder = bpe.Encoder(ranks)
    flat, offsets = encoder.encode(texts)
    want = [reference.encode_ordinary(t or "") for t in texts]
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert encoder.count(texts).tolist() == [len(x) for x in want]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_both_merges_agree(ranks, word):
    assert bpe.merge_short(word, ranks) == bpe.merge_long(word, ranks)


def test_column(spark, reference):
    texts = [None, "", " ", "<|endoftext|> is text", "Größe 🏫\r\n\tx", "a" * 5000, "word " * 4000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "i int, text string, ids int")
    got = df.select("i", bpe.token_ids(spark, F.col("text")).alias("x"), bpe.token_count(spark, F.col("text")).alias("n")).orderBy("i").collect()
    assert [r.x for r in got] == [reference.encode_ordinary(t or "") for t in texts]
    assert [r.n for r in got] == [len(r.x) for r in got]
    assert df.limit(0).select(bpe.token_ids(spark, F.col("text"))).count() == 0


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= x]
        if fitting:
            rooms[rooms.index(min(fitting))] -= x
        else:
            rooms.append(capacity - x)
    return sorted(capacity - r for r in rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50), st.data())
def test_plan_is_best_fit_decreasing(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=120))
    histogram = {x: lengths.count(x) for x in lengths}
    slots, made = packing.plan_containers(histogram, capacity)
    fill, placed = {}, {}
    for length, first_rank, n, each, first in slots:
        for r in range(n):
            placed.setdefault(length, []).append(first_rank + r)
            fill[first + r // each] = fill.get(first + r // each, 0) + length
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(v)) for k, v in histogram.items()}
    assert sorted(fill.values()) == best_fit(lengths, capacity) and len(fill) == made


def test_pack(spark):
    rows = [("a", 10), ("b", 25), ("c", 0), ("d", None), ("e", 3), ("e", 3), (None, 7), ("n", -4)] + [(f"h{i}", 4) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, n bigint").withColumn("length", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = packing.pack(df, "id", "n", 10).collect()
    assert sorted((r.start, r.length) for r in got if r.id == "b") == [(0, 10), (10, 10), (20, 5)]
    assert {r.id for r in got if r.container is None} == {"c", "d", "n"}
    fill = {}
    for r in got:
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.length
    assert max(fill.values()) <= 10 and len(got) == 7 + 2 + 500 and sorted(fill) == list(range(len(fill)))
    assert sorted(fill.values()) == best_fit([10, 10, 10, 5, 3, 7] + [4] * 500, 10)
    assert packing.pack(df.limit(0), "id", "n", 10).count() == 0
