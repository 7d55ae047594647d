import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import neardup as N

SCHEMA = "id string, owner string, t string"


def shingles(text, words):
    w = N.WORD.findall(text.lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, least, min_words):
    sets = {}
    for i, o, t in rows:
        if i is not None and t is not None and len(N.WORD.findall(t.lower())) >= max(min_words, words):
            sets.setdefault(i, (o, shingles(t, words)))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) >= least * len(sets[a][1] | sets[b][1])}


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[k] = f"w{rng.randrange(10**6)}"
        elif kind == 1:
            w.insert(k, "new")
        else:
            w.pop(k)
    return " ".join(w)


def corpus(most, seed=1, families=40):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 90))]
        for m in range(rng.randrange(1, 5)):
            rows.append((f"{f:02}-{m}", f"o{rng.randrange(40)}", edited(rng, words, rng.randrange(0, most))))
    return rows


def pairs(df, **kw):
    found = N.near_duplicates(df, "id", "t", "owner", **kw).pairs(True)
    return {(r.id_a, r.id_b) for r in found.collect()}


@pytest.mark.parametrize(("words", "least", "most"), [(3, 0.5, 8), (5, 0.8, 3)])
def test_equals_brute_force(spark, words, least, most):
    rows = corpus(most)
    want = brute(rows, words, least, 20)
    got = pairs(spark.createDataFrame(rows, SCHEMA), words=words, min_similarity=least, min_words=20)
    assert got <= want and len(got) >= 0.98 * len(want) > 5


def test_edges(spark):
    text = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"x{i % 977}y{i}" for i in range(20000))
    rows = [("a", "1", text), ("a", "1", text), ("b", "2", text.upper() + "!"), ("c", "2", text + " more"), ("d", None, text), (None, "9", text), ("e", "3", None), ("f", "4", ""), ("g", "5", "too few words"), ("l1", "6", long), ("l2", "7", long + " end")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {("a", "b"), ("a", "c"), ("l1", "l2")}  # a null owner differs from none for certain
    assert pairs(df, words=3, min_similarity=0.5, min_words=20) == want
    clashing = df.select("*", F.lit(1).alias("rid"), F.lit(2).alias("sig"), F.lit(3).alias("k1"), F.lit(4).alias("token"), F.lit(5).alias("class_id"))
    assert pairs(clashing, words=3, min_similarity=0.5, min_words=20) == want
    empty = N.near_duplicates(df.limit(0), "id", "t")
    assert empty.pairs(False).count() == 0 and empty.groups().count() == 0 and empty.members.count() == 0


def test_copies_do_not_make_all_pairs(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(f"{i:03}", str(i), text) for i in range(N.ALL_PAIRS + 20)] + [("z", "z", text + " more words")]
    found = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "t", "owner", words=3, min_similarity=0.5)
    got = {(r.id_a, r.id_b) for r in found.pairs(True).collect()}
    n = N.ALL_PAIRS + 20
    assert {b for a, b in got if a == "000"} == {f"{i:03}" for i in range(1, n)} | {"z"} and len(got) == 2 * n - 1
    groups = found.groups().collect()
    assert len({r.group_id for r in groups}) == 1 and {r.n_links for r in groups} == {1} and len(groups) == n + 1


def test_large_classes_keep_members_of_the_first_ones_owner(spark):
    """Whoever has a partner of another owner in its class or a linked one comes out, however large they are."""
    text = " ".join(f"word{i}" for i in range(30))
    one = [(f"a{i:03}", "D" if i < 39 else f"o{i}", text) for i in range(N.ALL_PAIRS + 5)]
    two = [(f"b{i:03}", "D", text + " more words") for i in range(N.ALL_PAIRS + 5)]
    unowned = [("a", None, text)]  # the least id stands for nobody
    lone = [(f"c{i:03}", "E", " ".join(f"x{i}" for i in range(30))) for i in range(N.ALL_PAIRS + 5)]
    rows = one + two + unowned + lone
    got = pairs(spark.createDataFrame(rows, SCHEMA), words=3, min_similarity=0.5)
    assert got <= brute(rows, 3, 0.5, 0) and {x for p in got for x in p} == {i for i, _, _ in one + two}
    assert len(got) <= 2 * len(rows)
    inside = {p for p in got if p[1] < "b"}
    assert {p for p in inside if p[0] < "a039"} == {("a000", f"a{i:03}") for i in range(39, len(one))} | {(f"a{i:03}", "a039") for i in range(39)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r.class_id: r.group_id for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_long_lists_stream(spark):
    """A token of more rows than a batch holds passes whole."""
    df = spark.range(0, 300_000).select(F.lit(7).cast("bigint").alias("token"), F.col("id").alias("rid")).union(spark.createDataFrame([(8, 1), (9, 1), (9, 2)], "token bigint, rid bigint"))
    out = df.repartition(1).sortWithinPartitions("token").mapInArrow(N._shared(1), "token bigint, rid bigint, n bigint")
    assert {r.token: r["count"] for r in out.groupBy("token").count().collect()} == {7: 300_000, 9: 2}


def test_parts_of_a_long_list_stay_whole(spark):
    """The one row that follows a stretch is no lone posting, and all stretches rank alike."""
    df = spark.range(0, 210_001).select(F.lit(7).cast("bigint").alias("token"), F.col("id").alias("rid")).union(spark.createDataFrame([(8, 1), (9, 1), (9, 2)], "token bigint, rid bigint"))
    out = df.repartition(1).sortWithinPartitions("token").mapInArrow(N._shared(1), "token bigint, rid bigint, n bigint")
    assert {(r.token, r.n): r["count"] for r in out.groupBy("token", "n").count().collect()} == {(7, 0): 210_001, (9, 2): 2}


def test_salted_tokens_rank_alike(spark, monkeypatch, request):
    """Classes that agree in just two coordinates, both hot, meet although their parts of the lists differ in length."""
    n, twins = 1100, range(500, 580)

    def signed(*_):
        def run(batches):
            for b in batches:
                i = np.array([int(x) for x in b.column("id").to_pylist()], np.int64)
                sig = np.stack([i, i, i]).T.astype(np.int32)
                both = np.isin(i, twins)
                sig[(i % 2 == 0) | both, 0] = -1
                sig[(i % 2 == 1) | both, 1] = -2
                flat = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, 3, dtype=np.int32), sig.ravel())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("owner"), pa.array(i), pa.array(i), flat], ["id", "owner", "k1", "k2", "sig"])

        return run

    monkeypatch.setattr(N, "_sign", signed)
    # Small parts would be put together again.
    for key, value in {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
        before = spark.conf.get(key)
        spark.conf.set(key, value)
        request.addfinalizer(lambda key=key, before=before: spark.conf.set(key, before))
    rows = [(f"{i:04}", str(i), " ".join(f"w{i // 2 * 2 if i in twins else i}x{k}" for k in range(30)) + " more" * (i % 2)) for i in range(n)]
    assert pairs(spark.createDataFrame(rows, SCHEMA).coalesce(1), words=3, min_similarity=0.5, coords=3) == {(f"{i:04}", f"{i + 1:04}") for i in twins[::2]}


def family(n, kept, owners, seed=3):
    """Texts that share a boilerplate of ``kept`` of their 120 words."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(kept)]
    return [(f"{i:05}", f"o{i % owners}", " ".join(common + [f"w{rng.randrange(10**7)}" for _ in range(120 - kept)])) for i in range(n)]


def test_families_grow_linearly(spark, monkeypatch):
    """Near-copies pair with their leaders: of each two, the link comes out or those of both with a common one."""
    sizes = []
    plain = N.materialize

    def counting(df, name="step"):
        out = plain(df, name)
        if name == "candidates":
            sizes[-1] += out.count()
        return out

    monkeypatch.setattr(N, "materialize", counting)
    for n in (300, 1200):
        sizes.append(0)
        rows = family(n, 110, 7)
        found = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "t", "owner", words=3, min_similarity=0.5)
        got = {(r.id_a, r.id_b) for r in found.pairs(True).collect()}
        assert got <= brute(rows, 3, 0.5, 0) if n == 300 else len(got) < 60 * n
        assert {x for p in got for x in p} == {r[0] for r in rows}
        groups = found.groups().collect()
        assert len(groups) == n and len({r.group_id for r in groups}) == 1 and all(r.n_links for r in groups)
        near = {}
        for a, b in got:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        if n == 300:
            owner = {r[0]: r[1] for r in rows}
            assert all((a, b) in got or {x for x in near[a] | {a} if owner[x]} & (near[b] | {b}) for a, b in brute(rows, 3, 0.5, 0))
    assert sizes[1] < 60 * 1200 < 1200 * 1199 / 2


def test_boilerplate_of_unlike_texts(spark):
    """Texts whose shared part isn't enough meet under two coordinates; the few that are alike come out, all of them."""
    rows = family(400, 70, 11)
    rng = random.Random(8)
    rows += [(f"t{i}", "x", edited(rng, rows[i * 9][2].split(), 3)) for i in range(40)]
    assert pairs(spark.createDataFrame(rows, SCHEMA), words=3, min_similarity=0.5) == brute(rows, 3, 0.5, 0)


def test_stripes_of_a_long_list_lose_nothing(spark, monkeypatch):
    rows = family(300, 85, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = pairs(df, words=3, min_similarity=0.5)
    monkeypatch.setattr(N, "STRIPE", 7)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)  # the way without broadcasts, too
    assert pairs(df, words=3, min_similarity=0.5) == whole


@pytest.mark.parametrize("stripe", [N.STRIPE, 7])
def test_whole_lists_leave_no_pair_out(spark, monkeypatch, stripe):
    """Families, large classes of copies, pairs at the threshold and sets of few shingles: all pairs and all links."""
    monkeypatch.setattr(N, "STRIPE", stripe)
    rng = random.Random(6)
    rows = family(N.LONG + 40, 110, 7)
    rows += [(f"c{i:03}", f"o{i % 9}", " ".join(f"y{k}" for k in range(30))) for i in range(N.ALL_PAIRS + 10)]
    for i in range(60):
        words = [f"p{rng.randrange(10**7)}" for _ in range(62)]
        # 60 shingles each, of which 40 are shared: exactly a half of the union.
        rows += [(f"p{i}-a", "a", " ".join(words)), (f"p{i}-b", "b", " ".join(words[:42] + [f"q{rng.randrange(10**7)}" for _ in range(20)]))]
    rows += [("r1", "a", "la " * 25), ("r2", "b", "la " * 30 + "li"), ("r3", "c", "la li " * 12), ("r4", "d", "li la " * 15 + "lo")]
    found = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "t", "owner", words=3, min_similarity=0.5, min_words=20, whole=True)
    got = [(r.id_a, r.id_b) for r in found.pairs(True).collect()]
    want = brute(rows, 3, 0.5, 20)
    assert len(got) == len(set(got)) and set(got) == want and ("r1", "r2") in want and sum(a[0] == "p" for a, _ in want) == 60
    links = {r.id: r.n_links for r in found.groups().collect()}
    sets = {i: frozenset(shingles(t, 3)) for i, _, t in rows}
    kinds = set(sets.values())
    assert all(links[i] == sum(x != y and 2 * len(x & y) >= len(x | y) for y in kinds) for i, x in sets.items())


def test_whole_lists_of_nothing(spark):
    empty = N.near_duplicates(spark.createDataFrame([], SCHEMA), "id", "t", whole=True)
    assert empty.pairs(False).count() == 0 and empty.groups().count() == 0 and empty.members.count() == 0
