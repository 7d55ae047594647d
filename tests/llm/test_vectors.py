import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import vectors as V

SCHEMA = "id string, grp string, v array<float>"


def clusters(n, dim=96, size=4, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // size, dim))
    return np.repeat(centres, size, axis=0) + spread * rng.standard_normal((n // size * size, dim))


def brute(rows, k, least):
    """Directed lists by definition."""
    out = set()
    good = {}
    for i, g, v in rows:
        if i is not None and g is not None and v is not None and len(v) == 96 and all(x is not None for x in v):
            x = np.asarray(v, np.float32).astype(np.float64)
            if np.isfinite(x).all() and (x != 0).any():
                good[i] = (g, x / np.linalg.norm(x))
    for i, (g, x) in good.items():
        near = sorted((-round(float(x @ y), 9), j) for j, (h, y) in good.items() if h == g and j != i and x @ y >= least)
        out |= {(i, j) for _, j in near[:k]}
    return out


def lists(df, **kw):
    return {(r.id, r.neighbour_id) for r in V.similar_vectors(df, "id", "grp", "v", 96, **kw).collect()}


def test_hilbert_keys_are_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = V.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_codes_keep_similarities():
    x = clusters(200)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    approximate = V.unpack_codes(V.pack_codes(x.astype(np.float32)))
    assert np.abs(approximate @ approximate.T - x @ x.T).max() < V.CODE_MARGIN


def test_equals_brute_force(spark):
    x = clusters(240)
    rows = [(f"{i:04}", "ab"[i % 5 == 0], [float(a) for a in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert lists(df, k=3, min_similarity=0.8) == brute(rows, 3, 0.8)
    assert lists(df, k=5) == brute(rows, 5, -2)  # windows as wide as the groups lose nothing


def test_edges(spark):
    x = [[float(a) for a in v] for v in clusters(8, seed=3, spread=0.1)]
    rows = [(str(i), "g", x[i]) for i in range(8)]
    rows += [("0", "g", x[0])] * 3  # repeated rows
    rows += [(None, "g", x[0]), ("n1", None, x[0]), ("n2", "g", None), ("n3", "g", [0.0] * 96), ("n4", "g", x[0][:5]), ("n5", "g", [float("nan")] + x[0][1:]), ("n6", "g", [None] + x[0][1:]), ("n7", "g", [float("inf")] + x[0][1:])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 3, 0.8)
    assert want and lists(df, k=3, min_similarity=0.8) == want
    clashing = df.select("id", "grp", "v", F.lit(1).alias("rid"), F.lit("x").alias("code"), F.lit(2).alias("a"), F.lit(3).alias("b"), F.lit(4).alias("keys"), F.lit(5).alias("similarity"))
    assert lists(clashing, k=3, min_similarity=0.8) == want
    assert lists(df.limit(0), k=3) == set()


def test_equal_vectors(spark):
    """A class larger than k fills its own lists, with the first ids; others see its first k."""
    x = [[float(a) for a in v] for v in clusters(4, seed=5, spread=0.2)]
    rows = [(f"c{i:02}", "g", x[0]) for i in range(15)] + [("z1", "g", x[1]), ("z2", "g", x[2])]
    got = lists(spark.createDataFrame(rows, SCHEMA), k=4, min_similarity=0.5)
    assert {b for a, b in got if a == "c09"} == {"c00", "c01", "c02", "c03"}
    assert {b for a, b in got if a == "c02"} == {"c00", "c01", "c03", "c04"}
    assert len({b for a, b in got if a == "z1"}) == 4


@pytest.mark.parametrize("least", [0.8, None])
@pytest.mark.parametrize("rows", [300, 30])
def test_seams_lose_nothing(spark, least, rows):
    """Partitions, also ones shorter than a window, and the seams between them give what one partition gives."""
    x = clusters(800, seed=9)
    df = spark.createDataFrame([(f"{i:04}", "g", [float(a) for a in x[i]]) for i in range(len(x))], SCHEMA)
    kw = dict(k=3, min_similarity=least, curves=3, window=40)
    whole = lists(df, rows_per_partition=10**9, **kw)
    parts = lists(df, rows_per_partition=rows, **kw)
    # Without a threshold each block of a window keeps its best, so seams may only add.
    assert parts == whole if least else len(whole - parts) < 0.02 * len(whole)


def test_seams_pass_empty_and_short_partitions():
    assert V._seams_of([(0, V._HEAD), (0, V._TAIL), (3, V._SHORT), (4, V._SHORT), (9, V._HEAD), (9, V._TAIL), (10, V._HEAD), (10, V._TAIL)]) == [
        (0, V._TAIL, 0), (3, V._SHORT, 0), (4, V._SHORT, 0), (9, V._HEAD, 0), (9, V._TAIL, 1), (10, V._HEAD, 1), (10, V._TAIL, 2)]
    assert V._seams_of([(2, V._SHORT)]) == [(2, V._SHORT, 0)] and V._seams_of([]) == []


def test_asked_rows_only(spark):
    x = clusters(240, seed=2)
    rows = [(f"{i:04}", "ab"[i % 5 == 0], [float(a) for a in x[i]]) for i in range(len(x))] + [("twin", "a", [float(a) for a in x[1]])]
    got = lists(spark.createDataFrame(rows, SCHEMA), k=5, asked=F.col("id").endswith("0") | (F.col("id") == "twin"))
    assert got == {(a, b) for a, b in brute(rows, 5, -2) if a.endswith("0") or a == "twin"}


def test_dense_group_gives_few_candidates():
    """Where all vectors are similar, candidates grow with the rows, and the nearest are among them."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(96) * 3
    for n in (600, 2400):
        x = centre + rng.standard_normal((n, 96))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        hits = V._window_hits(np.ones(n, int), np.arange(n), x, 0, n, 0.5, 40, None)
        i, j = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        assert len(i) <= n * (40 + 40 * -(-n // 512)) and len(i) < n * n / 4
        s = x @ x.T - 2 * np.eye(n, dtype=np.float32)
        got = set(zip(i.tolist(), j.tolist()))
        assert all((max(a, b), min(a, b)) in got for a in range(n) for b in np.argsort(-s[a])[:10].tolist())
        asked = np.arange(n) % 50 == 0
        some = V._window_hits(np.ones(n, int), np.arange(n), x, 0, n, 0.5, 40, asked)
        some = {p for h in some for p in zip(h[0].tolist(), h[1].tolist())}
        assert all((a, b) in some for a in np.nonzero(asked)[0].tolist() for b in np.argsort(-s[a])[:10].tolist()) and all(asked[a] for a, _ in some)


def test_axes_follow_the_sample():
    x = np.random.default_rng(0).standard_normal((500, 20)) * np.r_[5.0, 3.0, np.full(18, 0.1)]
    axes = V.principal_axes(x, 4)
    assert abs(axes.directions[0, 0]) > 0.99 and abs(axes.directions[1, 1]) > 0.99 and (np.diff(axes.variances) <= 0).all()
    assert V.principal_axes(np.zeros((0, 3)), 16).directions.shape == (3, 3)
