"""Most similar vectors for every vector, by shifted space-filling curves.

Each curve projects the vectors onto a few random orthogonal directions within the principal axes of a bounded sample,
shifts and cuts them into a grid, and orders the cells along a Hilbert curve. Spark range-partitions all orderings at once by (curve, group, key); within
each ordering a window of neighbouring keys is compared by 4-bit codes; the windows of all curves merge, and the
surviving pairs are reranked by exact cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import materialize

#: Vectors that the axes of the curves are fitted on, and how many axes there are.
SAMPLE = 4096
AXES = 16
#: How much a threshold is lowered for 4-bit codes: five standard deviations of a similarity's error.
CODE_MARGIN = 0.08


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows of coordinates below 2**bits), as int64."""
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    dims = len(x)
    assert dims * bits <= 63, "a key has at most 63 bits"
    # From the highest bit down: undo the reflection and exchange of axes within each sub-cube.
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(dims):
            inverted = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(inverted, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
    # Gray code across the axes.
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> np.uint32(level)) & np.uint32(1)).astype(np.int64)
    return key


@dataclass
class Axes:
    """The directions in which a bounded sample of unit vectors varies most, with the variance along each."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray


def principal_axes(sample: np.ndarray, axes: int) -> Axes:
    """Axes of a sample of unit vectors (rows); those of the coordinates if there are fewer than two."""
    width = sample.shape[1]
    if len(sample) < 2:
        return Axes(np.zeros(width, np.float32), np.eye(width, min(axes, width), dtype=np.float32), np.full(min(axes, width), 1 / width))
    mean = sample.mean(0, dtype=np.float64)
    values, vectors = np.linalg.eigh(np.cov(sample.astype(np.float64).T).reshape(width, width))
    values, vectors = values[::-1][:axes], vectors[:, ::-1][:, :axes]
    return Axes(mean.astype(np.float32), np.ascontiguousarray(vectors, np.float32), np.maximum(values, 1e-9))


def curve_keys(unit: np.ndarray, axes: Axes, curves: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """One key a curve for unit vectors, shape (rows, curves)."""
    z = (unit - axes.mean) @ axes.directions
    width = z.shape[1]
    dims = min(dims, width)
    out = np.empty((len(unit), curves), np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, c])
        basis, _ = np.linalg.qr(rng.standard_normal((width, dims)))
        spread = np.sqrt((basis**2 * axes.variances[:, None]).sum(0))
        shift = rng.random(dims) * 0.5 - 0.25
        # A logistic curve near the normal distribution function spreads the projections evenly over the grid.
        even = 1 / (1 + np.exp(np.clip(-1.702 * (z @ (basis / spread).astype(np.float32) + shift), -60, 60)))
        out[:, c] = hilbert_keys(np.clip(even * (1 << bits), 0, (1 << bits) - 1), bits)
    return out


def pack_codes(unit: np.ndarray) -> np.ndarray:
    """4-bit codes, two a byte, on a grid over 2.8 standard deviations of a uniform direction.

    A fixed rotation comes first, so that vectors with few large coordinates spread over all of them.
    """
    rows, width = unit.shape
    turn, _ = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    unit = unit @ turn.astype(np.float32)
    step = 2.8 / np.sqrt(width) / 7
    q = (np.clip(np.rint(unit / step), -7, 7) + 8).astype(np.uint8)
    if width % 2:
        q = np.hstack([q, np.full((rows, 1), 8, np.uint8)])
    return (q[:, ::2] << 4) | q[:, 1::2]


def unpack_codes(packed: np.ndarray) -> np.ndarray:
    """Approximate unit vectors from codes, rotated."""
    out = np.empty((len(packed), packed.shape[1] * 2), np.float32)
    out[:, ::2] = (packed >> 4).astype(np.float32) - 8
    out[:, 1::2] = (packed & 15).astype(np.float32) - 8
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), dim)


def _fixed(column: pa.Array) -> np.ndarray:
    """Binary values of one length as a byte matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _sketch(dim: int, axes: Axes, curves: int, dims: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            x = _matrix(b.column("v"), dim)
            with np.errstate(all="ignore"):
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                good = np.isfinite(norm) & (norm > 0)
            b, x = b.filter(pa.array(good)), x[good]
            if not len(x):
                continue
            unit = (x / norm[good, None]).astype(np.float32)
            digest = np.frombuffer(b"".join(hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x + 0.0), np.uint8).reshape(-1, 16)
            keys = curve_keys(unit, axes, curves, dims, bits, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("grp"), b.column("wanted"), _binary(digest), _binary(pack_codes(unit)), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, curves, dtype=np.int32), keys.ravel())],
                ["id", "grp", "wanted", "vhash", "code", "keys"],
            )

    return run


def _best(s: np.ndarray, axis: int, least: float, top: int) -> np.ndarray:
    """Where s is at least ``least`` and among the ``top`` highest along an axis, ties with the last included."""
    keep = s >= least
    full = np.nonzero(keep.sum(axis) > top)[0]
    if len(full):
        part = s[full] if axis == 1 else s[:, full].T
        last = np.partition(part, part.shape[1] - top, axis=1)[:, part.shape[1] - top, None]
        if axis == 1:
            keep[full] &= part >= last
        else:
            keep[:, full] &= (part >= last).T
    return keep


def _window_hits(segment: np.ndarray, rid: np.ndarray, x: np.ndarray, start: int, window: int, least: float, top: int, wanted: np.ndarray | None):
    """Pairs of rows i >= start with up to ``window`` rows before each, in one segment (curve and group), and their similarity.

    A row keeps its best among those before it, and so does each as seen from later ones. With ``wanted`` only pairs
    that have such a row are made, which comes first.
    """
    out = []

    def take(rows: np.ndarray, columns: np.ndarray, axes: tuple[int, ...]) -> None:
        if not len(rows) or not len(columns):
            return
        s = x[rows] @ x[columns].T
        row, col = rows[:, None], columns[None, :]
        bad = (col >= row) | (row - col > window)
        if segment[columns[0]] != segment[rows[-1]]:
            bad |= segment[rows, None] != segment[None, columns]
        s[bad] = -2
        keep = _best(s, axes[0], least, top)
        if len(axes) > 1:
            keep |= _best(s, axes[1], least, top)
        i, j = np.nonzero(keep)
        if len(i):
            found = (rid[rows[i]], rid[columns[j]], s[i, j])
            if wanted is None:
                out.append(found)
            else:
                a, b = wanted[rows[i]], wanted[columns[j]]
                out.append(tuple(x[a] for x in found))
                out.append((found[1][b], found[0][b], found[2][b]))

    asked = None if wanted is None else np.nonzero(wanted)[0]
    for lo in range(start, len(x), 512):
        hi = min(lo + 512, len(x))
        left = max(0, lo - window)
        rows, columns = np.arange(lo, hi), np.arange(left, hi)
        if asked is None:
            take(rows, columns, (1, 0))
        else:
            inside = asked[np.searchsorted(asked, left) : np.searchsorted(asked, hi)]
            take(inside[inside >= lo], columns, (1,))
            take(rows, inside, (0,))
    return out


def _ordered(hits: list[tuple], asked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits as three arrays, the lesser row of a pair first unless the asked one is."""
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    a, b, score = (np.concatenate(x) for x in zip(*hits, strict=True))
    return (a, b, score.astype(np.float32)) if asked else (np.minimum(a, b), np.maximum(a, b), score.astype(np.float32))


def _segments(curve: np.ndarray, grp: np.ndarray) -> np.ndarray:
    change = np.ones(len(grp), bool)
    change[1:] = (curve[1:] != curve[:-1]) | (grp[1:] != grp[:-1])
    return np.cumsum(change)


#: Sides of a partition: its first rows, its last ones, or all of one that is no longer than a window.
_HEAD, _TAIL, _SHORT = range(3)
_FOUND = "a bigint, b bigint, score float, part bigint, side bigint, pos bigint, curve bigint, code binary, wanted boolean"


def _windows(window: int, least: float, top: int, asked: bool):
    """Within a sorted range partition: pairs from windows, and the rows at both ends for the seams."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail: tuple | None = None
        head: list[tuple] = []
        rows = 0

        def pairs(hits):
            a, b, score = _ordered(hits, asked)
            n = len(a)
            nothing = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score), nothing, nothing, nothing, nothing, pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], names)

        def edge(side, pos, seg, grp, rid, raw, wanted):
            n = len(rid)
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(grp), pa.nulls(n, pa.float32()), pa.array(np.full(n, part)), pa.array(np.full(n, side)), pa.array(np.arange(n) + pos), pa.array(seg), _binary(raw), pa.array(wanted)], names)

        for b in batches:
            if not b.num_rows:
                continue
            new = (b.column("curve").to_numpy().astype(np.int64), b.column("gid").to_numpy(), b.column("rid").to_numpy(), _fixed(b.column("code")), b.column("wanted").to_numpy(zero_copy_only=False).astype(bool))
            if rows < window:
                head.append(tuple(x[: window - rows] for x in new))
            rows += b.num_rows
            start = 0 if tail is None else len(tail[0])
            held = new if tail is None else tuple(np.concatenate([t, n]) for t, n in zip(tail, new, strict=True))
            curve, grp, rid, raw, wanted = held
            hits = _window_hits(_segments(curve, grp), rid, unpack_codes(raw), start, window, least, top, wanted if asked else None)
            if hits:
                yield pairs(hits)
            tail = tuple(x[-window:] for x in held)
        if tail is not None:
            if rows <= window:
                yield edge(_SHORT, 0, *tail)
            else:
                yield edge(_HEAD, 0, *(np.concatenate(x) for x in zip(*head, strict=True)))
                yield edge(_TAIL, rows - len(tail[0]), *tail)

    return run


def _seams_of(sides: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``part, side, seam`` of non-empty partitions: neighbours meet at a seam, and one shorter than a window joins its two."""
    kinds: dict[int, set[int]] = {}
    for part, side in sides:
        kinds.setdefault(part, set()).add(side)
    out, seam = [], 0
    for k, part in enumerate(sorted(kinds)):
        if _SHORT in kinds[part]:
            out.append((part, _SHORT, seam))
        else:
            if k:
                out.append((part, _HEAD, seam))
                seam += 1
            out.append((part, _TAIL, seam))
    return out


def _seam(window: int, least: float, top: int, asked: bool):
    """The rows on both sides of boundaries between partitions; only pairs that cross one are new."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("pos", "ascending")])
        curve, grp, rid, part = (t.column(c).to_numpy() for c in ("curve", "b", "a", "part"))
        start = int((part == part[0]).sum())
        wanted = t.column("wanted").to_numpy(zero_copy_only=False).astype(bool) if asked else None
        hits = _window_hits(_segments(curve, grp), rid, unpack_codes(_fixed(t.column("code"))), start, window, least, top, wanted) if start < len(rid) else []
        return pa.table(dict(zip(("a", "b", "score"), _ordered(hits, asked), strict=True)))

    return run


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b.column("va"), dim).astype(np.float64), _matrix(b.column("vb"), dim).astype(np.float64)
            s = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s)], ["a", "b", "similarity"])

    return run


def _sampled(src: DataFrame, n_rows: int, dim: int, size: int) -> np.ndarray:
    """Unit vectors of about ``size`` rows, or of all if there are fewer; which, is decided by a hash of their ids."""
    if n_rows > size:
        src = src.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(size / n_rows * (1 << 40))))
    x = _matrix(src.select("v").toArrow().column("v"), dim).astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x**2).sum(1, keepdims=True))
        good = (np.isfinite(norm) & (norm > 0)).ravel()
        return x[good] / norm[good]


def similar_vectors(
    df: DataFrame,
    id_col: str,
    group_col: str,
    vector_col: str,
    dim: int,
    k: int = 10,
    min_similarity: float | None = None,
    asked: Column | None = None,
    curves: int = 16,
    window: int | None = None,
    dims: int = 12,
    bits: int = 3,
    seed: int = 7,
    rows_per_partition: int = 65536,
    sample: int = SAMPLE,
) -> DataFrame:
    """Directed neighbour lists: ``id, neighbour_id, similarity, rank`` (rank 1 to k, ties by neighbour_id).

    Only rows of the same ``group_col`` are neighbours. Rows whose id or group is null, or whose vector is null, has
    null, NaN or infinite numbers, is all zeros or is not of ``dim`` numbers, take no part. Repeated rows (one id,
    one vector) count once. Rows of exactly equal vectors form a class that goes through the curves as one row; its
    members come out as each other's neighbours with similarity 1 (of the numerically highest), in the order of ids.

    With ``asked`` (a condition on ``df``) only such rows get a list, against all rows. With ``min_similarity`` no
    neighbour below it is listed. ``window`` is 512 with a threshold, else a ninetieth of the largest group if that is
    more: neighbours that are hardly nearer than the rest move apart along the curves as a group grows. Within a
    window a row keeps its best 4 k (40 at least) a side and curve, so groups however dense give a bounded number of candidates a
    row. The axes of the curves are fitted on about ``sample`` vectors. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    spark = df.sparkSession
    wanted = F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(True)
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vector_col).cast("array<float>").alias("v"), wanted.alias("wanted"))
    src = src.where(F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    axes = principal_axes(_sampled(src, df.count(), dim, sample), AXES)
    sketch = src.mapInArrow(_sketch(dim, axes, curves, dims, bits, seed), "id string, grp string, wanted boolean, vhash binary, code binary, keys array<bigint>")
    base = materialize(sketch.withColumn("rid", F.monotonically_increasing_id()), "sketch")
    # Classes of equal vectors; the first row stands for its class.
    classes = base.groupBy("grp", "vhash").agg(F.min("rid").alias("first_rid"), F.count_distinct("id").alias("n"), F.count("*").alias("n_rows"), F.max("wanted").alias("any_wanted")).where("n_rows > 1")
    classes = materialize(classes, "classes")
    marked = base.join(classes, ["grp", "vhash"], "left").withColumn("cid", F.coalesce("first_rid", "rid"))
    reps = marked.where("cid = rid").select("rid", F.xxhash64("grp").alias("gid"), "code", "keys", F.coalesce("any_wanted", "wanted").alias("wanted"))
    sizes = base.groupBy("grp").count().agg(F.sum("count").alias("n"), F.max("count").alias("largest")).first()
    n_rows = sizes.n or 0
    if window is None:
        window = max(512, 0 if min_similarity is not None else -(-(sizes.largest or 0) // 90))
    # Partitions stream, so that their number needn't grow without end.
    parts = max(1, n_rows * curves // max(rows_per_partition, n_rows * curves // 20_000) + 1)
    least = -1.5 if min_similarity is None else min_similarity - CODE_MARGIN
    shape = (window, least, max(4 * k, 40), asked is not None)
    ordered = (
        reps.select("rid", "gid", "code", "wanted", F.posexplode("keys").alias("curve", "key"))
        .repartitionByRange(parts, "curve", "gid", "key", "rid")
        .sortWithinPartitions("curve", "gid", "key", "rid")
        .select("curve", "gid", "rid", "code", "wanted")
    )
    found = materialize(ordered.mapInArrow(_windows(*shape), _FOUND), "windows")
    scored = found.where("part is null").select("a", "b", "score")
    # A row for each side of a partition goes to the driver, which knows then where partitions are empty or short.
    seams = _seams_of([(r.part, r.side) for r in found.where("part is not null").select("part", "side").distinct().collect()])
    if len({part for part, _, _ in seams}) > 1:
        at = spark.createDataFrame(seams, "part bigint, side bigint, seam bigint")
        scored = scored.unionByName(found.where("part is not null").join(F.broadcast(at), ["part", "side"]).groupBy("seam").applyInArrow(_seam(*shape), "a bigint, b bigint, score float"))
    scored = scored.groupBy("a", "b").agg(F.max("score").alias("score"))
    # Of what a row met on all curves its best by codes are reranked.
    directed = scored if asked is not None else scored.union(scored.select("b", "a", "score"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    best = directed.withColumn("nth", nth).where(F.col("nth") <= max(8 * k, 80))
    pairs = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # Exact similarities: the vectors of the rows that are in any pair.
    used = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct().join(base.select("rid", "id", "grp"), "rid")
    vectors = materialize(src.select("id", "grp", "v").join(used, ["id", "grp"]).groupBy("rid").agg(F.first("v").alias("v")), "vectors")
    exact = (
        pairs.join(vectors.select(F.col("rid").alias("a"), F.col("v").alias("va")), "a")
        .join(vectors.select(F.col("rid").alias("b"), F.col("v").alias("vb")), "b")
        .mapInArrow(_cosines(dim), "a bigint, b bigint, similarity double")
    )
    if min_similarity is not None:
        exact = exact.where(F.col("similarity") >= min_similarity)
    size = classes.select(F.col("first_rid").alias("a"), "n")
    both = exact.union(exact.select("b", "a", "similarity")).union(classes.where("n > 1").select("first_rid", "first_rid", F.lit(1.0)))
    # A class of more than k members fills its own lists.
    both = materialize(both.join(size, "a", "left").where((F.coalesce("n", F.lit(1)) <= k) | (F.col("a") == F.col("b"))).select("a", "b", "similarity"), "both")
    members = marked.select("cid", "id", "wanted").distinct()
    # Of every class its first k + 1 members: with itself left out, enough for any list.
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("nth") <= k + 1).select(F.col("cid").alias("b"), F.col("id").alias("neighbour_id"))
    lists = members.where("wanted").select(F.col("cid").alias("a"), "id").join(both, "a").join(first, "b").where("id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id"))
    return lists.select("id", "neighbour_id", "similarity", rank.alias("rank")).where(F.col("rank") <= k)


def undirected(lists: DataFrame) -> DataFrame:
    """Neighbour lists as distinct pairs ``chunk_id_a < chunk_id_b``."""
    return lists.select(F.least("id", "neighbour_id").alias("chunk_id_a"), F.greatest("id", "neighbour_id").alias("chunk_id_b")).distinct()
