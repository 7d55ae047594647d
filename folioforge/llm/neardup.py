"""Near-duplicate records with small edits, by an inverted join on signature coordinates.

Every text becomes the set of its word shingles, every distinct set a class with a signature: each coordinate holds
the hash of the minima of the set under a few random functions. A class is posted under each (coordinate, value) that
another class has too. A pair above the threshold agrees in at least ``matches`` coordinates; so, with the postings
of each class in the order of their frequency, only a prefix that leaves out the ``matches - 1`` most frequent needs
merging: the long lists are skipped and probed through the signatures themselves. What has enough collisions is
compared by the exact sets.

A family of near-copies may be as large as a third of all classes. Lists of more than LONG classes therefore don't
merge: their members are compared with the list's leaders, and only what isn't similar to the first leader meets the
others, by pairs of coordinates. Of each two similar classes, so, either the link comes out or those of both with one leader.

With ``whole`` nothing is left out: every set is posted under the first of its shingles in one order for all sets, so
many that two similar sets share at least AGREE of them; whatever shares so many is compared by the exact sets.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import broadcast_if_small, materialize

WORD = re.compile(r"[^\W_]+")
#: Classes of exact copies up to so many members come out as all pairs; of larger ones every member pairs with one that stands for it.
ALL_PAIRS = 64
#: Classes that a token has at most for all of their pairs to be compared; those of a longer list meet its leaders first.
LONG = 64
#: Rows of a list that a task joins with all others of it.
STRIPE = 4096
#: Shingles of the posted ones that two similar sets share at least (fewer, if they are similar with fewer).
AGREE = 3
#: Buckets of the hashed counts of shingles, which bounds what is sent to the driver and back, and those of a row of them.
BUCKETS, BUCKET_STRIPE = 1 << 24, 1 << 16
#: Words whose hashes a worker keeps.
CACHED_WORDS = 400_000
#: Rows up to which a materialized list of keys is broadcast (at about 50 bytes a row).
BROADCAST_ROWS = 200_000


class _Words(dict):
    """Word to 64-bit hash; fills itself."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[str], words: int, known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles in one array, the end of each text's part, and its number of words."""
    tokens: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = WORD.findall(t.lower())
        counts[i] = len(found)
        tokens += found
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    row = np.repeat(np.arange(len(texts)), counts)
    n = max(0, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for k in range(words):
        s = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    inside = row[:n] == row[words - 1 : words - 1 + n]
    s, row = s[inside], row[:n][inside]
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(texts)), side="right"), counts


def signatures(s: np.ndarray, starts: np.ndarray, coords: int, per_coord: int, seed: int) -> np.ndarray:
    """Coordinates of non-empty sets, shape (sets, coords), as 32-bit values."""
    rng = np.random.default_rng(seed)
    mixed = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(12)
    out = np.empty((len(starts), coords), np.uint32)
    for c in range(coords):
        value = np.zeros(len(starts), np.uint64)
        for _ in range(per_coord):
            factor, offset = (np.uint32(x) for x in rng.integers(0, 2**32, 2, dtype=np.uint64))
            lowest = np.minimum.reduceat((mixed ^ offset) * (factor | np.uint32(1)), starts)
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + lowest
        out[:, c] = ((value * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)
    return out


def _good_sets(batches: Iterator[pa.RecordBatch], words: int, min_words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with enough words, all of their shingles, and where each one's begin and how many they are."""
    known = _Words()
    for whole in batches:
        for lo in range(0, whole.num_rows, 2000):
            b = whole.slice(lo, 2000)
            s, ends, counts = shingle_sets(b.column("t").to_pylist(), words, known)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            good = (counts >= max(min_words, words)) & (ends > starts)
            if not good.any():
                continue
            # Only rows with shingles have a part, so the parts of good rows follow each other within s.
            keep = np.repeat(good, ends - starts)
            s, size = s[keep], (ends - starts)[good]
            yield b.filter(pa.array(good)), s, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size
        if len(known) > CACHED_WORDS:
            known.clear()


def _keys(s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set."""
    twist = (s ^ (s >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    k1 = np.add.reduceat(twist ^ (twist >> np.uint64(29)), starts).view(np.int64)
    return k1, np.bitwise_xor.reduceat((s * np.uint64(0xC4CEB9FE1A85EC53)) ^ (s >> np.uint64(17)), starts).view(np.int64)


def _sign(words: int, min_words: int, coords: int, per_coord: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s, starts, _ in _good_sets(batches, words, min_words):
            k1, k2 = _keys(s, starts)
            sig = signatures(s, starts, coords, per_coord, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("owner"), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(np.arange(0, sig.size + 1, coords, dtype=np.int32), sig.view(np.int32).ravel())],
                ["id", "owner", "k1", "k2", "sig"],
            )

    return run


def _counted(words: int, min_words: int):
    """Hashed counts of all shingles, by stripes of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for _, s, _, _ in _good_sets(batches, words, min_words):
            at, n = np.unique((s & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
            total[at] += n.astype(np.uint32)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(-1, BUCKET_STRIPE)
        for k in np.nonzero(parts.any(1))[0]:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(parts[k].tobytes(), 1)], pa.binary())], ["stripe", "counts"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    total = np.zeros(BUCKET_STRIPE, np.uint32)
    for x in t.column("counts"):
        total = np.minimum(total + np.frombuffer(zlib.decompress(x.as_py()), np.uint16), 65535)
    return pa.table({"stripe": t.column("stripe")[:1], "counts": pa.array([total.astype(np.uint16).tobytes()], pa.binary())})


def shingle_counts(src: DataFrame, words: int, min_words: int) -> np.ndarray:
    """How often shingles occur, hashed into BUCKETS counts of two bytes, whatever their number.

    They only decide the order of shingles, and so how long lists get: the same pairs come out in any order.
    """
    out = np.zeros(BUCKETS, np.uint16)
    kind = "stripe bigint, counts binary"
    for r in src.mapInArrow(_counted(words, min_words), kind).groupBy("stripe").applyInArrow(_summed, kind).toLocalIterator():
        out[r.stripe * BUCKET_STRIPE : (r.stripe + 1) * BUCKET_STRIPE] = np.frombuffer(r.counts, np.uint16)
    return out


def _prefixes(words: int, min_words: int, min_similarity: float, shared):
    """Keys of each set and its posted shingles: the least frequent |set| - (what a similar set must share) + AGREE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = shared.value
        for b, s, starts, size in _good_sets(batches, words, min_words):
            k1, k2 = _keys(s, starts)
            # Each shingle turns one of 128 bits over.
            bit = (s * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(57)
            flip = np.uint64(1) << (bit & np.uint64(63))
            low, high = (pa.array(np.bitwise_xor.reduceat(np.where(half, flip, np.uint64(0)), starts).view(np.int64)) for half in (bit < 64, bit >= 64))
            token = s.view(np.int64)
            rank = times[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
            row = np.repeat(np.arange(len(size)), size)
            token = token[np.lexsort((token, rank, row))]
            least = np.clip(np.ceil(min_similarity * size - 1e-9), 1, None).astype(np.int64)
            agree = np.minimum(AGREE, least)
            posted = size - least + agree
            token = token[np.arange(len(token)) - np.repeat(starts, size) < np.repeat(posted, size)]
            ends = np.concatenate([[0], np.cumsum(posted)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("owner"), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int32)), low, high, pa.ListArray.from_arrays(ends, token)], ["id", "owner", "k1", "k2", "size", "low", "high", "posted"])

    return run


def _shared(coords: int, hot: Sequence[int] = ()):
    """Streams postings sorted by token; passes on those whose token another class has too, with the list's length.

    What may be a part of a list only (of ``hot`` tokens, or too long to hold) passes whole with a length of 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None  # the last token's postings as yet
        parts = np.array(hot, np.int64)

        def out(token, rid, n):
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(rid), pa.array(n)], ["token", "rid", "n"])

        def counted(token, rid):
            _, inverse, n = np.unique(token, return_inverse=True, return_counts=True)
            n = np.where(np.isin(token, parts), 0, n[inverse])
            return out(token[n != 1], rid[n != 1], n[n != 1])

        for b in batches:
            token, rid = b.column("token").to_numpy(), b.column("rid").to_numpy()
            if not len(token):
                continue
            if held is not None:
                token, rid = np.concatenate([held[0], token]), np.concatenate([held[1], rid])
            last = np.searchsorted(token, token[-1])
            if last == 0 and len(token) > 200_000:
                # A list too long to hold; what follows of it is a part, too.
                parts = np.append(parts, token[0])
                yield out(token, rid, np.zeros(len(token), np.int64))
                held = (token[:0], rid[:0])
                continue
            held = (token[last:], rid[last:])
            if last:
                yield counted(token[:last], rid[:last])
        if held is not None and len(held[0]):
            yield counted(*held)

    return run


def shared_postings(reps: DataFrame, coords: int) -> DataFrame:
    """``token, rid, n``: postings of the tokens that several classes have, with the number of these classes."""
    token = (F.col("c").cast("bigint") * F.lit(1 << 32)) + F.col("value").cast("bigint")
    postings = reps.select("rid", F.posexplode("sig").alias("c", "value")).select(token.alias("token"), "rid")
    # The salt spreads a token that a bounded sample already shows to be in many classes.
    sample = reps.limit(20_000).select(F.posexplode("sig").alias("c", "value")).groupBy(token.alias("token")).count().where("count > 400").select("token")
    hot = [r.token for r in sample.collect()]
    salt = F.when(F.col("token").isin(hot), F.pmod(F.col("rid"), F.lit(64))).otherwise(F.lit(0)) if hot else F.lit(0)
    spread = postings.repartition("token", salt).sortWithinPartitions("token")
    parts = materialize(spread.mapInArrow(_shared(coords, hot), "token bigint, rid bigint, n bigint"), "postings")
    # Lists that came in parts get their length from all of them: all classes must rank tokens alike.
    total = materialize(parts.where("n = 0").groupBy("token").agg(F.count("*").alias("total")), "totals")
    return parts.join(broadcast_if_small(total, BROADCAST_ROWS), "token", "left").select("token", "rid", F.coalesce("total", "n").alias("n")).where("n > 1")


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            if b.num_rows:
                s, ends, _ = shingle_sets(b.column("t").to_pylist(), words, known)
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), s.view(np.int64))], ["rid", "s"])

    return run


def matching(a: str, b: str) -> Column:
    """Number of coordinates in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


@dataclass
class NearDuplicates:
    """``members`` (id, owner, class_id): one row per record; ``links`` (class_a, class_b, similarity) between classes."""

    members: DataFrame
    links: DataFrame
    whole: bool = False

    def pairs(self, other_owner: bool) -> DataFrame:
        """``id_a < id_b`` for records of one class or of linked classes.

        The members of a class of more than ALL_PAIRS pair only with its first one, so that copies never make all
        pairs; its membership still holds every link. With ``other_owner`` those of the first one's owner pair with
        the first member of another owner instead: whoever has a partner comes out. If the links are ``whole``, so
        are the pairs: all of a class and of linked ones, however large.
        """
        if self.whole:
            return self._all_pairs(other_owner)
        size = self.members.groupBy("class_id").agg(F.count("*").alias("n"))
        sized = materialize(self.members.join(size, "class_id"), "sized")
        large = sized.where(F.col("n") > ALL_PAIRS)
        anyone = F.lit(None).cast("string").alias("only")
        stands = sized.where(F.col("n") <= ALL_PAIRS).select("class_id", "id", "owner", anyone)
        if other_owner:
            least = large.where("owner is not null").groupBy("class_id", "owner").agg(F.min("id").alias("id"))
            first = least.groupBy("class_id").agg(F.min(F.struct("id", "owner")).alias("f"))
            second = least.join(first, "class_id").where("owner <> f.owner").groupBy("class_id").agg(F.min(F.struct("id", "owner")).alias("s"), F.min("f.owner").alias("only"))
            stands = stands.union(first.select("class_id", "f.id", "f.owner", anyone)).union(second.select("class_id", "s.id", "s.owner", "only"))
        else:
            stands = stands.union(large.groupBy("class_id").agg(F.min("id"), F.lit(None).cast("string"), anyone))
        # All members of either class of a link meet those that stand for the other one, never all of two large classes.
        own = size.where("n > 1").select("class_id", "class_id")
        linked = self.links.select("class_a", "class_b").union(self.links.select("class_b", "class_a")).union(own)
        left = sized.select(F.col("class_id").alias("class_a"), F.col("id").alias("a"), F.col("owner").alias("owner_a"))
        right = stands.select(F.col("class_id").alias("class_b"), F.col("id").alias("b"), F.col("owner").alias("owner_b"), "only")
        found = linked.join(right, "class_b").join(left, "class_a").where("a <> b")
        if other_owner:
            found = found.where("owner_a <> owner_b and (only is null or owner_a = only)")
        return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()

    def _all_pairs(self, other_owner: bool) -> DataFrame:
        # A member has one class and a link comes once, so no pair comes twice. Large classes are cut into stripes.
        size = self.members.groupBy("class_id").agg(F.count("*").alias("n"))
        size = materialize(size.select("class_id", "n", F.ceil(F.col("n") / STRIPE).cast("int").alias("stripes")), "sizes")
        linked = self.links.select("class_a", "class_b").union(size.where("n > 1").select("class_id", "class_id"))
        stripes = size.select(F.col("class_id").alias("class_a"), F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"))
        left = self.members.join(size, "class_id").select(F.col("class_id").alias("class_a"), F.pmod(F.xxhash64("id"), "stripes").cast("int").alias("stripe"), F.col("id").alias("a"), F.col("owner").alias("owner_a"))
        right = self.members.select(F.col("class_id").alias("class_b"), F.col("id").alias("b"), F.col("owner").alias("owner_b"))
        found = linked.join(stripes, "class_a").join(right, "class_b").join(left, ["class_a", "stripe"]).where("class_a <> class_b or a < b")
        if other_owner:
            found = found.where("owner_a <> owner_b")
        return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))

    def groups(self) -> DataFrame:
        """``id, class_id, group_id, n_links``: connected components of the links; n_links counts linked classes."""
        label = components(self.links.select("class_a", "class_b"))
        n = self.links.select(F.col("class_a").alias("class_id")).union(self.links.select("class_b")).groupBy("class_id").agg(F.count("*").alias("n_links"))
        return (
            self.members.join(label, "class_id", "left")
            .join(n, "class_id", "left")
            .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
        )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``class_id, group_id`` (the least class of the component) of every class with an edge.

    Large-star and small-star steps by turns until nothing changes; hubs shrink, so no step gathers a component.
    """
    a, b = edges.columns
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        # Large star: every larger neighbour points to the least of the neighbourhood.
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself point to the least.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        e = materialize(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state is not None and tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("class_id"), F.col("v").alias("group_id")).union(e.select("v", "v")).distinct()


class _Verifier:
    """Exact similarities of candidate pairs of classes."""

    def __init__(self, src: DataFrame, base: DataFrame, sigs: DataFrame, words: int, min_similarity: float, matches: int):
        self.src, self.base, self.sigs = src, base, sigs
        self.words, self.min_similarity, self.matches = words, min_similarity, matches

    def links(self, pairs: DataFrame) -> DataFrame:
        """``class_a, class_b, similarity`` of those distinct pairs (a, b) that are similar enough."""
        pairs = materialize(pairs, "candidates")
        # Skipped lists are probed: agreement over all coordinates.
        probed = broadcast_if_small(materialize(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "probed"), BROADCAST_ROWS)
        sigs = self.sigs.join(probed, "rid")
        joined = pairs.join(sigs.select(F.col("rid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rid").alias("b"), F.col("sig").alias("sb")), "b")
        return self.similar(materialize(joined.where(matching("sa", "sb") >= self.matches).select("a", "b"), "kept"))

    def similar(self, kept: DataFrame) -> DataFrame:
        """The same, of materialized pairs and by their exact sets alone."""
        # Exact sets of the classes in any pair, from one member's text each.
        wanted = kept.select(F.col("a").alias("rid")).union(kept.select("b")).distinct().join(self.base.select("rid", "id"), "rid")
        wanted = broadcast_if_small(materialize(wanted.select("rid", F.col("id").alias("wanted_id")), "wanted"), BROADCAST_ROWS)
        texts = self.src.join(wanted, F.col("id") == F.col("wanted_id")).groupBy("rid").agg(F.min("t").alias("t"))
        sets = materialize(texts.mapInArrow(_sets(self.words), "rid bigint, s array<bigint>"), "sets")
        common = F.size(F.array_intersect("sa", "sb"))
        links = (
            kept.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")
            .withColumn("common", common)
            .select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), (F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).alias("similarity"))
            .where(F.col("similarity") >= self.min_similarity)
        )
        return materialize(links, "links")


def _leaders(long: DataFrame, owners: DataFrame) -> DataFrame:
    """``token, first, second``: the least class of each list, and the least of another owner than that one's (or the first)."""
    owned = long.join(owners, "rid")
    first = materialize(owned.groupBy("token").agg(F.min(F.struct("rid", "owner")).alias("f")), "first")
    second = owned.join(broadcast_if_small(first, BROADCAST_ROWS), "token").where("owner <> f.owner").groupBy("token").agg(F.min("rid").alias("second"))
    return materialize(first.join(second, "token", "left").select("token", F.col("f.rid").alias("first"), F.coalesce("second", "f.rid").alias("second")), "leaders")


def _unled(shared: DataFrame, met: DataFrame, found: DataFrame, owners: DataFrame, matches: int) -> DataFrame:
    """Pairs ``a, b`` of what isn't similar to a list's first leader with the list's other classes.

    What is of the first leader's owner must be similar to the second, too, or else its partners of other owners would
    be lost. Both of a pair have ``matches`` tokens of long lists, so they meet under two of them at once, of which one
    is the list's; lists that stay long even so are cut into stripes.
    """
    linked = found.select(F.col("class_a").alias("rid"), F.col("class_b").alias("leader")).union(found.select("class_b", "class_a")).withColumn("linked", F.lit(True))
    own = met.join(owners, "rid").join(owners.select(F.col("rid").alias("first"), F.col("owner").alias("first_owner")), "first")
    near = own.join(linked.withColumnsRenamed({"leader": "first", "linked": "to_first"}), ["rid", "first"], "left").join(linked.withColumnsRenamed({"leader": "second", "linked": "to_second"}), ["rid", "second"], "left")
    led = F.col("to_first").isNotNull() & (F.col("to_second").isNotNull() | (F.col("rid") == F.col("second")) | F.coalesce(F.col("owner") != F.col("first_owner"), F.lit(True)))
    rest = materialize(near.where((F.col("rid") != F.col("first")) & ~led).select("token", "rid"), "rest")
    if rest.isEmpty():
        return rest.select(F.col("token").alias("a"), F.col("rid").alias("b"))
    lists = broadcast_if_small(materialize(rest.select("token").distinct(), "rest_tokens"), BROADCAST_ROWS)
    everyone = shared.where(F.col("n") > LONG).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("held"))
    at = everyone.select("rid", "held", F.posexplode("held").alias("i", "x")).select("rid", F.col("x.token").alias("token"), F.expr("transform(slice(held, i + 2, size(held)), y -> y.token)").alias("later"))
    if matches < 2:
        at = at.withColumn("later", F.array("token"))
    both = at.join(lists, "token").select("token", "rid", F.explode("later").alias("other"))
    both = materialize(both, "composites")
    size = both.groupBy("token", "other").agg(F.count("*").alias("m")).where("m > 1")
    size = materialize(size.withColumn("stripes", F.ceil(F.col("m") / STRIPE).cast("int")).drop("m"), "composite_sizes")
    sized = both.join(size, ["token", "other"])
    left = sized.join(rest, ["token", "rid"], "left_semi").select("token", "other", F.pmod("rid", "stripes").alias("stripe"), F.col("rid").alias("x"))
    right = sized.select("token", "other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), F.col("rid").alias("y"))
    pairs = left.join(right, ["token", "other", "stripe"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    done = found.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def _classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a number, ``rid``; and the same with that of their class's first row, ``cid``."""
    base = materialize(signed.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    classes = materialize(base.groupBy("k1", "k2").agg(F.min("rid").alias("first_rid"), F.count("*").alias("n")).where("n > 1"), "classes")
    return base, base.join(broadcast_if_small(classes, BROADCAST_ROWS), ["k1", "k2"], "left").withColumn("cid", F.coalesce("first_rid", "rid"))


def _members(marked: DataFrame) -> DataFrame:
    return materialize(marked.groupBy("id").agg(F.min_by("owner", "cid").alias("owner"), F.min("cid").alias("class_id")), "members")


def _agreeing(reps: DataFrame, min_similarity: float) -> DataFrame:
    """Distinct pairs ``a < b`` of classes (rid, size, low, high, posted) that share as many posted shingles as one of them needs.

    A shared one counts unless too few shingles follow it in either set, or the bits of the two sets differ in more
    places than similar sets can have different shingles; neither loses a similar pair.
    """
    rows = reps.select("rid", "size", "low", "high", F.posexplode("posted").alias("pos", "token"))
    x, y = (rows.select("token", *[F.col(c).alias(c + side) for c in ("rid", "size", "low", "high", "pos")]) for side in ("_x", "_y"))
    common = F.ceil(min_similarity / (1 + min_similarity) * (F.col("size_x") + F.col("size_y")) - 1e-9)
    enough = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y")) - 1 + AGREE >= common
    alike = F.bit_count(F.col("low_x").bitwiseXOR(F.col("low_y"))) + F.bit_count(F.col("high_x").bitwiseXOR(F.col("high_y"))) <= F.col("size_x") + F.col("size_y") - 2 * common
    met = x.join(y, "token").where((F.col("rid_x") < F.col("rid_y")) & enough & alike)
    needed = F.least(F.lit(AGREE), F.greatest(F.lit(1), F.ceil(min_similarity * F.least("size_x", "size_y") - 1e-9)))
    shared = met.groupBy(F.col("rid_x").alias("a"), F.col("rid_y").alias("b")).agg(F.count("*").alias("m"), F.min(needed).alias("needed"))
    return shared.where("m >= needed").select("a", "b")


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, owner_col: str | None = None, words: int = 5, min_similarity: float = 0.8, min_words: int = 0, coords: int = 40, per_coord: int = 3, matches: int = 2, seed: int = 11, whole: bool = False
) -> NearDuplicates:
    """Classes of equal shingle sets, and links between classes with a Jaccard similarity of ``min_similarity`` or more.

    A word is a run of letters and digits in lower case; a shingle is ``words`` consecutive ones. Rows whose id or
    text is null, or whose text has fewer than ``min_words`` (or ``words``) words, take no part. Repeated rows of an
    id count once (the class of the least one, should texts differ). Whole texts are read. An empty table gives empty
    results; other columns are ignored, whatever their names. ``owner`` is null without ``owner_col``. In families of
    more than LONG classes, links run to leaders (see above), so that they grow with the family, not with its square.
    With ``whole`` every link comes out, and pairs() has every pair, as many as there are; ``coords``, ``per_coord``,
    ``matches`` and ``seed`` don't matter then.
    """
    owner = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    src = df.select(F.col(id_col).cast("string").alias("id"), owner.alias("owner"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    if whole:
        counts = df.sparkSession.sparkContext.broadcast(shingle_counts(src, words, min_words))
        signed = src.mapInArrow(_prefixes(words, min_words, min_similarity, counts), "id string, owner string, k1 bigint, k2 bigint, size int, low bigint, high bigint, posted array<bigint>")
        base, marked = _classes(signed)
        links = _Verifier(src, base, base, words, min_similarity, 0).similar(materialize(_agreeing(marked.where("cid = rid").select("rid", "size", "low", "high", "posted"), min_similarity), "candidates"))
        return NearDuplicates(_members(marked), links, True)
    signed = src.mapInArrow(_sign(words, min_words, coords, per_coord, seed), "id string, owner string, k1 bigint, k2 bigint, sig array<int>")
    base, marked = _classes(signed)
    reps = marked.where("cid = rid").select("rid", "sig", "owner")
    shared = materialize(shared_postings(reps.select("rid", "sig"), coords), "shared")
    # Prefix: all but the most frequent matches - 1 of what a class shares.
    w = Window.partitionBy("rid").orderBy(F.desc("n"), F.desc("token"))
    prefix = shared.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") >= matches).select("token", "rid", "n")
    short = prefix.where(F.col("n") <= LONG)
    left, right = short.select("token", F.col("rid").alias("a")), short.select("token", F.col("rid").alias("b"))
    merged = left.join(right, "token").where("a < b").select("a", "b").distinct()
    verify = _Verifier(src, base, reps.select("rid", "sig"), words, min_similarity, matches)
    long = materialize(prefix.where(F.col("n") > LONG).select("token", "rid"), "long")
    if long.isEmpty():
        links = verify.links(merged)
    else:
        leaders = _leaders(long, reps.select("rid", "owner"))
        met = long.join(broadcast_if_small(leaders, BROADCAST_ROWS), "token")
        led = met.select(F.array("rid", "first", "second").alias("x"), "rid").select("rid", F.explode(F.slice("x", 2, 2)).alias("leader")).where("rid <> leader")
        found = verify.links(merged.union(led.select(F.least("rid", "leader").alias("a"), F.greatest("rid", "leader").alias("b")).distinct()).distinct())
        links = found.union(verify.links(_unled(shared, met, found, reps.select("rid", "owner"), matches))).distinct()
    return NearDuplicates(_members(marked), links)
