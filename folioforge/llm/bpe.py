"""Encoding of texts with a public byte-level BPE vocabulary, given as a file of ranks.

Short words are merged on contiguous arrays: one holds the boundaries between the parts of a word, one the rank of
each pair of adjacent parts. The least rank is found by scanning, its boundary deleted and its neighbours' ranks
refreshed. Words that are not short go through a heap, with the same result. Every distinct word is merged once a
worker; a batch then gathers its ids from the words' in one step.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The place of the vocabulary and the pattern that splits text before the merges.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SHORT = 256
CACHED_WORDS = 400_000
NONE = 1 << 40


def load_ranks(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    """Parts and their ranks, of a file with a base64 part and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(part): int(rank) for part, rank in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by scanning a contiguous array of ranks."""
    if word in ranks:
        return [ranks[word]]
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == NONE:
            break
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            adjacent[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word in n log n, by a heap of pairs over a linked list of parts."""
    n = len(word)
    after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    end = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if dead[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], dead[j] = stop, after[j], 1
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if not dead[i]]


class Encoder:
    """Encodes batches; keeps the ids of the words it has met, up to CACHED_WORDS."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[int] = []
        self.starts: list[int] = [0]

    def _add(self, word: str) -> int:
        raw = word.encode("utf-8")
        self.ids += merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        self.starts.append(len(self.ids))
        k = self.index[word] = len(self.starts) - 2
        return k

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts as indexes, where each text's words end, and each word's number of ids."""
        if len(self.index) > CACHED_WORDS:
            self.reset()
        words: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                words += self.find(t)
            ends[i] = len(words)
        get, add = self.index.get, self._add
        at = np.fromiter((k if (k := get(w)) is not None else add(w) for w in words), np.int64, len(words))
        return at, ends, np.diff(np.asarray(self.starts, np.int64))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's among them."""
        at, ends, size = self.words(texts)
        n = size[at]
        stop = np.cumsum(n)
        starts = np.asarray(self.starts, np.int64)[at]
        flat = np.asarray(self.ids, np.int32)[np.repeat(starts - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        offsets = np.concatenate([[0], stop])[np.concatenate([[0], ends])]
        return flat, offsets.astype(np.int32)

    def count(self, texts: list[str | None]) -> np.ndarray:
        at, ends, size = self.words(texts)
        return np.diff(np.concatenate([[0], np.cumsum(size[at])])[np.concatenate([[0], ends])])


_encoders: dict[Any, Encoder] = {}


def _encoder(shared: Any) -> Encoder:
    """One encoder a worker process and vocabulary; it holds the vocabulary, whose identity is its key."""
    key = id(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _slices(batch: pa.Array, rows: int = 500) -> Iterator[list[str | None]]:
    for lo in range(0, len(batch), rows):
        yield batch.slice(lo, rows).to_pylist()


def token_ids(spark: SparkSession, text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The ids of a text as array<int>, without special tokens; empty for null and empty texts.

    What looks like a special token is ordinary text. The vocabulary (a file of bounded size) is read on the driver
    and broadcast.
    """
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for batch in batches:
            parts = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)) for flat, offsets in map(encoder.encode, _slices(batch))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def token_count(spark: SparkSession, text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The number of ids of a text as bigint; 0 for null and empty texts."""
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *map(encoder.count, _slices(batch))]))

    return count(text)
