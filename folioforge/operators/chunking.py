"""Chunks: fixed windows as expressions, the recursive splitter in Arrow batches, and ordered concatenation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of the recursive splitter, the coarsest first.
SEPARATORS = ("\n\n", "\n", " ", "")


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"an overlap of {overlap} does not fit a size of {size}")


def fixed_windows(text: Column, size: int = 4000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters that begin every ``size - overlap``; a text within the size is one.

    The last may lie within the one before. An empty text is one empty window, null gives null.
    """
    _check(size, overlap)
    stride = size - overlap
    n = F.when(F.length(text) <= size, 1).otherwise(F.ceil(F.length(text) / stride))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(text, i * stride + 1, F.lit(size)))


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """``keep..., chunk_index, chunk_text``."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk_text")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Joins pieces into chunks up to size, each beginning with the tail of the last up to overlap."""
    out: list[str] = []
    window: list[str] = []
    total = 0
    for part in parts:
        if window and total + len(part) > size:
            if chunk := "".join(window).strip():
                out.append(chunk)
            while total > overlap or (total + len(part) > size and total > 0):
                total -= len(window.pop(0))
        window.append(part)
        total += len(part)
    if chunk := "".join(window).strip():
        out.append(chunk)
    return out


def split_recursively(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of a text, cut at the coarsest separator that keeps them within size."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        head, *rest = text.split(separator)
        parts = [p for p in [head, *(separator + r for r in rest)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_recursively(part, size, overlap, finer) if finer else [part]
    return out + _merge(short, size, overlap)


def recursive_chunks(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """The recursive splitter over Arrow batches; null gives null, blank texts an empty array."""
    _check(size, overlap)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split_recursively(t, size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def concatenate(df: DataFrame, group: str, order: str, text: str, separator: str, first: int | None = None) -> DataFrame:
    """``group, text``: texts of a group in their order with a separator between; with ``first``, of positions below it.

    A group is one document's parts, or one question's hits, so its size is bounded by those.
    """
    rows = df.where(F.col(order) < first) if first is not None else df
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)
    return rows.groupBy(group).agg(joined.alias("text"))
