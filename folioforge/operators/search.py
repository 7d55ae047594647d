"""Exact nearest-neighbour search: one query by expressions, many in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.vectors import cosine, l2_distance, literal

#: Query vectors that go to the executors at once, and rows that such a block meets in one task.
QUERY_BLOCK = 4096
ROW_BLOCK = 32768


def top_k(df: DataFrame, query: Sequence[float], vector_col: str, id_col: str, k: int = 5) -> DataFrame:
    """The k rows nearest to one vector, with ``distance``; ties by id, rows without a distance last."""
    return df.withColumn("distance", l2_distance(F.col(vector_col), literal(query))).orderBy(F.asc_nulls_last("distance"), id_col).limit(k)


def search_scope(chunks: DataFrame, documents: DataFrame, query: Sequence[float], scope_col: str, scope: object, id_col: str, k: int = 5, vector_col: str = "embedding", document_col: str = "document_id") -> DataFrame:
    """The nearest chunks of one collection or document, joined to their documents.

    The scope's filter reaches the scan; chunks without a document aren't hits, so the join comes before the cut.
    """
    scoped = chunks.where(F.col(scope_col) == scope)
    return top_k(scoped.join(documents, document_col), query, vector_col, id_col, k)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(-1))


def _nearest(queries: np.ndarray, query_ids: list, k: int, kind: pa.DataType):
    """Each batch's k nearest rows to each query of a block, ties by id; a few more where that saves sorting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (queries**2).sum(1)
        for b in batches:
            lengths = pa.compute.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(lengths == queries.shape[1]))
            n = b.num_rows
            if not n:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            squares = (x**2).sum(1)
            near = norms[:, None] - 2 * queries @ x.T + squares
            near[np.isnan(near)] = np.inf
            # A few more than k by the fast form; exact distances and ties decide below.
            m = min(n, k + 16)
            at = np.argpartition(near, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (len(queries), 1))
            q = np.repeat(np.arange(len(queries)), m)
            exact = _distances(x[at], queries[:, None, :]).ravel()
            at = at.ravel()
            if m < n:
                # What rounding of the fast form can't tell from the k-th distance may go on beyond the m rows.
                fast = np.sort(near[q, at].reshape(-1, m), axis=1)
                margin = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (norms + np.max(squares, where=np.isfinite(squares), initial=0))
                margin[~np.isfinite(margin)] = np.inf
                limit = fast[:, k - 1] + margin
                tied = np.flatnonzero(fast[:, -1] <= limit)
                if len(tied):
                    by_id = np.empty(n, np.int64)
                    by_id[pa.compute.sort_indices(b.column("id"), null_placement="at_start").to_numpy()] = np.arange(n)
                    keep = ~np.isin(q, tied)
                    parts = [(q[keep], at[keep], exact[keep])]
                    for i in tied:
                        rows = np.flatnonzero(near[i] <= limit[i])
                        d = _distances(x[rows], queries[i])
                        first = np.lexsort((by_id[rows], d))[:k]
                        parts.append((np.full(len(first), i), rows[first], d[first]))
                    q, at, exact = map(np.concatenate, zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([query_ids[i] for i in q], kind), b.column("id").take(pa.array(at)), pa.array(exact)], ["query_id", "id", "distance"])

    return run


def _block_hits(source: DataFrame, block: list, k: int, same: str | None, kind: str) -> DataFrame:
    """Candidates of one block of queries: a narrow pass over the rows, or one for each value of ``same``."""
    groups: dict[object, list] = {}
    for r in block:
        groups.setdefault((r[same] if same else None, len(r.v)), []).append(r)
    found = None
    for (value, _), part in groups.items():
        run = _nearest(np.array([r.v for r in part]), [r.id for r in part], k, pa.int64() if kind == "bigint" else pa.string())
        scoped = source.where(F.col(same) == value) if same else source
        hits = scoped.select("id", "v").mapInArrow(run, f"query_id {kind}, id {kind}, distance double")
        found = hits if found is None else found.unionByName(hits)
    return found


def _meet(k: int, kind: pa.DataType):
    """The nearest of one block of rows to each query of one block."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        out = [pa.RecordBatch.from_arrays([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names)]
        lengths = pa.compute.list_value_length(queries.column("v")).to_numpy()
        for length in np.unique(lengths):
            part = queries.filter(pa.array(lengths == length))
            x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            out += _nearest(x, part.column("id").to_pylist(), k, kind)(iter(rows.combine_chunks().to_batches()))
        return pa.Table.from_batches(out)

    return run


def _blocks_hits(source: DataFrame, wanted: DataFrame, n_queries: int, k: int, same: str | None, kind: str, block: int) -> DataFrame:
    """Candidates of many queries: blocks of queries meet blocks of rows in a shuffle, by the value of ``same`` if given."""
    row_blocks, query_blocks = max(1, -(-source.count() // ROW_BLOCK)), -(-n_queries // block)
    key = [F.col(same).alias("same")] if same else [F.lit(0).alias("same")]
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = source.select(*key, "id", "v", number(row_blocks).alias("r"), every(query_blocks).alias("q"))
    asked = wanted.select(*key, "id", "v", number(query_blocks).alias("q"), every(row_blocks).alias("r"))
    arrow = pa.int64() if kind == "bigint" else pa.string()
    return asked.groupBy("same", "r", "q").cogroup(rows.groupBy("same", "r", "q")).applyInArrow(_meet(k, arrow), f"query_id {kind}, id {kind}, distance double")


def batched_top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, same: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, id, distance, rank``: the k nearest rows of each query, ties by id.

    ``queries`` has the columns of ``rows``. Up to ``block`` queries go to the executors at once, and meet the rows in
    a narrow pass that keeps k a batch (and what ties with the last), of which only those are shuffled and ranked. More
    queries stay where they are: blocks of them meet blocks of rows in a shuffle. With ``same`` only rows that share
    that column's value are neighbours. Rows and queries with a null vector, or of another length, don't meet.
    """
    spark = rows.sparkSession
    columns = [F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    wanted = queries.select(*columns, *([same] if same else [])).where(F.col("v").isNotNull())
    source = rows.select(*columns, *([same] if same else [])).where(F.col("v").isNotNull())
    kind = source.schema["id"].dataType.simpleString()
    n_queries = wanted.limit(block + 1).count()
    if not n_queries:
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, distance double, rank int")
    found = _block_hits(source, wanted.collect(), k, same, kind) if n_queries <= block else _blocks_hits(source, wanted, wanted.count(), k, same, kind, block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(hits: DataFrame, query: Sequence[float], vector_col: str, id_col: str, k: int = 5) -> DataFrame:
    """Second stage: the k of some candidates with the highest cosine similarity, as ``score``."""
    return hits.withColumn("score", cosine(F.col(vector_col), literal(query))).orderBy(F.desc_nulls_last("score"), id_col).limit(k)
