"""Views of the tables: collections with their contents, and documents in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.metadata import as_map, display


def collection_counts(collections: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``collection_id, name, n_documents, n_chunks, n_bytes``; empty collections with zeros; a replayed chunk counts once."""
    docs = documents.groupBy("collection_id").agg(F.count("*").alias("n_documents"), F.sum("file_size").cast("bigint").alias("n_bytes"))
    parts = chunks.groupBy("collection_id", "id").agg(F.lit(1).alias("one")).groupBy("collection_id").agg(F.count("*").alias("n_chunks"))
    out = collections.select(F.col("id").alias("collection_id"), "name").join(docs, "collection_id", "left").join(parts, "collection_id", "left")
    return out.select("collection_id", "name", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_documents", "n_chunks", "n_bytes")])


def document_details(documents: DataFrame) -> DataFrame:
    """A document's fields with its metadata as shown."""
    return documents.select("id", "collection_id", "filename", "original_filename", F.lower("content_hash").alias("content_hash"), "file_size", "mime_type", display(as_map(F.col("document_metadata"))).alias("shown"))


def collection_pages(collections: DataFrame, documents: DataFrame, columns: tuple[str, ...] = ("id", "filename", "original_filename", "file_size"), page_size: int = 1000) -> DataFrame:
    """``collection_id, name, n_documents, page, documents``: collections with their documents nested, a page at a time.

    Documents go to pages of about ``page_size`` by a hash of their ids, sorted by id within, so that no row holds all
    of a large collection; a collection without documents has one empty page.
    """
    counts = documents.groupBy("collection_id").agg(F.count("*").alias("n_documents"))
    paged = documents.join(counts, "collection_id").withColumn("page", F.pmod(F.xxhash64("id"), F.ceil(F.col("n_documents") / page_size).cast("bigint")))
    pages = paged.groupBy("collection_id", "page").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("documents"))
    kind = documents.select(F.array(F.struct(*columns))).schema[0].dataType
    out = collections.select(F.col("id").alias("collection_id"), "name").join(counts, "collection_id", "left").join(pages, "collection_id", "left")
    return out.select("collection_id", "name", F.coalesce("n_documents", F.lit(0)).cast("bigint").alias("n_documents"), F.coalesce("page", F.lit(0)).cast("bigint").alias("page"), F.coalesce("documents", F.array().cast(kind)).alias("documents"))


def first_of_each(documents: DataFrame, *keys: str) -> DataFrame:
    """``keys..., id``: the earliest document of each combination of values; nulls stand for nothing."""
    rows = documents
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.min(F.struct("created_at", "doc_id", "id")).id.alias("id"))


def first_by(documents: DataFrame, **equal: object) -> DataFrame:
    """The earliest document that has the given values."""
    rows = documents
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy("created_at", "doc_id").limit(1)
