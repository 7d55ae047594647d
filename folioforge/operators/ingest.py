"""Ingestion: hashes, sizes, limits, duplicates within a collection, and what is rejected why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import guess_mime


def fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``computed_hash`` (SHA-256 of the UTF-8 bytes) and ``computed_size`` (bytes); null for null."""
    return df.withColumn("computed_hash", F.sha2(F.col(text_col), 256)).withColumn("computed_size", F.octet_length(text_col).cast("bigint"))


def with_mime(df: DataFrame, name_col: str = "original_filename") -> DataFrame:
    """Adds ``guessed_mime`` by the name's extension."""
    return df.withColumn("guessed_mime", guess_mime(F.col(name_col)))


def winners(df: DataFrame, group: list[str], order: list[str], id_col: str) -> DataFrame:
    """``group..., winner, n``: the first of each group with copies.

    Aggregates before the shuffle, so that a group of any size costs one row a task.
    """
    first = F.min(F.struct(*order, id_col))
    return df.groupBy(*group).agg(first[id_col].alias("winner"), F.count("*").alias("n")).where("n > 1")


def decide(df: DataFrame, max_bytes: int, id_col: str = "doc_id", order: tuple[str, ...] = ("created_at",), size_col: str = "file_size", hash_col: str = "content_hash") -> DataFrame:
    """Adds ``reason`` (accepted, too_large, duplicate) and ``winner``, the id of the upload that a duplicate repeats.

    Within a collection the first upload of equal bytes wins; the same bytes in another collection are no duplicate.
    Files over the limit take no part in that; one of exactly the limit passes.
    """
    key = F.lower(hash_col)
    sized = df.withColumn("hash_key", key)
    fits = sized.where(F.col(size_col) <= max_bytes)
    first = winners(fits, ["collection_id", "hash_key"], list(order), id_col).drop("n")
    out = sized.join(first, ["collection_id", "hash_key"], "left")
    large = F.coalesce(F.col(size_col) > max_bytes, F.lit(False))
    reason = F.when(large, "too_large").when(F.col("winner").isNotNull() & (F.col("winner") != F.col(id_col)), "duplicate").otherwise("accepted")
    return out.withColumn("reason", reason).withColumn("winner", F.when(F.col("reason") == "duplicate", F.col("winner"))).drop("hash_key")


def summary(decided: DataFrame) -> DataFrame:
    """Documents and bytes by collection and reason."""
    return decided.groupBy("collection_id", "reason").agg(F.count("*").alias("n_documents"), F.sum("file_size").cast("bigint").alias("n_bytes"))
