"""The offline embedder: hashed bags of words. A model can take its place behind the same seam."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 64


def bucket(word: Column) -> Column:
    """The bucket of a lower-case word: the first 8 hex digits of its MD5, modulo the dimension."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % DIMENSION


def bag_weights(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, bucket, weight``: the non-zero entries of each text's unit vector, in one shuffle of partial counts."""
    words = df.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("id", bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def hash_vectors(texts: list[str | None]) -> list[list[float]]:
    """The unit vector of each text; zeros for one without words."""
    import hashlib
    import re

    known: dict[str, int] = {}
    out = []
    for text in texts:
        v = np.zeros(DIMENSION)
        for w in re.findall("[a-z]+", (text or "").lower()):
            if w not in known:
                known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIMENSION
            v[known[w]] += 1
        norm = np.sqrt((v * v).sum())
        out.append((v / norm if norm else v).tolist())
    return out


def embed(text: Column, model: Callable[[list[str | None]], list[list[float]]] = hash_vectors) -> Column:
    """A text's vector as array<float>, in batches; evaluated once, as models must be."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model([None if x is None else str(x) for x in batch]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>").asNondeterministic()(text)
