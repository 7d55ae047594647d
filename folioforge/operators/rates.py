"""Calls within a sliding window, with hot keys cut up by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, key: str, time: str, seconds: int = 60, bucket_seconds: int = 3600) -> DataFrame:
    """Events with ``n_recent``: those of the same key in the last ``seconds``, both ends and the event itself included.

    A key's events are cut into buckets of time, each with what precedes it within the window, so that no task holds
    all of a hot key. Events at the same time see each other, as with a range frame. Rows with a null key or time are
    left out.
    """
    if not 0 < seconds <= bucket_seconds:
        raise ValueError("a window is within one bucket and the next")
    columns = events.columns
    at = F.unix_micros(F.col(time).cast("timestamp"))
    size = bucket_seconds * 1_000_000
    span = seconds * 1_000_000
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / size))
    later = F.when(F.floor((F.col("_at") + span) / size) > F.col("_bucket"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("_shift", F.explode(later)).withColumn("_bucket", F.col("_bucket") + F.col("_shift"))
    w = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(-span, 0)
    return spread.withColumn("n_recent", F.count("*").over(w)).where("_shift = 0").select(*columns, "n_recent")
