"""Filling fixed-capacity containers, planned on a histogram of lengths.

The plan is best-fit decreasing over counts: runs of equal containers take equal items at once, so its size depends on
the capacity only. Items then take the planned slots by a join on their rank within their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import materialize

BUCKETS = 256


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots as (length, first rank, number of ranks, items a container, first container); number of containers.

    The same filling as placing every item, the longest first, into the open container with the least room that holds
    it. Containers of equal room are kept as runs of consecutive numbers.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first container, count)
    made = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a container of {capacity}")
        left, rank, room = histogram[length], 0, length
        while left:
            while room <= capacity and not open_runs[room]:
                room += 1
            if room <= capacity:
                first, count = open_runs[room].pop()
                had = room
            else:
                first, had = made, capacity
                count = -(-left // (capacity // length))
                made += count
            each = had // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, full * each, each, first))
                rank, left = rank + full * each, left - full * each
                if had > each * length:
                    open_runs[had - each * length].append((first, full))
            if full < count:
                rest = first + full
                if left and left < each:
                    slots.append((length, rank, left, each, rest))
                    open_runs[had - left * length].append((rest, 1))
                    rank, left, rest = rank + left, 0, rest + 1
                if rest < first + count:
                    open_runs[had].append((rest, first + count - rest))
    return slots, made


def pack(df: DataFrame, id_col: str, length_col: str, capacity: int) -> DataFrame:
    """``id, piece_no, start, length, container``: every item, in whole unless it alone exceeds a container.

    A longer item is cut into pieces of ``capacity`` and a last one of the rest. An item of length 0 or null comes out
    with length 0 and no container. Repeated rows of an id count once (their longest); an id may be null. Ties take
    slots in a fixed order, so the result is the same in every run. An empty table gives no rows.
    """
    spark = df.sparkSession
    items = materialize(df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("total")).groupBy("id").agg(F.max("total").alias("total")), "items")
    last = F.when(F.col("total") > 0, F.ceil(F.col("total") / capacity) - 1).otherwise(0)
    pieces = items.select("id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
    pieces = pieces.select("id", "piece_no", (F.col("piece_no") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("total") - F.col("piece_no") * capacity).alias("length"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(BUCKETS)))
    # At most capacity x BUCKETS rows, whatever the number of items.
    counts = materialize(pieces.where("length > 0").groupBy("length", "bucket").count(), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots, _ = plan_containers(histogram, capacity)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "bucket", before.alias("offset"))
    # No single task ranks all items of one length: ranks run within buckets, which start at their offsets.
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece_no")) - 1
    ranked = pieces.where("length > 0").withColumn("in_bucket", rank).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("in_bucket") + F.col("offset"))
    table = spark.createDataFrame([tuple(map(int, s)) for s in slots], "slot_length bigint, first_rank bigint, n_ranks bigint, each bigint, first_container bigint")
    # The plan's size is bounded by the capacity.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_ranks")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))
    columns = ["id", "piece_no", "start", "length"]
    nothing = pieces.where("length = 0").select(*columns, F.lit(None).cast("bigint").alias("container"))
    return placed.select(*columns, container.cast("bigint").alias("container")).unionByName(nothing)


def waste(histogram: dict[int, int], containers: int, capacity: int) -> float:
    """Share of room left unused."""
    used = int(np.sum([k * v for k, v in histogram.items()]))
    return 1 - used / (containers * capacity) if containers else 0.0
