"""The job loop as a stream: new job rows are handled in micro-batches, each job once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.operators.jobs import dispatch, latest
from folioforge.sources.sinks import append_new


def accept(jobs: DataFrame) -> DataFrame:
    """The default handler: ``id, handler, status`` of each pending job."""
    return dispatch(jobs).select("id", "handler", F.lit("completed").alias("status"))


def run_available(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame] = accept, pattern: str = "*") -> None:
    """Handles all job rows that the source has and that weren't handled before, then ends.

    A batch that is repeated after a failure adds nothing, as results are keyed by job. A job that a batch sees in a
    later version only is left to it.
    """

    def batch(rows: DataFrame, _: int) -> None:
        waiting = latest(rows).where("status = 'pending'")
        append_new(handle(waiting), sink, "id")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_window(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Events by window of time and key, counted once no more late ones are waited for."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
