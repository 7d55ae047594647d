"""Session creation, table access and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Collection, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app_name: str = "folioforge", **conf: str) -> SparkSession:
    """A UTC session; everything else that a cluster sets is left as it is."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine, where it is unset, one of our own.

    On a cluster the setting must be there: a folder of one machine would hold a part of each step only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _one_process(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("spark.folioforge.sharedDir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.folioforge.sharedDir", own)
    return own


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session may be gone already; then the folder's owner clears it
        pass


_written: set[str] = set()
#: Bytes of all strings in a table that is broadcast: rows alone don't bound what the driver holds.
BROADCAST_BYTES = 16 << 20


def release(spark: SparkSession, keep: Collection[str] = ()) -> None:
    """Deletes the steps that were written so far, but those of ``keep``; no DataFrame that reads one may be used any more."""
    for path in _written - set(keep):
        _written.discard(path)
        _drop(spark, path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was written within: write or collect a result before its steps go."""
    before = set(_written)
    try:
        yield
    finally:
        release(spark, before)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Cuts the lineage like checkpoint(), survives the loss of executors, and is columnar and compressed. What is
    written stays until release() or the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge-{os.getpid()}-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(release, spark)
    _written.add(path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it has no more than ``rows`` rows and its strings no more than ``size`` bytes; else leave the join to Catalyst.

    Counts ``df``, so call it on a materialized table.
    """
    from pyspark.sql import functions as F

    first = df.limit(rows + 1)
    strings = [F.sum(F.octet_length(first[c])) for c, kind in first.dtypes if kind == "string"]
    n, *sizes = first.agg(F.count(F.lit(1)), *strings).first()
    return F.broadcast(df) if n <= rows and sum(x or 0 for x in sizes) <= size else df
