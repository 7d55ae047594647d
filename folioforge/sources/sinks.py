"""Sinks: appends that stay idempotent, text files by name, and dumps of all tables."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: str, partition: str | None = None) -> int:
    """Appends the rows whose key the table at ``path`` lacks, one a key; a repeated write adds nothing. Gives their number."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        writer = fresh.write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    fresh.unpersist()
    return n


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path))


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory())


def write_texts(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """Each text into the folder of its name, as one file: ``<path>/name=<name>/part-...``."""
    df.select(F.col(name_col).alias("name"), F.col(text_col).cast("string").alias("value")).repartition("name").write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(path)


def write_outputs(df: DataFrame, folder: str, name_col: str, text_col: str) -> int:
    """Each text into a file of its name below ``folder``, written by the executors; gives their number.

    A name is the last part of a path; a file ends with a line feed; of rows with one name the greatest text is written, and a repeated write
    replaces a file as a whole.
    """
    spark = df.sparkSession
    once = df.select(F.element_at(F.split(F.col(name_col), "/"), -1).alias("name"), F.col(text_col).cast("string").alias("text")).where("name <> '' and text is not null").groupBy("name").agg(F.max("text").alias("text"))
    staged = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    once.select("text", "name").write.partitionBy("name").text(staged)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(staged)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for entry in fs.listStatus(root):
        if entry.isDirectory():
            name = unquote(entry.getPath().getName().partition("=")[2])
            (made,) = [x.getPath() for x in fs.listStatus(entry.getPath()) if x.getPath().getName().startswith("part-")]
            target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
            fs.delete(target, False)
            fs.rename(made, target)
            n += 1
    fs.delete(root, True)
    return n


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest dump, by name."""
    newest = latest_dump(spark, folder)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(newest)
    names = [e.getPath().getName() for e in hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop_path)]
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{newest}/{n}") for n in sorted(names) if n.endswith(".parquet")}


def dump(tables: dict[str, DataFrame], folder: str, stamp: str) -> None:
    """All tables into a folder of their own."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{stamp}/{name}.parquet")


def latest_dump(spark: SparkSession, folder: str) -> str:
    """The newest dump's folder: that of the greatest stamp."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    entries = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    names = [e.getPath().toString() for e in entries if e.isDirectory()]
    if not names:
        raise FileNotFoundError(f"{folder} holds no dump")
    return max(names)
