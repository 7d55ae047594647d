"""Jobs, results and what hangs on them: current versions, gates, dispatch, transitions and cascading deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses in the order of a job's life, and the kinds of jobs.
STATUSES = ("pending", "running", "completed", "failed")
KINDS = ("batch", "indexing", "query", "analysis", "document_query", "document_analysis", "batch_indexing")
FALLBACK_KIND = "single_file"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ALLOWED = {("pending", "running"), ("running", "completed"), ("running", "failed"), ("pending", "failed"), ("failed", "pending")}


def status_rank(status: Column) -> Column:
    """How far a status is: failed counts as far as completed."""
    return F.when(status == "pending", 0).when(status == "running", 1).when(status.isin("completed", "failed"), 2)


def latest(jobs: DataFrame) -> DataFrame:
    """One row a job: the version with the farthest status, of several the latest update; replays vanish.

    Aggregates before the shuffle. All columns of a version stay together, so select those that are needed first.
    """
    columns = [c for c in jobs.columns if c != "id"]
    order = F.struct(status_rank(F.col("status")), F.coalesce("updated_at", "created_at"), "status")
    return jobs.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("x")).select("id", "x.*").select(*jobs.columns)


def submit(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with new pending ones appended; a job whose id there is already isn't new."""
    fresh = new.join(jobs.select("id"), "id", "left_anti").withColumn("status", F.lit("pending"))
    return jobs.unionByName(fresh, allowMissingColumns=True)


def pending(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    """Jobs that wait, in the order in which they are taken: by creation, then id."""
    rows = latest(jobs).where(F.col("status") == "pending")
    return (rows.where(F.col("job_type") == kind) if kind else rows).orderBy("created_at", "id")


def transition(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs with the ``status`` of ``changes`` (id, status, error) where it may follow theirs, and its ``error``; others stay as they are."""
    allowed = F.concat_ws(">", "status", "new_status").isin(*[f"{a}>{b}" for a, b in sorted(ALLOWED)])
    joined = jobs.join(changes.select("id", F.col("status").alias("new_status"), F.col("error").alias("new_error")), "id", "left")
    before = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    out = joined.withColumn("error", F.when(allowed, F.col("new_error")).otherwise(before)).withColumn("status", F.when(allowed, F.col("new_status")).otherwise(F.col("status")))
    return out.drop("new_status", "new_error")


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs that haven't ended among ``ids`` (id) as failed, with the error that says so."""
    return transition(jobs, ids.select("id", F.lit("failed").alias("status"), F.lit("cancelled").alias("error")))


def retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed jobs among ``ids`` (id) as pending again."""
    return transition(jobs, ids.select("id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error")))


def progress(jobs: DataFrame, by: str = "collection_id") -> DataFrame:
    """``by, n_jobs, n_ended, share``: how many of the current jobs have ended."""
    ended = F.count_if(F.col("status").isin("completed", "failed"))
    return latest(jobs).groupBy(by).agg(F.count("*").alias("n_jobs"), ended.alias("n_ended"), (ended / F.count("*")).alias("share"))


def dispatch(jobs: DataFrame) -> DataFrame:
    """Adds ``handler``: the job's type if one handles it, else single_file."""
    return jobs.withColumn("handler", F.when(F.col("job_type").isin(*KINDS), F.col("job_type")).otherwise(FALLBACK_KIND))


def result_gate(wanted: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``job_id, http_status, data`` for each wanted job: 404 without a job, 400 until it is completed, 404 without a result."""
    now = latest(jobs.select("id", "status", "created_at", "updated_at")).select(F.col("id").alias("job_id"), "status")
    data = results.groupBy("job_id").agg(F.max("data").alias("data"))
    joined = wanted.select("job_id").distinct().join(now, "job_id", "left").join(data, "job_id", "left")
    status = F.when(F.col("status").isNull(), 404).when(F.col("status") != "completed", 400).when(F.col("data").isNull(), 404).otherwise(200)
    return joined.select("job_id", status.alias("http_status"), F.when(status == 200, F.col("data")).alias("data"))


@dataclass
class Store:
    """The tables; operations return another Store, as files don't change."""

    collections: DataFrame
    documents: DataFrame
    chunks: DataFrame
    jobs: DataFrame
    results: DataFrame

    def delete_collections(self, ids: DataFrame) -> Store:
        """Without collections and their documents, chunks, jobs and results. ``ids`` has a column collection_id."""
        gone = ids.select(F.col("collection_id"))
        doomed = self.jobs.join(gone, "collection_id", "left_semi").select(F.col("id").alias("job_id"))
        return Store(
            self.collections.join(gone, self.collections.id == gone.collection_id, "left_anti"),
            self.documents.join(gone, "collection_id", "left_anti"),
            self.chunks.join(gone, "collection_id", "left_anti"),
            self.jobs.join(gone, "collection_id", "left_anti"),
            self.results.join(doomed, "job_id", "left_anti"),
        )

    def delete_documents(self, ids: DataFrame) -> Store:
        """Without documents and their chunks; their jobs stay, without the document. ``ids`` has a column document_id."""
        gone = ids.select("document_id").distinct().withColumn("_gone", F.lit(True))
        jobs = self.jobs.join(gone, "document_id", "left").withColumn("document_id", F.when(F.col("_gone").isNull(), F.col("document_id"))).select(*self.jobs.columns)
        return Store(self.collections, self.documents.join(gone, self.documents.id == gone.document_id, "left_anti"), self.chunks.join(gone, "document_id", "left_anti"), jobs, self.results)


def resolve_collections(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """``identifier, collection_id`` (null if there is none): by id for what has the form of one, else by name."""
    by_id = F.col("identifier").rlike(UUID)
    ids = wanted.where(by_id).join(collections.select(F.col("id").alias("collection_id")), F.col("identifier") == F.col("collection_id"), "left")
    names = wanted.where(~by_id).join(collections.select(F.col("id").alias("collection_id"), "name"), F.col("identifier") == F.col("name"), "left")
    return ids.select("identifier", "collection_id").unionByName(names.select("identifier", "collection_id"))


def resolve_documents(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """``collection_id, identifier, document_id`` by id or original file name, in the collection only; the earliest of several."""
    ids = wanted.join(documents.select("collection_id", F.col("id").alias("identifier"), F.col("id").alias("document_id"), "created_at"), ["collection_id", "identifier"])
    names = wanted.where(~F.col("identifier").rlike(UUID)).join(documents.select("collection_id", F.col("original_filename").alias("identifier"), F.col("id").alias("document_id"), "created_at"), ["collection_id", "identifier"])
    found = ids.unionByName(names).groupBy("collection_id", "identifier").agg(F.min(F.struct("created_at", "document_id")).document_id.alias("document_id"))
    return wanted.join(found, ["collection_id", "identifier"], "left")
