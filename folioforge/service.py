"""The service's operations over tables in a folder: collections, documents, questions, analyses and jobs.

Each table is a series of versions; a change writes the next one, and readers take the newest that is complete. One
writer at a time is assumed, as with the jobs' loop.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import guess_mime, stored_name
from folioforge.operators import catalog, formats, ingest, jobs, metadata
from folioforge.operators.models import echo
from folioforge.plans import rag
from folioforge.sources.files import read_elements
from folioforge.sources.sinks import exists

#: The tables and their columns.
TABLES = {
    "collections": "id string, name string, created_at timestamp",
    "documents": "doc_id bigint, id string, collection_id string, filename string, original_filename string, content_hash string, file_size bigint, mime_type string, document_metadata string, text string, created_at timestamp",
    "document_chunks": "id string, document_id string, collection_id string, chunk_index bigint, chunk_text string, embedding array<float>",
    "jobs": "id string, document_id string, collection_id string, job_type string, status string, data string, error string, created_at timestamp, updated_at timestamp",
    "results": "job_id string, data string, created_at timestamp",
}
MAX_BYTES = 100 * 1024 * 1024


class NotFound(LookupError):
    """There is no such collection, document, job or result."""


class Service:
    """``tasks`` are the components of analyses by name; ``respond`` is the model."""

    def __init__(self, spark: SparkSession, folder: str, tasks: Mapping[str, Mapping[str, str]] | None = None, respond: Callable[[Column], Column] = echo, max_length: int = 128_000):
        self.spark, self.folder, self.tasks, self.respond, self.max_length = spark, folder.rstrip("/"), tasks or {}, respond, max_length

    # Tables.

    def _versions(self, name: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [e.getPath().getName() for e in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and exists(self.spark, f"{self.folder}/{name}/{n}/_SUCCESS"))

    def table(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/{versions[-1]}")

    def _write(self, name: str, df: DataFrame) -> None:
        columns = [F.col(c.split()[0]) for c in TABLES[name].split(", ")]
        df.select(*columns).write.parquet(f"{self.folder}/{name}/{(self._versions(name) or [0])[-1] + 1}")

    def _add(self, name: str, rows: DataFrame) -> None:
        self._write(name, self.table(name).unionByName(rows, allowMissingColumns=True))

    def reset(self) -> None:
        """All tables anew, without rows."""
        for name, schema in TABLES.items():
            self._write(name, self.spark.createDataFrame([], schema))

    def _store(self) -> jobs.Store:
        return jobs.Store(*[self.table(t) for t in TABLES])

    def _keep(self, store: jobs.Store) -> None:
        for name, df in zip(TABLES, (store.collections, store.documents, store.chunks, store.jobs, store.results), strict=True):
            self._write(name, df)

    # Collections and documents.

    def create_collection(self, name: str) -> dict[str, Any]:
        if not name or not name.strip():
            raise ValueError("a collection needs a name")
        if not self.table("collections").where(F.col("name") == name).isEmpty():
            raise ValueError(f"there is a collection {name!r} already")
        made = {"id": str(uuid.uuid4()), "name": name}
        self._add("collections", self.spark.createDataFrame([(made["id"], name)], "id string, name string").withColumn("created_at", F.current_timestamp()))
        return made

    def list_collections(self) -> DataFrame:
        return self.table("collections").select("id", "name")

    def collection_id(self, identifier: str) -> str:
        """By id, or else by name."""
        wanted = self.spark.createDataFrame([(identifier,)], "identifier string")
        row = jobs.resolve_collections(wanted, self.table("collections")).first()
        if row is None or row.collection_id is None:
            raise NotFound(f"no collection {identifier!r}")
        return row.collection_id

    def collection(self, identifier: str) -> DataFrame:
        """The collection with its documents, in pages."""
        one = self.table("collections").where(F.col("id") == self.collection_id(identifier))
        return catalog.collection_pages(one, self.table("documents"))

    def delete_collection(self, identifier: str) -> None:
        self._keep(self._store().delete_collections(self.spark.createDataFrame([(self.collection_id(identifier),)], "collection_id string")))

    def upload(self, collection: str, files: DataFrame) -> DataFrame:
        """Files (path, content) as documents of a collection, with a job to index each: ``path, reason, document_id, job_id``.

        A file over the limit, and one whose bytes the collection has already, is rejected with the reason.
        """
        into = self.collection_id(collection)
        now = F.current_timestamp()
        name = F.element_at(F.split("path", "/"), -1)
        rows = files.select(
            F.col("path"), F.expr("uuid()").alias("id"), F.lit(into).alias("collection_id"), name.alias("original_filename"), F.sha2("content", 256).alias("content_hash"),
            F.octet_length("content").cast("bigint").alias("file_size"), guess_mime(name).alias("mime_type"), now.alias("created_at"),
        ).withColumn("filename", stored_name(F.col("id"), F.col("original_filename")))
        held = self.table("documents").where(F.col("collection_id") == into).select("content_hash").distinct()
        decided = ingest.decide(rows, MAX_BYTES, id_col="path").join(held.withColumn("held", F.lit(True)), "content_hash", "left")
        decided = decided.withColumn("reason", F.when((F.col("reason") == "accepted") & F.col("held"), "duplicate").otherwise(F.col("reason")))
        texts = read_elements(files).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("element_index", "text")))), lambda x: x.text), "\n").alias("text"), F.max("file_metadata").alias("document_metadata"), F.max("error").alias("error"))
        joined = decided.join(texts, "path", "left")
        staged = f"{self.folder}/_staged/{uuid.uuid4().hex}"
        joined.withColumn("job_id", F.expr("uuid()")).write.parquet(staged)  # ids must not change when they are read again
        ready = self.spark.read.parquet(staged)
        good = ready.where("reason = 'accepted'")
        self._add("documents", good.withColumn("doc_id", F.xxhash64("id")))
        self._add("jobs", good.select(F.col("job_id").alias("id"), F.col("id").alias("document_id"), "collection_id", F.lit("indexing").alias("job_type"), F.lit("pending").alias("status"), F.lit("{}").alias("data"), "error", "created_at", F.col("created_at").alias("updated_at")))
        return ready.select("path", "reason", F.when(F.col("reason") == "accepted", F.col("id")).alias("document_id"), F.when(F.col("reason") == "accepted", F.col("job_id")).alias("job_id"))

    def document(self, document_id: str) -> DataFrame:
        rows = self.table("documents").where(F.col("id") == document_id)
        if rows.isEmpty():
            raise NotFound(f"no document {document_id!r}")
        return catalog.document_details(rows)

    def list_documents(self, collection: str) -> DataFrame:
        return self.table("documents").where(F.col("collection_id") == self.collection_id(collection)).select("id", "original_filename", "mime_type", "created_at")

    def delete_document(self, document_id: str) -> None:
        self.document(document_id)
        self._keep(self._store().delete_documents(self.spark.createDataFrame([(document_id,)], "document_id string")))

    def update_metadata(self, updates: Mapping[str, Mapping[str, str | None]]) -> None:
        """Manual updates by document."""
        rows = self.spark.createDataFrame([(k, dict(v)) for k, v in updates.items()], "id string, fields map<string,string>")
        self._write("documents", metadata.update_bulk(self.table("documents"), rows))

    # Jobs.

    def _submit(self, kind: str, collection_id: str | None, document_id: str | None, data: Mapping[str, Any]) -> str:
        job = str(uuid.uuid4())
        row = self.spark.createDataFrame([(job, document_id, collection_id, kind, "pending", json.dumps(data))], "id string, document_id string, collection_id string, job_type string, status string, data string")
        self._add("jobs", row.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp()))
        return job

    def query(self, collection: str, question: str, strategy: str = "merge", document_id: str | None = None) -> str:
        """Submits a question over a collection, or one of its documents; gives the job's id."""
        if not question or not question.strip():
            raise ValueError("a question is needed")
        kind = "document_query" if document_id else "query"
        return self._submit(kind, self.collection_id(collection), document_id, {"question": question, "strategy": strategy})

    def analyse(self, collection: str, task: str, strategy: str = "merge", document_id: str | None = None) -> str:
        if task not in self.tasks:
            raise NotFound(f"no task {task!r}")
        kind = "document_analysis" if document_id else "analysis"
        return self._submit(kind, self.collection_id(collection), document_id, {"task_name": task, "strategy": strategy})

    def job(self, job_id: str) -> dict[str, Any]:
        row = jobs.latest(self.table("jobs").where(F.col("id") == job_id)).first()
        if row is None:
            raise NotFound(f"no job {job_id!r}")
        return {"id": row.id, "status": row.status, "job_type": row.job_type, "error": row.error}

    def result(self, job_id: str) -> str:
        """A completed job's result."""
        wanted = self.spark.createDataFrame([(job_id,)], "job_id string")
        row = jobs.result_gate(wanted, self.table("jobs"), self.table("results")).first()
        if row.http_status == 400:
            raise ValueError("the job isn't completed")
        if row.http_status != 200:
            raise NotFound(f"no result of job {job_id!r}")
        return row.data

    def markdown(self, job_id: str) -> str:
        """``content`` of a result; nothing for results that don't have it at the top."""
        return self.spark.createDataFrame([(self.result(job_id),)], "d string").select(formats.as_markdown(F.col("d"))).first()[0]

    def cancel(self, job_id: str) -> None:
        self._write("jobs", jobs.cancel(self.table("jobs"), self.spark.createDataFrame([(job_id,)], "id string")))

    def retry(self, job_id: str) -> None:
        self._write("jobs", jobs.retry(self.table("jobs"), self.spark.createDataFrame([(job_id,)], "id string")))

    def work(self) -> int:
        """Does what is pending: all indexing jobs as one batch, then questions and analyses one by one; gives their number.

        A job that fails keeps its error.
        """
        waiting = jobs.pending(self.table("jobs"))
        indexing = waiting.where("job_type in ('indexing', 'batch_indexing')").select("id", "document_id", "error")
        done: list[tuple[str, str, str | None]] = []
        if not indexing.isEmpty():
            docs = self.table("documents").join(indexing.where("error is null").select(F.col("document_id").alias("id")), "id", "left_semi")
            components = self.tasks.get("metadata_extraction")
            chunks, changed = rag.index_with_metadata(docs, components, self.max_length, self.respond) if components else (rag.index(docs), None)
            self._add("document_chunks", chunks.withColumnRenamed("chunk_id", "id"))
            if changed is not None:
                self._write("documents", metadata.replace(self.table("documents"), changed.select("id", "document_metadata")))
            done += [(r.id, "failed" if r.error else "completed", r.error) for r in indexing.collect()]
        for r in waiting.where("job_type in ('query', 'document_query', 'analysis', 'document_analysis')").select("id", "document_id", "collection_id", "job_type", "data").collect():
            try:
                self._add("results", self.spark.createDataFrame([(r.id, self._answer(r))], "job_id string, data string").withColumn("created_at", F.current_timestamp()))
                done.append((r.id, "completed", None))
            except Exception as e:
                done.append((r.id, "failed", f"{type(e).__name__}: {e}"[:500]))
        if done:
            changes = self.spark.createDataFrame(done, "id string, status string, error string")
            running = jobs.transition(self.table("jobs"), changes.select("id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error")))
            self._write("jobs", jobs.transition(running, changes).withColumn("updated_at", F.current_timestamp()))
        return len(done)

    def _answer(self, job: Any) -> str:
        data = json.loads(job.data or "{}")
        strategy = data.get("strategy", "merge")
        of_document = job.job_type.startswith("document_")
        scope = ("document_id", job.document_id) if of_document else ("collection_id", job.collection_id)
        docs = self.table("documents").select(F.col("id").alias("document_id"), F.col("original_filename").alias("filename"), "document_metadata")
        nothing = rag.NO_CHUNKS if of_document else rag.NO_DOCUMENTS
        if job.job_type.endswith("query"):
            hits = rag.find(data["question"], self.table("document_chunks"), docs, *scope, "id")
            return rag.ask(data["question"], hits, strategy, nothing).first().data
        components = self.tasks[data["task_name"]]
        hits = rag.find(rag.search_text(components), self.table("document_chunks"), docs, *scope, "id")
        answers = [r.content for r in rag.analyse(hits, components, strategy, self.max_length, self.respond).collect()]  # at most k
        if not answers:
            return json.dumps({"content": nothing})
        if strategy == "separate":
            return json.dumps({"strategy": "separate", "results": [{"llm_response": {"content": a}} for a in answers]}, ensure_ascii=False)
        return json.dumps({"strategy": "merge", "result": {"content": answers[0]}}, ensure_ascii=False)
