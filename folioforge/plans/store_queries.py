"""More queries over the test tables: lookups, whole pipelines, jobs and updates, each with its SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.embedding import hash_vectors
from folioforge.operators import catalog, formats, jobs, layout, metadata, models
from folioforge.plans import rag
from folioforge.plans.queries import _ASKED, _LATEST, _META, AS_OF, QUESTION, TASK, _chunks, _docs, _elements, _ELEMENTS, _frame_sql, _int, _named_docs, _sha, _vectors, query
from folioforge.session import table

# Lookups.


def _first_sql(*keys: str) -> str:
    names = ", ".join(keys)
    return f"WITH d AS (SELECT * REPLACE (lower(content_hash) AS content_hash) FROM documents) SELECT {names}, arg_min(id, (created_at, doc_id)) AS id FROM d WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {names}"


def _lowered(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumn("content_hash", F.lower("content_hash"))


@query(_first_sql("content_hash"))
def first_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_of_each(_lowered(spark, d), "content_hash")


@query(_first_sql("collection_id", "content_hash"))
def first_by_hash_in_collection(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_of_each(_lowered(spark, d), "collection_id", "content_hash")


@query(_first_sql("filename"))
def first_by_stored_name(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_of_each(_docs(spark, d), "filename")


@query(_first_sql("collection_id", "original_filename"))
def first_by_original_name(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_of_each(_docs(spark, d), "collection_id", "original_filename")


@query("""WITH w AS (SELECT DISTINCT collection_id, id AS identifier FROM documents UNION SELECT collection_id, original_filename FROM documents UNION SELECT id, 'no such document' FROM collections),
f AS (SELECT collection_id, id AS identifier, id AS document_id, created_at FROM documents UNION ALL SELECT collection_id, original_filename, id, created_at FROM documents),
m AS (SELECT collection_id, identifier, arg_min(document_id, (created_at, document_id)) AS document_id FROM f GROUP BY 1, 2) SELECT w.collection_id, w.identifier, m.document_id FROM w LEFT JOIN m USING (collection_id, identifier)""")
def resolve_document(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    unknown = table(spark, d, "collections").select(F.col("id").alias("collection_id"), F.lit("no such document").alias("identifier"))
    wanted = docs.select("collection_id", F.col("id").alias("identifier")).union(docs.select("collection_id", "original_filename")).union(unknown).distinct()
    return jobs.resolve_documents(wanted, docs).select("collection_id", "identifier", "document_id")


@query("""SELECT k.id AS collection_id, k.name, count(d.id) OVER (PARTITION BY k.id) AS n_documents, d.id AS document_id, d.original_filename FROM collections k LEFT JOIN documents d ON d.collection_id = k.id""")
def collection_detail(spark: SparkSession, d: str) -> DataFrame:
    pages = catalog.collection_pages(table(spark, d, "collections"), _docs(spark, d), ("id", "original_filename"))
    rows = pages.select("collection_id", "name", "n_documents", F.explode_outer("documents").alias("x"))
    return rows.select("collection_id", "name", "n_documents", F.col("x.id").alias("document_id"), F.col("x.original_filename").alias("original_filename"))


@query("SELECT id AS document_id, original_filename, mime_type, epoch_us(created_at) AS created FROM documents")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("id").alias("document_id"), "original_filename", "mime_type", F.unix_micros("created_at").alias("created"))


# Metadata.

_NEW = "CASE WHEN doc_id % 3 = 0 THEN '{\"title\":\"' || doc_id || '\"}' WHEN doc_id % 3 = 1 THEN NULL ELSE document_metadata END"


@query(f"SELECT id, sha256({_NEW}) AS hash FROM documents")
def metadata_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"title":"'), F.col("doc_id"), F.lit('"}')))
    updates = docs.where("doc_id % 3 < 2").select("id", made.alias("document_metadata"))
    return metadata.replace(docs, updates).select("id", _sha(F.col("document_metadata")).alias("hash"))


@query(f"""WITH m AS (SELECT id, doc_id, {_META} AS m FROM documents)
SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'b' || doc_id ELSE json_extract_string(m, '$.publisher') END AS publisher, json_extract_string(m, '$.title') AS title, CASE WHEN doc_id % 6 = 0 THEN 'language,publisher' WHEN doc_id % 2 = 0 THEN 'publisher' WHEN doc_id % 3 = 0 THEN 'language' END AS fields FROM m""")
def bulk_update(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    one = docs.where("doc_id % 2 = 0").select("id", F.create_map(F.lit("publisher"), F.concat(F.lit("b"), "doc_id"), F.lit("doi"), F.lit(None).cast("string")).alias("fields"))
    two = docs.where("doc_id % 3 = 0").select("id", F.create_map(F.lit("language"), F.lit("xx"), F.lit("doi"), F.lit(None).cast("string")).alias("fields"))
    out = metadata.update_bulk(docs, one.union(two))
    value = lambda k: F.get_json_object("document_metadata", f"$.{k}")
    return out.select("id", value("publisher").alias("publisher"), value("title").alias("title"), value("manual_update_fields").alias("fields"))


# Model calls.


def _echo_model(prompt: str) -> dict[str, Any]:
    return {"content": "[echo] " + prompt[:200], "model": "echo", "cost": 0.0}


@query(f"""WITH p AS (SELECT doc_id, text, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND length(text) > 0), c AS (SELECT h, min(doc_id) AS first FROM p GROUP BY 1)
SELECT p.doc_id, first % 3 = 0 AS cached, CASE WHEN first % 3 = 0 THEN 'kept ' || first ELSE '[echo] ' || substr(text, 1, 200) END AS content FROM p JOIN c USING (h)""")
def llm_cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """A third of the answers come from the cache; entries that are too old, and other models' ones, don't count."""
    docs = _docs(spark, d).where("length(text) > 0").select("doc_id", F.col("text").alias("prompt"))
    first = docs.groupBy("prompt").agg(F.min("doc_id").alias("first"))
    now = F.lit(AS_OF).cast("timestamp")
    entry = lambda rows, model, content, minutes: rows.select(models.cache_key(F.col("prompt"), F.lit(model)).alias("cache_key"), content.alias("content"), F.lit(model).alias("model"), F.lit(0.0).alias("cost"), (now - F.make_interval(mins=F.lit(minutes))).alias("created_at"))
    kept = entry(first.where("first % 3 = 0"), "echo", F.concat(F.lit("kept "), "first"), 5)
    cache = kept.union(entry(first, "echo", F.lit("old"), 61)).union(entry(first, "other", F.lit("other"), 5)).union(entry(first, "echo", F.lit("later"), -1))
    answers, _ = models.generate(docs, _echo_model, "echo", cache=cache, as_of=now, calls_per_minute=None)
    return answers.select("doc_id", "cached", "content")


_MARKED = "repeat('<', 22) || coalesce(text, '') || repeat('>', 21)"


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def result_markdown(spark: SparkSession, d: str) -> DataFrame:
    inner = F.to_json(F.struct(F.expr(_MARKED).alias("document")))
    data = F.to_json(F.struct(F.concat(F.lit("```json"), inner, F.lit("\n```")).alias("content")))
    return _docs(spark, d).select("doc_id", _sha(formats.result_markdown(data)).alias("hash"))


# Questions and analyses over a scope. Vectors of questions are those of the offline embedder.


def _near_sql(question: str, where: str) -> str:
    vector = "[" + ", ".join(repr(float(x)) for x in hash_vectors([question])[0]) + "]"
    return f"""WITH e AS (SELECT vec_id, list_distance(embedding::DOUBLE[], {vector}::DOUBLE[]) AS dist FROM embeddings WHERE {where}),
h AS (SELECT e.vec_id, d.text, d.original_filename, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM e JOIN documents d ON d.doc_id = e.vec_id), k AS (SELECT * FROM h WHERE rank <= 5)"""


def _hits(spark: SparkSession, d: str, question: str, scope_col: str, scope: object) -> DataFrame:
    found = rag.find(question, _vectors(spark, d), _named_docs(spark, d).withColumnRenamed("text", "chunk_text"), scope_col, scope, "chunk_id")
    return found.where("chunk_text is not null")


_CONTEXT = "string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank)"


@query(_near_sql(QUESTION, "label = 2") + f" SELECT '[echo] ' || substr({_ASKED} {_CONTEXT}, 1, 200) AS content, to_json(list(original_filename ORDER BY rank))::VARCHAR AS sources FROM k WHERE text IS NOT NULL")
def collection_query(spark: SparkSession, d: str) -> DataFrame:
    out = rag.ask(QUESTION, _hits(spark, d, QUESTION, "collection_id", 2), "merge")
    return out.select(F.get_json_object("data", "$.result.content").alias("content"), F.get_json_object("data", "$.sources").alias("sources"))


@query(_near_sql(QUESTION, "vec_id = 4") + f" SELECT coalesce('[echo] ' || substr({_ASKED} {_CONTEXT}, 1, 200), '{rag.NO_CHUNKS}') AS content FROM k WHERE text IS NOT NULL")
def document_query(spark: SparkSession, d: str) -> DataFrame:
    out = rag.ask(QUESTION, _hits(spark, d, QUESTION, "document_id", 4), "merge", rag.NO_CHUNKS)
    return out.select(F.coalesce(F.get_json_object("data", "$.result.content"), F.get_json_object("data", "$.content")).alias("content"))


@query(f"SELECT '{rag.NO_CHUNKS}' AS content")
def document_query_without_hits(spark: SparkSession, d: str) -> DataFrame:
    out = rag.ask(QUESTION, _hits(spark, d, QUESTION, "document_id", -1), "separate", rag.NO_CHUNKS)
    return out.select(F.get_json_object("data", "$.content").alias("content"))


_SEARCHED = rag.search_text(TASK)


@query(_near_sql(_SEARCHED, "label = 3") + f" SELECT CAST(rank AS BIGINT) AS rank, '[echo] ' || substr({_frame_sql('text')}, 1, 200) AS content FROM k WHERE text IS NOT NULL")
def collection_analysis(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d, _SEARCHED, "collection_id", 3)
    return rag.analyse(hits, TASK, "separate", 128_000).select(_int("rank").alias("rank"), "content")


@query(_near_sql(_SEARCHED, "vec_id = 6") + f", m AS (SELECT {_CONTEXT} AS text FROM k WHERE text IS NOT NULL) SELECT '[echo] ' || substr({_frame_sql('text')}, 1, 200) AS content FROM m WHERE text IS NOT NULL")
def document_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rag.analyse(_hits(spark, d, _SEARCHED, "document_id", 6), TASK, "merge", 128_000).select("content")


@query(f"""WITH m AS (SELECT id, text, {_META} AS m FROM documents), t AS (SELECT id, nullif(trim(json_extract_string(m, '$.title')), '') AS title, text IS NOT NULL AND length(trim(regexp_replace(text, '{T.WHITE_SPACE}+', ' ', 'g'))) > 0 AS has FROM m)
SELECT id, CASE WHEN has THEN 'Found' ELSE title END AS title, CASE WHEN has THEN 'true' END AS llm_extracted FROM t""")
def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Indexing as a whole: of documents with text, the title is the one that the model finds, under fields of the file."""
    docs = _docs(spark, d).withColumn("document_metadata", F.to_json(F.map_filter(metadata.as_map(F.col("document_metadata")), lambda k, v: (k == "title") & v.isNotNull())))
    respond = lambda prompt: F.when(prompt.isNotNull(), F.lit('```json\n{"title": "Found", "doi": ""}\n```'))
    _, found = rag.index_with_metadata(docs, TASK, 128_000, respond)
    value = lambda k: F.nullif(F.trim(F.get_json_object("document_metadata", f"$.{k}")), F.lit(""))
    return found.select("id", value("title").alias("title"), value("llm_extracted").alias("llm_extracted"))


# Pages.


@query(_ELEMENTS + """, f AS (SELECT document_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY element_index, text) FILTER (WHERE kind = 'text'), '') AS a,
coalesce(string_agg(chr(10) || chr(10) || 'Table:' || chr(10) || 'page | ' || page || chr(10) || repeat('-', length('page | ' || page)) || chr(10) || text, '' ORDER BY element_index, text) FILTER (WHERE kind = 'table'), '') AS b FROM e GROUP BY 1)
SELECT document_id, sha256(a || b) AS hash FROM f""")
def flatten_elements(spark: SparkSession, d: str) -> DataFrame:
    rows = _elements(spark, d)
    is_table = F.col("kind") == "table"
    headers = F.when(is_table, F.array(F.lit("page"), F.col("page").cast("string")))
    return layout.flatten(rows.withColumn("headers", headers).withColumn("rows", F.when(is_table, F.array(F.array("text"))))).select("document_id", _sha(F.col("text")).alias("hash"))


# Jobs.


def _current(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(table(spark, d, "jobs").select("id", "collection_id", "job_type", "status", "created_at", "updated_at"))


@query(_LATEST + " SELECT status, count(*) AS n FROM (SELECT status FROM l UNION ALL SELECT 'pending' FROM (SELECT DISTINCT 'new-' || id FROM documents)) GROUP BY 1")
def submit_jobs(spark: SparkSession, d: str) -> DataFrame:
    """An indexing job for each document; submitting what is there already changes nothing."""
    now = _current(spark, d)
    fresh = _docs(spark, d).select(F.concat(F.lit("new-"), "id").alias("id"), "collection_id", F.lit("indexing").alias("job_type"), F.lit("failed").alias("status"), "created_at", "updated_at").dropDuplicates(["id"])
    return jobs.submit(jobs.submit(now, fresh.unionByName(now)), fresh).groupBy("status").agg(F.count("*").alias("n"))


def _moved_sql(to: str, allowed: str) -> str:
    return f"SELECT id, '{to}' AS target, CASE WHEN status IN ({allowed}) THEN '{to}' ELSE status END AS status FROM l"


@query(_LATEST + " " + " UNION ALL ".join(_moved_sql(to, allowed) for to, allowed in (("pending", "'failed'"), ("running", "'pending'"), ("completed", "'running'"), ("failed", "'pending', 'running'"))))
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    now = _current(spark, d).withColumn("error", F.lit(None).cast("string"))
    moved = [jobs.transition(now, now.select("id", F.lit(to).alias("status"), F.lit(None).cast("string").alias("error"))).select("id", F.lit(to).alias("target"), "status") for to in jobs.STATUSES]
    return moved[0].union(moved[1]).union(moved[2]).union(moved[3])


@query(_LATEST + " SELECT collection_id, count(*) AS n_jobs, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS n_ended, round(count(*) FILTER (WHERE status IN ('completed', 'failed')) / count(*), 6) AS share FROM l GROUP BY 1")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    return jobs.progress(_current(spark, d)).withColumn("share", F.round("share", 6))


@query(_LATEST + " SELECT id, CASE WHEN status IN ('pending', 'running') THEN 'failed' WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('pending', 'running') THEN 'cancelled' END AS error FROM l")
def cancel_and_retry(spark: SparkSession, d: str) -> DataFrame:
    """What runs or waits is cancelled; what had failed is to be done again."""
    now = _current(spark, d).withColumn("error", F.lit(None).cast("string"))
    failed = now.where("status = 'failed'").select("id")
    return jobs.retry(jobs.cancel(now, now.join(failed, "id", "left_anti").select("id")), failed).select("id", "status", "error")


@query(_LATEST + " SELECT id AS job_id, status, job_type, epoch_us(coalesce(updated_at, created_at)) AS changed FROM l")
def job_status_view(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select(F.col("id").alias("job_id"), "status", "job_type", F.unix_micros(F.coalesce("updated_at", "created_at")).alias("changed"))


@query("""WITH c AS (SELECT DISTINCT id, document_id, chunk_index, chunk_text, embedding FROM document_chunks) SELECT document_id, chunk_index, CAST(len(embedding) AS BIGINT) AS dimension FROM c WHERE embedding IS NOT NULL""")
def zip_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and their vectors, kept apart, by position."""
    chunks = _chunks(spark, d)
    out = rag.zip_vectors(chunks.select("document_id", "chunk_index", "chunk_text"), chunks.where("embedding is not null").select("document_id", "chunk_index", "embedding"))
    return out.select("document_id", "chunk_index", _int(F.size("embedding")).alias("dimension"))
