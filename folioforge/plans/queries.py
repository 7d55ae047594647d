"""Queries of the reference's operators over the test tables, each with the SQL that DuckDB can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import tokens
from folioforge.functions.embedding import bag_weights
from folioforge.operators import catalog, chunking, formats, ingest, jobs, layout, metadata, models, prompts, rates, search
from folioforge.plans import rag
from folioforge.session import shared_dir, table
from folioforge.sources.html import html_text
from folioforge.sources.sinks import is_folder
from folioforge.streaming.jobs import run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MAX_BYTES = 1 << 20
QUESTION = "What does the document say about the budget?"
TASK = {
    "prompt": "{{ instruction }}\n\nText:\n{{ document_text }}\n\n{{ question }}\n{{ answer_format }}",
    "instruction": "You analyse reports and quote what they say.",
    "question": "Which findings does the text report?",
    "answer_format": "Answer with a JSON object that has a list named response.",
}
AS_OF = "2026-01-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without replayed rows."""
    return table(spark, d, "document_chunks").dropDuplicates(["id"])


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def _int(c: Column | str) -> Column:
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


# Search. The embeddings table stands for chunks with vectors: label is the collection, vec_id the chunk and its document.

_HITS = """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"""


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("collection_id"), F.col("vec_id").alias("document_id"), "embedding")


def _named_docs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.col("original_filename").alias("filename"), "text", "document_metadata")


@query(_HITS + """
SELECT e.vec_id AS chunk_id, CAST(e.label AS BIGINT) AS collection_id, d.doc_id AS document_id, d.original_filename AS filename, round(list_distance(e.embedding::DOUBLE[], q.v), 6) AS distance
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id CROSS JOIN q WHERE e.label = 2 ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id LIMIT 5""")
def knn_collection_top5(spark: SparkSession, d: str) -> DataFrame:
    hits = search.search_scope(_vectors(spark, d), _named_docs(spark, d).select("document_id", "filename"), _vector(spark, d), "collection_id", 2, "chunk_id")
    return hits.select("chunk_id", "collection_id", "document_id", "filename", F.round("distance", 6).alias("distance"))


_DOC_QUERY = """WITH c AS (SELECT DISTINCT id, document_id, embedding FROM document_chunks WHERE len(embedding) = 96),
q AS (SELECT document_id, embedding::DOUBLE[] AS v FROM c ORDER BY id LIMIT 1)"""


@query(_DOC_QUERY + """
SELECT c.id AS chunk_id, c.document_id, d.original_filename AS filename, round(list_distance(c.embedding::DOUBLE[], q.v), 6) AS distance
FROM c JOIN q ON c.document_id = q.document_id JOIN documents d ON d.id = c.document_id ORDER BY list_distance(c.embedding::DOUBLE[], q.v), c.id LIMIT 5""")
def knn_document_top5(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d).where(F.size("embedding") == 96).select("id", "document_id", "embedding")
    first = chunks.orderBy("id").first()
    docs = _docs(spark, d).select(F.col("id").alias("document_id"), F.col("original_filename").alias("filename"))
    hits = search.search_scope(chunks, docs, list(first.embedding), "document_id", first.document_id, "id")
    return hits.select(F.col("id").alias("chunk_id"), "document_id", "filename", F.round("distance", 6).alias("distance"))


_BATCH = """q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT q.query_id, e.vec_id AS chunk_id, list_distance(e.embedding::DOUBLE[], q.v) AS distance, row_number() OVER (PARTITION BY q.query_id ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id) AS rank
FROM q CROSS JOIN embeddings e{where})"""


def _batched(spark: SparkSession, d: str, k: int, same: str | None = None) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.batched_top_k(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", k, same).withColumnRenamed("id", "chunk_id")


@query("WITH " + _BATCH.format(where="") + " SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 5")
def knn_batched_top5(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, 5).select("query_id", "chunk_id", _int("rank").alias("rank"), F.round("distance", 6).alias("distance"))


@query(_HITS + """,
a AS (SELECT e.vec_id AS query_id, e.embedding::DOUBLE[] AS v FROM embeddings e CROSS JOIN q WHERE e.label = 1 ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id LIMIT 5),
r AS (SELECT a.query_id, e.vec_id AS chunk_id, list_distance(e.embedding::DOUBLE[], a.v) AS distance, row_number() OVER (PARTITION BY a.query_id ORDER BY list_distance(e.embedding::DOUBLE[], a.v), e.vec_id) AS rank FROM a JOIN embeddings e ON e.label = 2)
SELECT query_id AS analysis_id, chunk_id AS reference_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 3""")
def comparative_analysis(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    analysed = search.top_k(rows.where("label = 1"), _vector(spark, d), "embedding", "vec_id", 5)
    found = search.batched_top_k(rows.where("label = 2"), analysed.select("vec_id", "embedding"), "vec_id", "embedding", 3)
    return found.select(F.col("query_id").alias("analysis_id"), F.col("id").alias("reference_id"), _int("rank").alias("rank"), F.round("distance", 6).alias("distance"))


@query("WITH " + _BATCH.format(where=" ON e.vec_id % 100 <> 0").replace("CROSS JOIN", "JOIN") + """
SELECT r.query_id, r.chunk_id, d.original_filename AS filename, round(r.distance, 6) AS distance FROM r LEFT JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank = 1""")
def citation_best_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    best = search.batched_top_k(rows.where(F.col("vec_id") % 100 != 0), rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 1)
    named = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("original_filename").alias("filename"))
    return best.join(named, "id", "left").select("query_id", F.col("id").alias("chunk_id"), "filename", F.round("distance", 6).alias("distance"))


@query("WITH " + _BATCH.format(where=" ON e.vec_id <> q.query_id").replace("CROSS JOIN", "JOIN") + """
SELECT r.query_id, r.chunk_id, d.original_filename AS filename, round(r.distance, 6) AS distance FROM r LEFT JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank = 1""")
def citation_best_match_all(spark: SparkSession, d: str) -> DataFrame:
    """The same against all rows but the query itself."""
    others = _batched(spark, d, 2).where("chunk_id <> query_id")
    best = others.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "distance"), "rank").alias("best")).select("query_id", "best.*")
    named = _docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("original_filename").alias("filename"))
    return best.join(named, "chunk_id", "left").select("query_id", "chunk_id", "filename", F.round("distance", 6).alias("distance"))


@query(_HITS + """, c AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v FROM embeddings e CROSS JOIN q WHERE e.label = 3 ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id LIMIT 20)
SELECT c.vec_id AS chunk_id, round(list_cosine_similarity(c.v, q.v), 6) AS score FROM c CROSS JOIN q ORDER BY list_cosine_similarity(c.v, q.v) DESC, c.vec_id LIMIT 5""")
def two_stage_rerank(spark: SparkSession, d: str) -> DataFrame:
    vector = _vector(spark, d)
    candidates = search.top_k(table(spark, d, "embeddings").where("label = 3"), vector, "embedding", "vec_id", 20)
    return search.rerank(candidates, vector, "embedding", "vec_id").select(F.col("vec_id").alias("chunk_id"), F.round("score", 6).alias("score"))


# Ingestion.


@query("SELECT doc_id, sha256(text) AS computed_hash, CAST(strlen(text) AS BIGINT) AS computed_size, sha256(text) = lower(content_hash) AS matches FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.fingerprint(_docs(spark, d))
    return out.select("doc_id", "computed_hash", "computed_size", (F.col("computed_hash") == F.lower("content_hash")).alias("matches"))


_MIME = "CASE lower(regexp_extract(original_filename, '\\.([^./]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MIME_BY_EXTENSION.items()) + f" ELSE '{T.OCTET_STREAM}' END"


@query(f"SELECT doc_id, {_MIME} AS guessed_mime, ({_MIME}) = mime_type AS matches FROM documents")
def mime_guess(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.with_mime(_docs(spark, d))
    return out.select("doc_id", "guessed_mime", (F.col("guessed_mime") == F.col("mime_type")).alias("matches"))


@query(f"SELECT doc_id, file_size, file_size <= {MAX_BYTES} AS fits FROM documents")
def size_limit_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "file_size", (F.col("file_size") <= T.parse_file_size(F.lit("1 MB"))).alias("fits"))


_UNIT = "CASE doc_id % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'kb' WHEN 2 THEN ' MB' WHEN 3 THEN '.5 Gb' ELSE ' XB' END"


@query(f"""WITH s AS (SELECT doc_id, concat(n_chars, {_UNIT}) AS size FROM documents)
SELECT doc_id, size, CAST(floor(TRY_CAST(nullif(regexp_extract(upper(size), '^(\\d+(?:\\.\\d+)?)\\s*([KMGT]?B)$', 1), '') AS DOUBLE)
* CASE regexp_extract(upper(size), '^(\\d+(?:\\.\\d+)?)\\s*([KMGT]?B)$', 2) WHEN 'B' THEN 1 WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 WHEN 'TB' THEN 1099511627776 END) AS BIGINT) AS n_bytes FROM s""")
def parse_file_size(spark: SparkSession, d: str) -> DataFrame:
    unit = F.expr(_UNIT)
    out = _docs(spark, d).select("doc_id", F.concat(F.coalesce(F.col("n_chars").cast("string"), F.lit("")), unit).alias("size"))
    return out.select("doc_id", "size", T.parse_file_size(F.col("size")).alias("n_bytes"))


_DECIDED = f"""WITH f AS (SELECT *, lower(content_hash) AS k FROM documents),
w AS (SELECT collection_id, k, arg_min(doc_id, (created_at, doc_id)) AS winner FROM f WHERE file_size <= {MAX_BYTES} GROUP BY 1, 2),
x AS (SELECT f.doc_id, f.collection_id, f.file_size, CASE WHEN f.file_size > {MAX_BYTES} THEN 'too_large' WHEN w.winner <> f.doc_id THEN 'duplicate' ELSE 'accepted' END AS reason, w.winner
FROM f LEFT JOIN w ON f.collection_id = w.collection_id AND f.k = w.k)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return ingest.decide(_docs(spark, d), MAX_BYTES)


@query(_DECIDED + " SELECT doc_id, collection_id FROM x WHERE reason = 'accepted'")
def dedup_accepted(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).where("reason = 'accepted'").select("doc_id", "collection_id")


@query(_DECIDED + " SELECT doc_id, reason, CASE WHEN reason = 'duplicate' THEN winner END AS winner FROM x WHERE reason <> 'accepted'")
def dedup_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).where("reason <> 'accepted'").select("doc_id", "reason", "winner")


@query(_DECIDED + " SELECT collection_id, reason, count(*) AS n_documents, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM x GROUP BY 1, 2")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest.summary(_decided(spark, d))


@query("""SELECT doc_id, regexp_extract(original_filename, '(\\.[^./]*)$', 1) AS suffix, regexp_replace(original_filename, '^(.+)\\.[^.]*$', '\\1') AS stem,
concat(substr(sha256(id), 1, 8), '-', substr(sha256(id), 9, 4), '-', substr(sha256(id), 13, 4), '-', substr(sha256(id), 17, 4), '-', substr(sha256(id), 21, 12), regexp_extract(original_filename, '(\\.[^./]*)$', 1)) AS stored FROM documents""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("original_filename")
    return _docs(spark, d).select("doc_id", F.regexp_extract(name, r"(\.[^./]*)$", 1).alias("suffix"), T.stem(name).alias("stem"), T.stored_name(F.col("id"), name).alias("stored"))


# Text.

_WS = T.WHITE_SPACE
_CLEAN = f"regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT doc_id, CAST(length({_CLEAN}) AS BIGINT) AS n_chars, sha256({_CLEAN}) AS hash FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    clean = T.clean_text(F.col("text"))
    return _docs(spark, d).select("doc_id", _int(F.length(clean)).alias("n_chars"), _sha(clean).alias("hash"))


def _windows_sql(source: str, size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""WITH t AS ({source}), n AS (SELECT doc_id, x, CASE WHEN length(x) <= {size} THEN 1 ELSE CAST(ceil(length(x) / {float(stride)}) AS BIGINT) END AS n FROM t WHERE x IS NOT NULL),
c AS (SELECT doc_id, i AS chunk_index, substr(x, CAST(i * {stride} + 1 AS BIGINT), {size}) AS c FROM (SELECT doc_id, x, unnest(range(0, n)) AS i FROM n))
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS hash FROM c"""


def _hashed(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", _int(F.length("chunk_text")).alias("n_chars"), _sha(F.col("chunk_text")).alias("hash"))


@query(_windows_sql("SELECT doc_id, text AS x FROM documents", 4000, 200))
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(chunking.explode_chunks(_docs(spark, d), chunking.fixed_windows(F.col("text")), "doc_id"))


@query(_windows_sql(f"SELECT doc_id, {_CLEAN} AS x FROM documents", 1000, 100))
def preprocess_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(chunking.explode_chunks(_docs(spark, d).withColumn("clean", T.clean_text(F.col("text"))), chunking.fixed_windows(F.col("clean"), 1000, 100), "doc_id"))


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(chunking.explode_chunks(_docs(spark, d).select("doc_id", "text"), chunking.recursive_chunks(F.col("text")), "doc_id"))


_JOIN = """WITH c AS (SELECT DISTINCT id, document_id, chunk_index, chunk_text FROM document_chunks{where})
SELECT document_id, CAST(length(string_agg(chunk_text, '{sep}' ORDER BY chunk_index, chunk_text)) AS BIGINT) AS n_chars, sha256(string_agg(chunk_text, '{sep}' ORDER BY chunk_index, chunk_text)) AS hash FROM c GROUP BY 1"""


def _joined(spark: SparkSession, d: str, separator: str, first: int | None = None) -> DataFrame:
    out = chunking.concatenate(_chunks(spark, d), "document_id", "chunk_index", "chunk_text", separator, first)
    return out.select("document_id", _int(F.length("text")).alias("n_chars"), _sha(F.col("text")).alias("hash"))


@query(_JOIN.format(where="", sep="\n"))
def document_text_concat(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "\n")


@query(_JOIN.format(where=" WHERE chunk_index < 3", sep="\n\n"))
def first_n_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "\n\n", 3)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS weight FROM b""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return bag_weights(_docs(spark, d), "doc_id", "text").select(F.col("id").alias("doc_id"), "bucket", F.round("weight", 6).alias("weight"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    out = _docs(spark, d).select("doc_id", html_text(F.col("text")).alias("plain"))
    return out.select("doc_id", _int(F.length("plain")).alias("n_chars"), _sha(F.col("plain")).alias("hash"))


# Prompts and model calls.

_RAG = "WITH " + _BATCH.format(where="") + """, h AS (SELECT r.query_id, r.rank, r.chunk_id, d.text, d.original_filename FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 5)"""
_ASKED = f"'Based on the following text, answer the question: ''{QUESTION}''.' || chr(10) || chr(10) || 'Text: ' || "


def _hits(spark: SparkSession, d: str) -> DataFrame:
    found = _batched(spark, d, 5).join(_named_docs(spark, d), F.col("chunk_id") == F.col("document_id"))
    return found.select("query_id", "rank", "chunk_id", F.col("text").alias("chunk_text"), "filename", "document_metadata", F.lit(QUESTION).alias("question"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.lit(QUESTION).alias("question"))


_MERGED = "string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank)"


@query(_RAG + f" SELECT query_id, sha256({_MERGED}) AS hash FROM h WHERE text IS NOT NULL GROUP BY 1")
def merge_context(spark: SparkSession, d: str) -> DataFrame:
    return rag.merged_context(_hits(spark, d).where("chunk_text is not null")).select("query_id", _sha(F.col("text")).alias("hash"))


@query(_RAG + f" SELECT query_id, chunk_id, sha256({_ASKED} text) AS hash FROM h")
def question_prompt_separate(spark: SparkSession, d: str) -> DataFrame:
    return rag.separate_prompts(_hits(spark, d)).select("query_id", "chunk_id", _sha(F.col("prompt")).alias("hash"))


@query(_RAG + f" SELECT query_id, sha256({_ASKED} {_MERGED}) AS hash FROM h WHERE text IS NOT NULL GROUP BY 1")
def question_prompt_merge(spark: SparkSession, d: str) -> DataFrame:
    return rag.merged_prompts(_hits(spark, d).where("chunk_text is not null"), _questions(spark, d)).select("query_id", _sha(F.col("prompt")).alias("hash"))


def _pieces_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
    return f"(CASE WHEN {bare} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({bare}, '{_WS}+') END)"


def _frame_sql(inner: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    nl = "chr(10) || chr(10)"
    return f"{q(TASK['instruction'])} || {nl} || 'Text:' || chr(10) || {inner} || {nl} || {q(TASK['question'])} || chr(10) || {q(TASK['answer_format'])}"


_FRAME_TOKENS = len((TASK["instruction"] + " Text: " + TASK["question"] + " " + TASK["answer_format"]).split())


def _prompt_sql(max_length: int) -> str:
    budget = max_length - _FRAME_TOKENS
    cut = f"CASE WHEN len(p) > {budget} THEN array_to_string(list_slice(p, 1, {budget}), ' ') || chr(10) || '... [TRUNCATED DUE TO CONTEXT LIMIT] ...' ELSE text END"
    return f"WITH t AS (SELECT doc_id, text, {_pieces_sql('text')} AS p FROM documents) SELECT doc_id, len(p) > {budget} AS truncated, sha256({_frame_sql(f'coalesce({cut}, {chr(39)}{chr(39)})')}) AS hash FROM t WHERE text IS NOT NULL"


def _prompted(spark: SparkSession, d: str, max_length: int) -> DataFrame:
    docs = _docs(spark, d).where("text is not null")
    out = rag.analysis_prompts(docs, TASK, max_length)
    return out.select("doc_id", (tokens.count(F.col("text")) > max_length - _FRAME_TOKENS).alias("truncated"), _sha(F.col("prompt")).alias("hash"))


@query(_prompt_sql(128_000))
def analysis_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d, 128_000)


@query(_prompt_sql(120))
def truncated_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d, 120)


@query("SELECT doc_id, 'llm_cache:' || sha256(text || chr(31) || 'echo' || chr(31) || '{}') AS cache_key FROM documents WHERE text IS NOT NULL")
def llm_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", models.cache_key(F.col("text"), F.lit("echo")).alias("cache_key"))


@query(f"""WITH t AS (SELECT doc_id, len({_pieces_sql('text')}) AS a, len({_pieces_sql("('[echo] ' || substr(text, 1, 200))")}) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(a AS BIGINT) AS prompt_tokens, CAST(b AS BIGINT) AS completion_tokens, round(a / 1000.0::DOUBLE * 0.0015::DOUBLE + b / 1000.0::DOUBLE * 0.002::DOUBLE, 8) AS cost FROM t""")
def llm_echo_cost(spark: SparkSession, d: str) -> DataFrame:
    out = models.echo_responses(_docs(spark, d).where("text is not null"), "text")
    return out.select("doc_id", "prompt_tokens", "completion_tokens", F.round("cost", 8).alias("cost"))


_QUESTION_SQL = "CASE WHEN json_valid(data) THEN json_extract_string(data, '$.question') END"


@query(f"""WITH j AS (SELECT DISTINCT id, {_QUESTION_SQL} AS question, created_at FROM jobs), p AS (SELECT * FROM j WHERE question IS NOT NULL),
c AS (SELECT question, min(created_at) AS first FROM p GROUP BY 1)
SELECT p.id AS job_id, p.created_at > c.first AND p.created_at <= c.first + INTERVAL 3600 SECOND AS hit FROM p JOIN c USING (question)""")
def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "jobs").select("id", F.try_variant_get(F.try_parse_json("data"), "$.question", "string").alias("question"), "created_at").distinct().where("question is not null")
    first = asked.groupBy("question").agg(F.min("created_at").alias("first"))
    hit = (F.col("created_at") > F.col("first")) & (F.col("created_at") <= F.col("first") + F.expr(f"interval {models.TTL_SECONDS} seconds"))
    return asked.join(first, "question").select(F.col("id").alias("job_id"), hit.alias("hit"))


@query(_RAG + f" SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS BIGINT) AS answer_no, original_filename AS filename, '[echo] ' || substr({_ASKED} text, 1, 200) AS content, sha256(text) AS hash FROM h WHERE text IS NOT NULL")
def rag_answers_separate(spark: SparkSession, d: str) -> DataFrame:
    out = rag.answer(_questions(spark, d), _hits(spark, d).where("chunk_text is not null"), "separate")
    parts = out.select("query_id", F.posexplode(F.from_json(F.get_json_object("data", "$.results"), "array<struct<source struct<filename string, chunk_text string>, llm_response struct<content string>>>")).alias("answer_no", "r"))
    return parts.select("query_id", _int("answer_no").alias("answer_no"), F.col("r.source.filename").alias("filename"), F.col("r.llm_response.content").alias("content"), _sha(F.col("r.source.chunk_text")).alias("hash"))


@query(_RAG + f", m AS (SELECT query_id, {_ASKED} {_MERGED} AS prompt FROM h WHERE text IS NOT NULL GROUP BY 1) SELECT query_id, '[echo] ' || substr(prompt, 1, 200) AS content FROM m")
def rag_answers_merged(spark: SparkSession, d: str) -> DataFrame:
    out = rag.answer(_questions(spark, d), _hits(spark, d).where("chunk_text is not null"), "merge")
    return out.select("query_id", F.get_json_object("data", "$.result.content").alias("content")).where("content is not null")


@query()
def indexed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return rag.index(_docs(spark, d)).select("document_id", "chunk_index", "chunk_id", _int(F.size("embedding")).alias("dimension"))


# Metadata.

_META = "CASE WHEN json_valid(document_metadata) THEN document_metadata::JSON END"


@query(f"""WITH m AS (SELECT doc_id, {_META} AS m FROM documents), a AS (SELECT doc_id, unnest(json_extract_string(m, '$.authors[*]')) AS author FROM m)
SELECT doc_id, author FROM a""")
def author_split(spark: SparkSession, d: str) -> DataFrame:
    listed = F.from_json(F.get_json_object("document_metadata", "$.authors"), "array<string>")
    return _docs(spark, d).select("doc_id", F.explode(T.split_authors(F.array_join(listed, "; "))).alias("author"))


def _raw(c: str = "document_metadata") -> Column:
    return F.get_json_object(c, "$._raw_file_metadata")


#: File properties made of a document's id: every third of a key is blank, every fifth absent, and authors are a text or a list.
def _made(key: str, k: int) -> str:
    return f"CASE WHEN (doc_id + {k}) % 5 = 0 THEN NULL WHEN (doc_id + {k}) % 3 = 0 THEN ' ' ELSE concat(' ', '{key}; of ', doc_id, ', x,, ') END"


_SOURCES = [source for source, _ in metadata.FILE_KEYS] + ["Producer", "creator"]
_BY_TARGET: dict[str, list[str]] = {}
for _k, (_source, _target) in enumerate(metadata.FILE_KEYS):
    _BY_TARGET.setdefault(_target, []).insert(0, f"nullif(trim({_made(_source, _k)}), '')")


def _mapped_sql(target: str, values: list[str]) -> str:
    value = f"coalesce({', '.join(values)})"
    if target == "authors":
        value = f"CAST(to_json(list_filter(list_transform(string_split(replace({value}, ';', ','), ','), lambda a: trim(a)), lambda a: a <> '')) AS VARCHAR)"
    return f"SELECT doc_id, '{target}' AS key, {value} AS value FROM documents"


@query("SELECT * FROM (" + " UNION ALL ".join(_mapped_sql(t, v) for t, v in _BY_TARGET.items()) + ") WHERE value IS NOT NULL")
def metadata_key_map(spark: SparkSession, d: str) -> DataFrame:
    made = F.map_from_arrays(F.array(*[F.lit(x) for x in _SOURCES]), F.array(*[F.expr(_made(x, k)) for k, x in enumerate(_SOURCES)]))
    return _docs(spark, d).select("doc_id", F.explode(metadata.map_file_keys(made)))


_SCALARS = ("title", "publication_date", "publisher", "doi", "source_url", "language", "document_type")


@query(f"""WITH m AS (SELECT doc_id, {_META} AS m FROM documents),
e AS (""" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, " + ("coalesce(nullif(json_extract_string(m, '$.title'), ''), nullif(json_extract_string(m, '$._raw_file_metadata.Title'), ''))" if k == "title" else f"nullif(json_extract_string(m, '$.{k}'), '')") + " AS value FROM m" for k in _SCALARS) + """),
f AS (SELECT * FROM e WHERE value IS NOT NULL)
SELECT * FROM f UNION ALL SELECT DISTINCT doc_id, 'llm_extracted', 'true' FROM f UNION ALL SELECT DISTINCT doc_id, 'extraction_method', 'llm_analysis' FROM f""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw()
    extracted = F.map_filter(metadata.as_map(F.col("document_metadata")), lambda k, _: k.isin(*_SCALARS))
    merged = metadata.merge(metadata.as_map(raw), extracted, raw)
    return _docs(spark, d).select("doc_id", F.explode(merged)).where("key <> '_raw_file_metadata'")


@query(f"""WITH m AS (SELECT doc_id, lang, {_META} AS m FROM documents)
SELECT doc_id, coalesce(lang, json_extract_string(m, '$.language')) AS language, CASE WHEN lang IS NULL THEN 'document_type' ELSE 'document_type,language' END AS fields FROM m""")
def manual_update(spark: SparkSession, d: str) -> DataFrame:
    updated = metadata.update_manually(metadata.as_map(F.col("document_metadata")), {"language": F.col("lang"), "document_type": "report", "publisher": None})
    return _docs(spark, d).select("doc_id", updated.alias("u")).select("doc_id", F.col("u")["language"].alias("language"), F.col("u")["manual_update_fields"].alias("fields"))


_ANSWER = """WITH r AS (SELECT DISTINCT job_id, data FROM results), o AS (SELECT job_id, CASE WHEN left(ltrim(data), 1) = '"' THEN json_extract_string(data, '$') ELSE data END AS data FROM r),
s AS (SELECT job_id, CAST(json_extract(data, '$.results') AS JSON[]) AS l FROM o WHERE json_extract(data, '$.results') IS NOT NULL),
a AS (SELECT job_id, 0 AS answer_no, coalesce(json_extract_string(data, '$.result.content'), json_extract_string(data, '$.content')) AS content FROM o WHERE json_extract(data, '$.results') IS NULL
UNION ALL SELECT job_id, n AS answer_no, json_extract_string(r, '$.llm_response.content') FROM (SELECT job_id, unnest(range(len(l))) AS n, unnest(l) AS r FROM s))"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """The content of all answers: merged ones, those to single hits in their order, and those to single files.

    A result that is encoded twice is a JSON string that holds the object.
    """
    data = F.when(F.ltrim("data").startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), F.col("data"), F.lit("}")), "$.x")).otherwise(F.col("data"))
    rows = table(spark, d, "results").select("job_id", "data").distinct().select("job_id", data.alias("data"))
    several = F.from_json(F.get_json_object("data", "$.results"), "array<string>")
    one = F.coalesce(F.get_json_object("data", "$.result.content"), F.get_json_object("data", "$.content"))
    contents = F.when(several.isNotNull(), F.transform(several, lambda r: F.get_json_object(r, "$.llm_response.content"))).otherwise(F.array(one))
    return rows.select("job_id", F.posexplode(contents).alias("answer_no", "content")).withColumn("answer_no", _int("answer_no"))


@query(_ANSWER + " SELECT job_id, answer_no, regexp_extract(content, '(?s)```json\\n(.*?)\\n```', 1) AS inner_json FROM a WHERE regexp_matches(content, '(?s)```json\\n(.*?)\\n```')")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    out = _answers(spark, d).where(F.col("content").rlike(r"(?s)```json\n.*?\n```"))
    return out.select("job_id", "answer_no", T.strict_fence(F.col("content")).alias("inner_json"))


_TITLE = "array_to_string(list_transform(string_split(replace({k}, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_SHOWN = f"""m AS (SELECT id, {_META} AS m FROM documents), e AS (SELECT id, m, unnest(json_keys(m)) AS k FROM m WHERE m IS NOT NULL),
v AS (SELECT id, k, json_extract(m, '$."' || k || '"') AS j FROM e WHERE left(k, 1) <> '_'),
t AS (SELECT id, k, CASE json_type(j) WHEN 'ARRAY' THEN array_to_string(json_extract_string(j, '$[*]'), ', ') ELSE json_extract_string(j, '$') END AS x FROM v WHERE json_type(j) <> 'NULL'),
shown AS (SELECT id, sha256(string_agg({_TITLE.format(k="k")} || ': ' || x, chr(10) ORDER BY k)) AS hash FROM t GROUP BY 1)"""


@query("WITH " + _SHOWN + " SELECT d.doc_id, coalesce(s.hash, sha256('')) AS hash FROM documents d LEFT JOIN shown s ON s.id = d.id")
def display_details(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _sha(metadata.display(metadata.as_map(F.col("document_metadata")))).alias("hash"))


# Catalogue and jobs.


@query("SELECT id AS collection_id, name FROM collections")
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collections").select(F.col("id").alias("collection_id"), "name")


@query("""WITH x AS (SELECT collection_id, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS b FROM documents GROUP BY 1), c AS (SELECT collection_id, count(DISTINCT id) AS n FROM document_chunks GROUP BY 1)
SELECT k.id AS collection_id, k.name, coalesce(x.n, 0) AS n_documents, coalesce(c.n, 0) AS n_chunks, coalesce(x.b, 0) AS n_bytes FROM collections k LEFT JOIN x ON x.collection_id = k.id LEFT JOIN c ON c.collection_id = k.id""")
def collection_detail_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.collection_counts(table(spark, d, "collections"), _docs(spark, d), table(spark, d, "document_chunks"))


@query("WITH " + _SHOWN + " SELECT d.id, collection_id, filename, original_filename, lower(content_hash) AS content_hash, file_size, mime_type, coalesce(s.hash, sha256('')) AS shown FROM documents d LEFT JOIN shown s ON s.id = d.id")
def document_detail(spark: SparkSession, d: str) -> DataFrame:
    return catalog.document_details(_docs(spark, d)).withColumn("shown", _sha(F.col("shown")))


@query("""WITH w AS (SELECT id AS identifier FROM collections UNION ALL SELECT name FROM collections UNION ALL SELECT 'no such collection' UNION ALL SELECT '00000000-0000-0000-0000-000000000000')
SELECT w.identifier, coalesce(a.id, CASE WHEN NOT regexp_matches(w.identifier, '^[0-9a-fA-F]{8}-') THEN b.id END) AS collection_id FROM w LEFT JOIN collections a ON a.id = w.identifier LEFT JOIN collections b ON b.name = w.identifier""")
def resolve_identifier(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "collections")
    extra = spark.createDataFrame([("no such collection",), ("00000000-0000-0000-0000-000000000000",)], "identifier string")
    return jobs.resolve_collections(known.select(F.col("id").alias("identifier")).union(known.select("name")).union(extra), known)


_LATEST = """WITH v AS (SELECT DISTINCT id, document_id, collection_id, job_type, status, created_at, updated_at, CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS r FROM jobs),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, coalesce(updated_at, created_at) DESC, status DESC) AS n FROM v) WHERE n = 1)"""


@query(_LATEST + " SELECT id AS job_id, job_type, status FROM l")
def job_status_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(_versions(spark, d)).select(F.col("id").alias("job_id"), "job_type", "status")


@query(_LATEST + " SELECT id AS job_id, job_type FROM l WHERE status = 'pending'")
def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.pending(_versions(spark, d)).select(F.col("id").alias("job_id"), "job_type")


@query(_LATEST + " SELECT CASE WHEN job_type IN ('batch', 'indexing', 'query', 'analysis', 'document_query', 'document_analysis', 'batch_indexing') THEN job_type ELSE 'single_file' END AS handler, status, count(*) AS n FROM l GROUP BY 1, 2")
def job_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return jobs.dispatch(jobs.latest(_versions(spark, d))).groupBy("handler", "status").agg(F.count("*").alias("n"))


@query(_LATEST + """, w AS (SELECT id AS job_id FROM l UNION SELECT job_id FROM results UNION SELECT 'no such job'), r AS (SELECT DISTINCT job_id FROM results)
SELECT w.job_id, CAST(CASE WHEN l.id IS NULL THEN 404 WHEN l.status <> 'completed' THEN 400 WHEN r.job_id IS NULL THEN 404 ELSE 200 END AS BIGINT) AS http_status FROM w LEFT JOIN l ON l.id = w.job_id LEFT JOIN r ON r.job_id = w.job_id""")
def result_gate(spark: SparkSession, d: str) -> DataFrame:
    all_jobs, results = table(spark, d, "jobs"), table(spark, d, "results")
    wanted = all_jobs.select(F.col("id").alias("job_id")).union(results.select("job_id")).union(spark.createDataFrame([("no such job",)], "job_id string"))
    return jobs.result_gate(wanted, all_jobs, results).select("job_id", _int("http_status").alias("http_status"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Jobs without their data."""
    return table(spark, d, "jobs").select("id", "job_type", "status", "created_at", "updated_at")


def _store(spark: SparkSession, d: str) -> jobs.Store:
    return jobs.Store(*[table(spark, d, t) for t in ("collections", "documents", "document_chunks", "jobs", "results")])


def _sizes(spark: SparkSession, store: jobs.Store) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("tab"), F.count("*").alias("n")) for name, df in (("collections", store.collections), ("documents", store.documents), ("document_chunks", store.chunks), ("jobs", store.jobs), ("results", store.results))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH g AS (SELECT collection_id FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), j AS (SELECT DISTINCT id FROM jobs WHERE collection_id IN (SELECT collection_id FROM g))
SELECT 'collections' AS tab, count(*) AS n FROM collections WHERE id NOT IN (SELECT collection_id FROM g) UNION ALL SELECT 'documents', count(*) FROM documents WHERE collection_id NOT IN (SELECT collection_id FROM g)
UNION ALL SELECT 'document_chunks', count(*) FROM document_chunks WHERE collection_id NOT IN (SELECT collection_id FROM g)
UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE collection_id IS NULL OR collection_id NOT IN (SELECT collection_id FROM g) UNION ALL SELECT 'results', count(*) FROM results WHERE job_id NOT IN (SELECT id FROM j)""")
def cascade_delete_collection(spark: SparkSession, d: str) -> DataFrame:
    largest = _docs(spark, d).groupBy("collection_id").count().orderBy(F.desc("count"), "collection_id").limit(1).select("collection_id")
    return _sizes(spark, _store(spark, d).delete_collections(largest))


@query("""WITH g AS (SELECT min(id) AS id FROM documents)
SELECT 'documents' AS tab, count(*) AS n FROM documents WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'document_chunks', count(*) FROM document_chunks WHERE document_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'jobs without document', count(*) FROM jobs WHERE document_id IS NULL OR document_id IN (SELECT id FROM g)""")
def delete_document(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d).delete_documents(_docs(spark, d).agg(F.min("id").alias("document_id")))
    counted = [store.documents.agg(F.lit("documents").alias("tab"), F.count("*").alias("n")), store.chunks.agg(F.lit("document_chunks").alias("tab"), F.count("*").alias("n")), store.jobs.where("document_id is null").agg(F.lit("jobs without document").alias("tab"), F.count("*").alias("n"))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("SELECT DISTINCT id AS job_id, job_type AS handler FROM jobs j WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM jobs k WHERE k.id = j.id AND k.status <> 'pending')")
def job_stream_available_now(spark: SparkSession, d: str) -> DataFrame:
    import os
    import uuid

    run = f"{shared_dir(spark)}/job-stream-{os.getpid()}-{uuid.uuid4().hex}"
    static = spark.read.parquet(f"{d}/jobs.parquet")
    # The source is a directory of Parquet files; a single file is one that the pattern singles out.
    folder, pattern = (f"{d}/jobs.parquet", "*") if is_folder(spark, f"{d}/jobs.parquet") else (d, "jobs.parquet")
    run_available(spark, folder, static.schema, f"{run}/sink", f"{run}/checkpoint", pattern=pattern)
    return spark.read.schema("id string, handler string, status string").parquet(f"{run}/sink").select(F.col("id").alias("job_id"), "handler")


@query("""SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS n_recent FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL""")
def rate_window_count(spark: SparkSession, d: str) -> DataFrame:
    return rates.window_counts(table(spark, d, "events"), "user_id", "ts").select("event_id", "n_recent")


# Formats.


@query(_ANSWER + " SELECT job_id, answer_no, coalesce(content, '') AS markdown FROM a")
def format_markdown(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.to_json(F.struct("content"))
    return _answers(spark, d).select("job_id", "answer_no", formats.as_markdown(wrapped).alias("markdown"))


_FENCED = _ANSWER + ", f AS (SELECT job_id, answer_no, regexp_extract(content, '(?s)```json\\n(.*?)\\n```', 1) AS j FROM a WHERE regexp_matches(content, '(?s)```json\\n(.*?)\\n```'))"


@query(_FENCED + " SELECT job_id, answer_no, array_to_string(list_transform(json_extract_string(j, '$.response[*]'), lambda x: '- ' || x), chr(10)) AS listed FROM f WHERE json_valid(j)")
def format_list(spark: SparkSession, d: str) -> DataFrame:
    out = _answers(spark, d).where(F.col("content").rlike(r"(?s)```json\n.*?\n```")).withColumn("j", T.strict_fence(F.col("content"))).where(F.try_parse_json("j").isNotNull())
    return out.select("job_id", "answer_no", formats.as_list(F.col("j")).alias("listed"))


def _cell(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


def _text_csv(spark: SparkSession, d: str, heading: str, text: Column) -> DataFrame:
    row = F.array(*[F.coalesce(c, F.lit("")) for c in (F.col("original_filename"), F.get_json_object("document_metadata", "$.title"), text)])
    data = F.to_json(F.struct(F.array(F.lit("file"), F.lit("title"), F.lit(heading)).alias("headers"), F.array(row).alias("rows")))
    return _docs(spark, d).select("doc_id", formats.as_csv(data).alias("csv"))


def _text_essay(spark: SparkSession, d: str, text: Column) -> DataFrame:
    section = F.struct(F.col("source").alias("heading"), T.strip(text).alias("content"))
    data = F.to_json(F.struct(F.get_json_object("document_metadata", "$.title").alias("title"), F.array(section).alias("sections")))
    return _docs(spark, d).select("doc_id", formats.as_essay(data).alias("essay"))


@query(f"""WITH m AS (SELECT doc_id, coalesce(original_filename, '') AS a, coalesce(json_extract_string({_META}, '$.title'), '') AS b, coalesce(text, '') AS c FROM documents)
SELECT doc_id, 'file,title,text' || chr(13) || chr(10) || {_cell('a')} || ',' || {_cell('b')} || ',' || {_cell('c')} || chr(13) || chr(10) AS csv FROM m""")
def format_table_csv(spark: SparkSession, d: str) -> DataFrame:
    return _text_csv(spark, d, "text", F.col("text"))


@query(f"""WITH m AS (SELECT doc_id, json_extract_string({_META}, '$.title') AS t, source, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS x FROM documents)
SELECT doc_id, regexp_replace('# ' || coalesce(t, 'Untitled Essay') || chr(10) || chr(10) || '## ' || coalesce(source, 'Introduction') || chr(10) || coalesce(x, ''), '{_WS}+$', '') AS essay FROM m""")
def format_essay(spark: SparkSession, d: str) -> DataFrame:
    return _text_essay(spark, d, F.col("text"))


# Pages. A chunk is a page, its index the page's.


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("document_id", F.col("chunk_index").alias("page"), F.col("chunk_text").alias("text"))


_PAGES = "WITH p AS (SELECT DISTINCT id, document_id, chunk_index AS page, chunk_text AS text FROM document_chunks)"


@query(_PAGES + " SELECT document_id, CASE WHEN sum(length(text)) > 100 THEN 'text' ELSE 'ocr' END AS reader FROM p WHERE page < 3 GROUP BY 1")
def pdf_triage(spark: SparkSession, d: str) -> DataFrame:
    return layout.triage(_pages(spark, d))


@query(_PAGES + f""", s AS (SELECT document_id, avg(CASE WHEN length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) > 100 THEN 1.0 ELSE 0.0 END) AS share FROM p WHERE page < 3 GROUP BY 1)
SELECT d.id AS document_id, CASE lower(regexp_extract(d.original_filename, '\\.([^./]*)$', 1)) WHEN 'pdf' THEN CASE WHEN share > 0.8 THEN 'text_pdf' WHEN share > 0.2 THEN 'mixed_pdf' ELSE 'scanned_pdf' END
WHEN 'epub' THEN 'epub' WHEN 'mobi' THEN 'mobi' ELSE 'image' END AS document_type FROM documents d LEFT JOIN s ON s.document_id = d.id""")
def document_type(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("id").alias("document_id"), T.extension(F.col("original_filename")).alias("extension"))
    return layout.document_types(docs, _pages(spark, d))


_ELEMENTS = _PAGES + ", e AS (SELECT document_id, page, page AS element_index, CASE WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS kind, text FROM p)"


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("document_id", "page", F.col("page").alias("element_index"), F.when(F.contains(F.col("text"), F.lit(" | ")), "table").otherwise("text").alias("kind"), "text")


@query(_ELEMENTS + " SELECT document_id, page, count(*) FILTER (WHERE kind = 'text') AS n_text, count(*) FILTER (WHERE kind = 'table') AS n_tables, coalesce(sha256(string_agg(text, chr(30) ORDER BY element_index, text) FILTER (WHERE kind = 'text')), sha256('')) AS hash FROM e GROUP BY 1, 2")
def page_grouping(spark: SparkSession, d: str) -> DataFrame:
    out = layout.group_pages(_elements(spark, d))
    return out.select("document_id", "page", _int(F.size("text_blocks")).alias("n_text"), _int(F.size("tables")).alias("n_tables"), _sha(F.array_join("text_blocks", "\x1e")).alias("hash"))


@query(_ELEMENTS + f""", g AS (SELECT document_id, string_agg(text, ' ' ORDER BY element_index) FILTER (WHERE kind = 'text') AS t FROM e GROUP BY 1)
SELECT document_id, coalesce(length(regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g')) >= 50, false) AS valid FROM g""")
def validate_result(spark: SparkSession, d: str) -> DataFrame:
    return layout.valid_results(_elements(spark, d), ["document_id"])


@query(_PAGES + """, c AS (SELECT document_id, CASE WHEN page < 3 THEN 'first' ELSE 'rest' END AS engine, sum(length(text)) AS n FROM p GROUP BY 1, 2)
SELECT document_id, arg_min(engine, CASE engine WHEN 'rest' THEN 1 ELSE 2 END) AS engine FROM c WHERE n >= 400 GROUP BY 1""")
def engine_choice(spark: SparkSession, d: str) -> DataFrame:
    engine = F.when(F.col("page") < 3, "first").otherwise("rest")
    tried = _pages(spark, d).groupBy("document_id", engine.alias("engine")).agg((F.sum(F.length("text")) >= 400).alias("valid"))
    return layout.choose_engine(tried.withColumn("priority", F.when(F.col("engine") == "rest", 1).otherwise(2))).select("document_id", "engine")
