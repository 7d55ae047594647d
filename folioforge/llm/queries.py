"""The queries on problems of training data, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.bpe import token_count, token_ids
from folioforge.llm.languages import label_languages, train_on, wrong_labels
from folioforge.llm.neardup import NearDuplicates, near_duplicates
from folioforge.llm.packing import pack
from folioforge.llm.pairs import defective_pairs
from folioforge.llm.scans import page_noise, repair_pages
from folioforge.llm.shapes import stuffed_pages
from folioforge.llm.splitting import split_oversized
from folioforge.llm.unify import lookalike_values
from folioforge.llm.vectors import similar_vectors, undirected
from folioforge.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of one collection, cosine at least 0.80, one among the other's 10 most similar."""
    return undirected(similar_vectors(table(spark, sf_dir, "document_chunks"), "id", "collection_id", "embedding", dim=96, k=10, min_similarity=0.80))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar chunks, whatever their similarity, of every hundredth chunk (by the number that its id ends in), against all."""
    chunks = table(spark, sf_dir, "document_chunks")
    asked = F.conv(F.right("id", F.lit(8)), 16, 10).cast("bigint") % 100 == 0
    lists = similar_vectors(chunks, "id", "collection_id", "embedding", dim=96, k=10, asked=asked)
    return lists.select(F.col("id").alias("chunk_id"), "neighbour_id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _near_duplicate_chunks(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return near_duplicates(table(spark, sf_dir, "document_chunks"), "id", "chunk_text", "document_id", words=3, min_similarity=0.5, min_words=20, whole=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of different documents whose sets of three consecutive words have a similarity of 0.5 or more."""
    return _near_duplicate_chunks(spark, sf_dir).pairs(other_owner=True).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its class of equal texts, its group of similar ones and its class's number of links."""
    return _near_duplicate_chunks(spark, sf_dir).groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair of a question and an answer, with its defect."""
    return defective_pairs(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "results")).where("defect is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of noise from scanning in each chunk."""
    return page_noise(table(spark, sf_dir, "document_chunks"), "id", "document_id", "chunk_index", "chunk_text").withColumnRenamed("id", "chunk_id")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy chunks as continuous, readable paragraphs."""
    return repair_pages(table(spark, sf_dir, "document_chunks"), "id", "document_id", "chunk_index", "chunk_text").withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong language label, and chunks in another language than their document."""
    docs = table(spark, sf_dir, "documents")
    field = train_on(docs, "doc_id", "text")
    return wrong_labels(docs, table(spark, sf_dir, "document_chunks"), field, p10_found(spark, sf_dir)).drop("confidence")


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language with its confidence, and its parts if it mixes languages."""
    docs = table(spark, sf_dir, "documents")
    return label_languages(docs, "doc_id", "text", train_on(docs, "doc_id", "text"), parts=True).withColumnRenamed("id", "doc_id")


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk texts and file names that look like others but differ in characters, in their one form."""
    chunks = lookalike_values(table(spark, sf_dir, "document_chunks"), "id", "chunk_text", "chunk_text")
    return chunks.unionByName(lookalike_values(table(spark, sf_dir, "documents"), "id", "original_filename", "original_filename"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with any compatibility form, uncomposed mark, invisible character, unusual blank or foreign letter."""
    return p6_unified(spark, sf_dir).select("field", "record_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk that is longer than its limit."""
    pieces = split_oversized(table(spark, sf_dir, "document_chunks"), "id", "chunk_text", "chunk_metadata")
    return pieces.withColumnRenamed("id", "chunk_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with more characters than the limit in their metadata: those that the operator cuts."""
    return p7_pieces(spark, sf_dir).where("piece_no = 1").select("chunk_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids by byte_bpe_50k, without special tokens."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_ids(spark, docs.text).alias("ids"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces, measured in tokens of byte_bpe_50k, with the container of 2,048 that each goes into."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", token_count(spark, docs.text).alias("n_tokens"))
    return pack(sized, "doc_id", "n_tokens", 2048).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at least half of whose characters are keywords, links, trails, tags or product lines."""
    return stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p5_languages": p5_languages, "p6_unified": p6_unified, "p6_found": p6_found, "p7_pieces": p7_pieces, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found}
#: Brute force in SQL, for the queries that it can express.
ORACLE: dict[str, str] = {
    "p1_found": """WITH c AS (SELECT DISTINCT id, collection_id, embedding::DOUBLE[] AS v FROM document_chunks WHERE len(embedding) = 96 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM c a JOIN c b ON a.collection_id = b.collection_id AND a.id <> b.id),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE k <= 10 AND s >= 0.80""",
    "p1_neighbours": """WITH c AS (SELECT DISTINCT id, collection_id, embedding::DOUBLE[] AS v FROM document_chunks WHERE len(embedding) = 96 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM c a JOIN c b ON a.collection_id = b.collection_id AND a.id <> b.id WHERE ('0x' || right(a.id, 8))::BIGINT % 100 = 0),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s)
SELECT a AS chunk_id, b AS neighbour_id, CAST(k AS BIGINT) AS rank, round(s, 6) AS similarity FROM r WHERE k <= 10""",
    "p2_found": """WITH c AS (SELECT DISTINCT id, document_id, chunk_text FROM document_chunks), w AS (SELECT id, document_id, regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{Nd}\\p{Nl}\\p{No}]+') AS w FROM c),
s AS (SELECT DISTINCT id, document_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.id < b.id AND a.document_id <> b.document_id GROUP BY 1, 2)
SELECT p.a AS chunk_id_a, p.b AS chunk_id_b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE m >= 0.5 * (x.n + y.n - m)""",
    "p7_found": """WITH c AS (SELECT DISTINCT id, chunk_text, CASE WHEN json_valid(chunk_metadata) THEN chunk_metadata::JSON END AS m FROM document_chunks),
l AS (SELECT id, chunk_text, coalesce(TRY_CAST(json_extract_string(m, '$.chunk_size') AS DOUBLE), TRY_CAST(json_extract_string(m, '$.splitter.chunk_size') AS DOUBLE), 500) AS size FROM c)
SELECT DISTINCT id AS chunk_id FROM l WHERE length(chunk_text) > size""",
}
