"""Pipelines: indexing of documents, and questions and analyses over what is found."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.embedding import embed, hash_vectors
from folioforge.functions.text import fenced_json, json_object, stem
from folioforge.operators import metadata
from folioforge.operators.chunking import concatenate, explode_chunks, recursive_chunks
from folioforge.operators.formats import EXTENSIONS, formatter
from folioforge.operators.models import echo, echo_responses
from folioforge.operators.prompts import CONTEXT_SEPARATOR, compose, question_prompt
from folioforge.operators.search import batched_top_k, search_scope
from folioforge.session import materialize

#: Messages when nothing is found.
NO_DOCUMENTS = "No relevant documents found."
NO_CHUNKS = "No relevant chunks found in the document."


def index(documents: DataFrame, id_col: str = "id", text_col: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """Chunks of documents with their vectors: document_id, collection_id, chunk_index, chunk_text, chunk_id, embedding.

    Ids are derived from document and position, so that indexing again gives the same rows.
    """
    docs = documents.select(F.col(id_col).alias("document_id"), "collection_id", F.col(text_col).alias("text")).where("text is not null")
    chunks = explode_chunks(docs, recursive_chunks(F.col("text"), size, overlap), "document_id", "collection_id")
    return _with_vectors(chunks)


def index_with_metadata(documents: DataFrame, components: Mapping[str, str], max_length: int, respond: Callable[[Column], Column] = echo, id_col: str = "id", text_col: str = "text", size: int = 500, overlap: int = 100) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors as of index(), and the documents with the metadata that a model found in their first chunks.

    What a document has as ``document_metadata`` are its file properties; a model's answer without a JSON object
    leaves them.
    """
    docs = documents.select(F.col(id_col).alias("document_id"), "collection_id", F.col(text_col).alias("text")).where("text is not null")
    chunks = materialize(explode_chunks(docs, recursive_chunks(F.col("text"), size, overlap), "document_id", "collection_id"), "chunks")
    properties = documents.select(F.col(id_col).alias("document_id"), metadata.as_map(F.col("document_metadata")).alias("properties"))
    found = extract_metadata(chunks, properties, components, max_length, respond).select(F.col("document_id").alias(id_col), F.to_json("metadata").alias("document_metadata"))
    return _with_vectors(chunks), metadata.replace(documents, found, id_col)


def _with_vectors(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("/", "document_id", F.col("chunk_index").cast("string")), 256)).withColumn("embedding", embed(F.col("chunk_text")))


def zip_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (document_id, chunk_index) with the vectors of the same positions; what one side lacks is left out."""
    return chunks.join(vectors.select("document_id", "chunk_index", "embedding"), ["document_id", "chunk_index"])


def question_vector(question: str, model: Callable[[list[str | None]], list[list[float]]] = hash_vectors) -> list[float]:
    return model([question])[0]


def find(question: str, chunks: DataFrame, documents: DataFrame, scope_col: str, scope: object, id_col: str, k: int = 5, model: Callable[[list[str | None]], list[list[float]]] = hash_vectors) -> DataFrame:
    """The hits of a question in a collection or document, with query_id 0 and rank."""
    hits = search_scope(chunks, documents, question_vector(question, model), scope_col, scope, id_col, k)
    rank = F.row_number().over(Window.orderBy("distance", id_col))  # of k rows
    return hits.withColumn("rank", rank).withColumns({"query_id": F.lit(0), "question": F.lit(question)})


def ask(question: str, hits: DataFrame, strategy: str, nothing: str = NO_DOCUMENTS) -> DataFrame:
    """A question's result over its hits: ``query_id, data``; the fixed message if there are none."""
    asked = hits.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(question).alias("question"))
    return answer(asked, hits, strategy, nothing)


def analyse(hits: DataFrame, components: Mapping[str, str], strategy: str, max_length: int, respond: Callable[[Column], Column] = echo) -> DataFrame:
    """Answers of an analysis over its hits: one each for ``separate`` (with its rank), else one over all of them."""
    prompts = analyse_hits(hits, components, strategy, max_length)
    return prompts.select("query_id", *(["rank"] if strategy == "separate" else []), respond(F.col("prompt")).alias("content"))


def contradicting(claims: DataFrame, chunks: DataFrame, id_col: str, k: int = 5, negate: Callable[[Column], Column] | None = None) -> DataFrame:
    """The chunks nearest to the negation of each claim (claim_id, claim), which ``negate`` writes: a model's prompt and answer."""
    write = negate or (lambda c: F.concat(F.lit("It is not true that "), c))
    asked = materialize(claims.select(F.col("claim_id").alias(id_col), embed(write(F.col("claim"))).alias("embedding")), "negated")
    return batched_top_k(chunks, asked, id_col, "embedding", k).withColumnsRenamed({"query_id": "claim_id"})


def separate_prompts(hits: DataFrame) -> DataFrame:
    """A prompt for every hit (query_id, question, rank, chunk_text, ...)."""
    return hits.withColumn("prompt", question_prompt(F.col("question"), F.col("chunk_text")))


def merged_context(hits: DataFrame) -> DataFrame:
    """``query_id, text``: each question's hits in the order of rank."""
    return concatenate(hits, "query_id", "rank", "chunk_text", CONTEXT_SEPARATOR)


def merged_prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One prompt for each question with hits: query_id, question, prompt."""
    context = merged_context(hits).withColumnRenamed("text", "context")
    return questions.join(context, "query_id").withColumn("prompt", question_prompt(F.col("question"), F.col("context")))


def analysis_prompts(texts: DataFrame, components: Mapping[str, str], max_length: int, text_col: str = "text") -> DataFrame:
    """The task's prompt for every text."""
    return texts.withColumn("prompt", compose(components, {}, F.col(text_col), max_length))


def answer(questions: DataFrame, hits: DataFrame, strategy: str, nothing: str = NO_DOCUMENTS) -> DataFrame:
    """``query_id, data``: each question's result as JSON, by the offline model; without hits the fixed message.

    ``separate`` answers by hit with its source; any other strategy merges the hits (and lists their sources beside).
    """
    response = F.struct("content", "model", F.round("cost", 8).alias("cost"), F.struct("prompt_tokens", "completion_tokens").alias("metadata"))
    if strategy == "separate":
        answered = echo_responses(separate_prompts(hits)).withColumn("item", F.struct(F.struct("filename", "chunk_text", "document_metadata").alias("source"), response.alias("llm_response")))
        grouped = answered.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("results"))
        made = grouped.select("query_id", F.to_json(F.struct(F.lit("separate").alias("strategy"), "results")).alias("data"))
    else:
        answered = echo_responses(merged_prompts(hits, questions)).select("query_id", response.alias("result"))
        sources = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "filename"))), lambda x: x.filename).alias("sources"))
        made = answered.join(sources, "query_id").select("query_id", F.to_json(F.struct(F.lit("merge").alias("strategy"), "result", "sources")).alias("data"))
    empty = F.to_json(F.struct(F.lit(nothing).alias("content")))
    return questions.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("data", empty).alias("data"))


def search_text(components: Mapping[str, str]) -> str:
    """What an analysis searches by: its embedding reference, or else its question, which it must have."""
    if not components.get("question"):
        raise ValueError("the task has no component 'question'")
    return components.get("embedding_reference") or components["question"]


def analyse_hits(hits: DataFrame, components: Mapping[str, str], strategy: str, max_length: int) -> DataFrame:
    """Prompts of an analysis over hits: one each for ``separate``, else one for each query over all of its hits."""
    if strategy == "separate":
        return analysis_prompts(hits, components, max_length, "chunk_text")
    return analysis_prompts(merged_context(hits), components, max_length)


def analyse_files(elements: DataFrame, components: Mapping[str, str], output_format: str, max_length: int, respond: Callable[[Column], Column] = echo) -> DataFrame:
    """``path, name, output`` of whole files (path, element_index, text): prompt, answer, and its parsed content as formatted.

    Files without any text are left out; ``name`` is the file's with the format's extension.
    """
    texts = concatenate(elements.where("text is not null"), "path", "element_index", "text", "\n")
    answered = analysis_prompts(texts, components, max_length).withColumn("answer", respond(F.col("prompt")))
    shaped = F.col("answer") if output_format == "json" else json_object(fenced_json(F.col("answer")))
    name = F.concat(stem(F.col("path")), F.lit(f"_output.{EXTENSIONS[output_format]}"))
    return answered.select("path", name.alias("name"), formatter(output_format)(shaped).alias("output"))


def extract_metadata(chunks: DataFrame, documents: DataFrame, components: Mapping[str, str], max_length: int, respond: Callable[[Column], Column] = echo, first: int = 3) -> DataFrame:
    """``document_id, metadata``: file properties under what a model makes of a document's first chunks.

    ``documents`` has document_id and properties (a map). A document without chunks, and an answer that holds no JSON
    object, leave the file properties.
    """
    start = concatenate(chunks, "document_id", "chunk_index", "chunk_text", "\n\n", first)
    answers = analysis_prompts(start, components, max_length).select("document_id", json_object(fenced_json(respond(F.col("prompt")))).alias("answer"))
    joined = documents.join(answers, "document_id", "left")
    found = metadata.as_map(F.col("answer"))
    merged = metadata.merge(F.col("properties"), found, F.to_json("properties"))
    return joined.select("document_id", F.when(F.size(found) > 0, merged).otherwise(F.col("properties")).alias("metadata"))
