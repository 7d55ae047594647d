"""Pages and elements: triage, document types, choice between engines, and rendering of structured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import WHITE_CHARACTERS, strip

#: Thresholds of triage, of the share of text pages, and of a valid result.
TEXT_THRESHOLD = 100
SAMPLED_PAGES = 3
TEXT_SHARE, MIXED_SHARE = 0.8, 0.2
VALID_CHARACTERS = 50
NO_TEXT = "[OCR completed, but no text was found.]"
LAYOUT_SCHEMA = (
    "pages array<struct<text_blocks array<struct<text string, bbox map<string,double>, confidence double, `order` int>>, "
    "tables array<struct<headers array<string>, rows array<array<string>>, bbox map<string,double>, confidence double>>, "
    "images array<struct<description string, bbox map<string,double>, extracted_path string, type string>>>>, overall_confidence double"
)


def triage(pages: DataFrame, document: str = "document_id", page: str = "page", text: str = "text") -> DataFrame:
    """``document_id, reader``: text if the first pages hold more than 100 characters, else ocr."""
    first = pages.where(F.col(page) < SAMPLED_PAGES)
    return first.groupBy(document).agg(F.when(F.sum(F.coalesce(F.length(text), F.lit(0))) > TEXT_THRESHOLD, "text").otherwise("ocr").alias("reader"))


def document_types(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``document_id, document_type`` by extension, and for PDFs by the share of the first pages that hold text.

    A PDF without pages counts as scanned.
    """
    full = F.when(F.length(strip(F.coalesce("text", F.lit("")))) > TEXT_THRESHOLD, 1.0).otherwise(0.0)
    share = pages.where(F.col("page") < SAMPLED_PAGES).groupBy("document_id").agg(F.avg(full).alias("share"))
    pdf = F.when(F.col("share") > TEXT_SHARE, "text_pdf").when(F.col("share") > MIXED_SHARE, "mixed_pdf").otherwise("scanned_pdf")
    kind = F.when(F.col("extension") == "pdf", pdf).when(F.col("extension").isin("epub", "mobi"), F.col("extension")).otherwise("image")
    return documents.join(share, "document_id", "left").select("document_id", kind.alias("document_type"))


def valid_results(elements: DataFrame, by: list[str]) -> DataFrame:
    """``by..., valid``: whether there are text elements, and their text joined by spaces has 50 characters or more."""
    is_text = F.col("kind") == "text"
    length = F.sum(F.when(is_text, F.length("text"))) + F.count_if(is_text) - 1
    # Stripping the joined text only takes from its two ends.
    lead = F.min(F.when(is_text & (strip(F.col("text")) != ""), F.struct("element_index", (F.length("text") - F.length(F.ltrim("text", F.lit(WHITE_CHARACTERS)))).alias("n"))))
    trail = F.max(F.when(is_text & (strip(F.col("text")) != ""), F.struct("element_index", (F.length("text") - F.length(F.rtrim("text", F.lit(WHITE_CHARACTERS)))).alias("n"))))
    return elements.groupBy(*by).agg((F.coalesce(length - lead.n - trail.n, F.lit(0)) >= VALID_CHARACTERS).alias("valid"))


def choose_engine(results: DataFrame) -> DataFrame:
    """The valid result with the least priority of each document (document_id, engine, priority, valid); none gives no row."""
    return results.where("valid").groupBy("document_id").agg(F.min(F.struct("priority", "engine")).alias("x")).select("document_id", "x.engine", "x.priority")


def group_pages(elements: DataFrame) -> DataFrame:
    """``document_id, page, text_blocks, tables, images``: each page's elements by kind, in order; no page counts as 0."""

    def of(kind: str, value: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("element_index", value))))
        return F.transform(rows, lambda x: x[value])

    page = F.coalesce("page", F.lit(0)).alias("page")
    return elements.groupBy("document_id", page).agg(of("text", "text").alias("text_blocks"), of("table", "text").alias("tables"), of("image", "text").alias("images"))


def flatten(elements: DataFrame) -> DataFrame:
    """``document_id, text``: text elements with blank lines between, then each table with its headers and a rule."""
    header = F.array_join("headers", " | ")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")
    table = F.when(F.size("headers") > 0, F.concat(F.lit("\n\nTable:\n"), header, F.lit("\n"), F.expr("repeat('-', length(array_join(headers, ' | ')))"), F.lit("\n"), rows))

    def ordered(kind: str, value: Column, separator: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & value.isNotNull(), F.struct("element_index", value.alias("v"))))), lambda x: x.v), separator)

    return elements.groupBy("document_id").agg(F.concat(ordered("text", F.col("text"), "\n\n"), ordered("table", table, "")).alias("text"))


def parse_layout(responses: DataFrame, id_col: str = "document_id", json_col: str = "response") -> DataFrame:
    """A layout service's answers as element rows: document_id, page, kind, element_index, text, headers, rows, confidence."""
    parsed = responses.select(F.col(id_col).alias("document_id"), F.from_json(json_col, LAYOUT_SCHEMA).alias("r"))
    pages = parsed.select("document_id", F.posexplode("r.pages").alias("page", "p"))
    none = [F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows")]
    sure = lambda c: F.coalesce(c, F.lit(1.0)).alias("confidence")
    text = pages.select("document_id", "page", F.posexplode("p.text_blocks").alias("i", "x")).select("document_id", "page", F.lit("text").alias("kind"), "i", F.col("x.text").alias("text"), *none, sure(F.col("x.confidence")))
    tables = pages.select("document_id", "page", F.posexplode("p.tables").alias("i", "x")).select("document_id", "page", F.lit("table").alias("kind"), "i", F.lit(None).cast("string").alias("text"), "x.headers", "x.rows", sure(F.col("x.confidence")))
    images = pages.select("document_id", "page", F.posexplode("p.images").alias("i", "x")).select("document_id", "page", F.lit("image").alias("kind"), "i", F.col("x.description").alias("text"), *none, F.lit(1.0).alias("confidence"))
    order = F.col("page") * 1_000_000 + F.when(F.col("kind") == "text", 0).when(F.col("kind") == "table", 300_000).otherwise(600_000) + F.col("i")
    return text.unionByName(tables).unionByName(images).withColumn("element_index", order).drop("i")


def or_placeholder(text: Column) -> Column:
    """What OCR gave, or the placeholder for nothing."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_TEXT))
