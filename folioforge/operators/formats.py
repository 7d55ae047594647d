"""Output formats of parsed answers, as column expressions over JSON strings."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import strict_fence, strip

FORMATS = ("json", "markdown", "essay", "list", "table")
EXTENSIONS = {"json": "json", "markdown": "md", "essay": "md", "list": "md", "table": "csv"}


def as_markdown(data: Column) -> Column:
    """``content``, or nothing."""
    return F.coalesce(F.get_json_object(data, "$.content"), F.lit(""))


def as_list(data: Column) -> Column:
    """``response`` as dashed lines; a value that is no list as itself."""
    items = F.from_json(F.get_json_object(data, "$.response"), "array<string>")
    whole = F.coalesce(F.get_json_object(data, "$.response"), F.lit(""))
    return F.when(whole.startswith("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("")))), "\n")).otherwise(whole)


def as_essay(data: Column) -> Column:
    """A title and sections with their headings, as Markdown."""
    parsed = F.from_json(data, "title string, sections array<struct<heading string, content string>>")
    title = F.concat(F.lit("# "), F.coalesce(parsed.title, F.lit("Untitled Essay")), F.lit("\n\n"))
    sections = F.transform(F.coalesce(parsed.sections, F.array()), lambda s: F.concat(F.lit("## "), F.coalesce(s.heading, F.lit("Introduction")), F.lit("\n"), F.coalesce(s.content, F.lit("")), F.lit("\n\n")))
    return strip(F.concat(title, F.array_join(sections, "")))


def _quoted(cell: Column) -> Column:
    text = F.coalesce(cell, F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def as_csv(data: Column) -> Column:
    """Headers and rows as CSV: CRLF, quotes only where needed."""
    parsed = F.from_json(data, "headers array<string>, rows array<array<string>>")
    lines = F.concat(F.when(F.size(parsed.headers) > 0, F.array(parsed.headers)).otherwise(F.array().cast("array<array<string>>")), F.coalesce(parsed.rows, F.array().cast("array<array<string>>")))
    return F.array_join(F.transform(lines, lambda row: F.concat(F.array_join(F.transform(row, _quoted), ","), F.lit("\r\n"))), "")


def as_records(data: Column) -> Column:
    """Rows as JSON objects by header; what a row has beyond the headers, or lacks, is left out."""
    parsed = F.from_json(data, "headers array<string>, rows array<array<string>>")

    def record(row: Column) -> Column:
        n = F.least(F.size(parsed.headers), F.size(row))
        return F.map_from_arrays(F.slice(parsed.headers, F.lit(1), n), F.slice(row, F.lit(1), n))

    return F.to_json(F.transform(parsed.rows, record))


def as_json(text: Column) -> Column:
    """The fenced JSON of an answer, indented by four; what isn't JSON stays as it is."""

    def indent(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else json.dumps(json.loads(v), indent=4, ensure_ascii=False))
            except ValueError:
                out.append(v)
        return pa.array(out, pa.string())

    return F.arrow_udf(indent, "string")(strict_fence(text))


def formatter(name: str):
    """The format of that name, in any case."""
    known = {"json": as_json, "markdown": as_markdown, "essay": as_essay, "list": as_list, "table": as_csv}
    if name.lower() not in known:
        raise ValueError(f"there is no format {name!r}; there are {', '.join(FORMATS)}")
    return known[name.lower()]


def result_markdown(data: Column, opening: int = 22, closing: int = 21) -> Column:
    """The document of a single-file result: out of its fence and JSON, without its opening and closing marks."""
    content = F.get_json_object(data, "$.content")
    inner = F.when(content.startswith("```json"), F.substring(content, F.lit(8), F.length(content) - 11)).otherwise(content)
    text = F.get_json_object(inner, "$.document")
    return F.coalesce(F.substring(text, F.lit(opening + 1), F.greatest(F.length(text) - opening - closing, F.lit(0))), F.lit(""))
