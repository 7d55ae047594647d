"""Files as rows: folder scans, readers by MIME type, and element rows of documents.

Readers are functions of a file's bytes that give element texts with metadata, and metadata of the file. Text,
Markdown, HTML, EPUB, PDF with a text layer and MOBI are read; an OCR engine is a seam to be registered.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import base_name, extension, sniff_mime
from folioforge.sources.html import html_to_text
from folioforge.sources.mobi import read_mobi
from folioforge.sources.pdf import read_pdf

#: A reader gives ([(text, metadata)], file metadata).
Reader = Callable[[bytes], tuple[list[tuple[str, dict[str, str]]], dict[str, Any]]]
#: Extensions that a folder scan takes.
DEFAULT_EXTENSIONS = ("pdf", "txt", "md", "docx", "epub", "mobi")
MAX_FILES = 999
ELEMENT_SCHEMA = "path string, element_index bigint, kind string, text string, metadata map<string,string>, file_metadata string, error string"


def scan_folder(spark: SparkSession, path: str, recursive: bool = False, extensions: tuple[str, ...] | None = DEFAULT_EXTENSIONS, max_files: int | None = MAX_FILES, content: bool = True) -> DataFrame:
    """``path, name, size, modified, content`` of a folder's files with the extensions, in the order of paths, at most max_files.

    None for either takes all files, as a batch does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = files.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    if extensions is not None:
        rows = rows.where(extension(F.col("name")).isin(*[e.lower() for e in extensions]))
    return rows.orderBy("path").limit(max_files) if max_files is not None else rows


def read_text(content: bytes) -> tuple[list[tuple[str, dict[str, str]]], dict[str, Any]]:
    """The whole file as one element."""
    return [(content.decode("utf-8"), {})], {}


def read_html(content: bytes) -> tuple[list[tuple[str, dict[str, str]]], dict[str, Any]]:
    return [(html_to_text(content.decode("utf-8")) or "", {})], {}


def read_epub(content: bytes) -> tuple[list[tuple[str, dict[str, str]]], dict[str, Any]]:
    """One element for each document in reading order that isn't blank, with its name as chapter; Dublin Core metadata."""
    book = zipfile.ZipFile(io.BytesIO(content))
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    root_file = next(x.attrib["full-path"] for x in container.iter() if x.tag.endswith("rootfile"))
    package = ElementTree.fromstring(book.read(root_file))
    folder = root_file.rpartition("/")[0]
    found: dict[str, list[str]] = {}
    items: dict[str, tuple[str, str]] = {}
    order: list[str] = []
    for x in package.iter():
        space, _, name = x.tag.rpartition("}")
        if "purl.org/dc/elements" in space and x.text:
            found.setdefault(name, []).append(x.text)
        elif name == "item":
            items[x.attrib["id"]] = (x.attrib["href"], x.attrib.get("media-type", ""))
        elif name == "itemref":
            order.append(x.attrib["idref"])
    elements = []
    for key in order or items:
        href, kind = items.get(key, ("", ""))
        if "html" in kind:
            text = html_to_text(book.read(f"{folder}/{href}" if folder else href).decode("utf-8")) or ""
            if text.strip():
                elements.append((text, {"chapter": href}))
    single = {k: found[k][0] for k in ("title", "publisher", "date", "language", "identifier") if found.get(k)}
    return elements, {**single, **({"creators": found["creator"]} if found.get("creator") else {})}


def missing(what: str) -> Reader:
    """A seam without an engine: says so for every file."""

    def read(_: bytes) -> tuple[list[tuple[str, dict[str, str]]], dict[str, Any]]:
        raise NotImplementedError(f"no engine is registered to read {what}; pass one in readers")

    return read


READERS: dict[str, Reader] = {
    "text/plain": read_text,
    "text/markdown": read_text,
    "text/html": read_html,
    "application/epub+zip": read_epub,
    "application/pdf": read_pdf,
    "application/x-mobipocket-ebook": read_mobi,
    "image/*": missing("images (OCR)"),
}


def _read(readers: Mapping[str, Reader]):
    import json

    schema = pa.schema([("path", pa.string()), ("element_index", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("file_metadata", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict[str, Any]] = []
            for path, mime, content in zip(b.column("path").to_pylist(), b.column("mime").to_pylist(), b.column("content").to_pylist(), strict=True):
                reader = readers.get(mime) or readers.get(f"{(mime or '').split('/')[0]}/*")
                empty = {"path": path, "element_index": None, "kind": None, "text": None, "metadata": None, "file_metadata": None, "error": None}
                try:
                    if reader is None:
                        raise ValueError(f"files of type {mime} aren't read")
                    elements, meta = reader(content)
                    rows += [{**empty, "element_index": i, "kind": "text", "text": t, "metadata": list(m.items()), "file_metadata": json.dumps(meta)} for i, (t, m) in enumerate(elements)]
                    if not elements:
                        rows.append({**empty, "file_metadata": json.dumps(meta)})
                except Exception as e:
                    rows.append({**empty, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_elements(files: DataFrame, readers: Mapping[str, Reader] | None = None, mime_col: str | None = None) -> DataFrame:
    """Element rows of files with path and content; a file that can't be read gives a row with its error.

    The reader goes by the content, unless ``mime_col`` names its type; Markdown and HTML are told by their extension.
    """
    by_name = F.when(extension(F.col("path")) == "md", "text/markdown").when(extension(F.col("path")).isin("html", "htm", "xhtml"), "text/html")
    sniffed = sniff_mime(F.col("content"))
    mime = F.col(mime_col) if mime_col else F.when(sniffed == "text/plain", F.coalesce(by_name, sniffed)).otherwise(sniffed)
    return files.select("path", mime.alias("mime"), "content").mapInArrow(_read({**READERS, **(readers or {})}), ELEMENT_SCHEMA)


def prompt_components(spark: SparkSession, folder: str) -> dict[str, str]:
    """A task's components by the stem of their Markdown files; a folder without any is an error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select(F.regexp_replace(base_name(F.col("path")), r"\.md$", "").alias("name"), F.decode("content", "UTF-8").alias("text")).collect()
    if not rows:
        raise FileNotFoundError(f"{folder} holds no prompt components")
    return {r["name"]: r["text"] for r in rows}
