"""Scalar text functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.strip() and \\s take for white space.
WHITE_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one.
WHITE_CHARACTERS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Powers of 1,024 by unit.
UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}
#: MIME types by extension.
MIME_BY_EXTENSION = {
    "pdf": "application/pdf",
    "epub": "application/epub+zip",
    "mobi": "application/x-mobipocket-ebook",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "csv": "text/csv",
    "json": "application/json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "png": "image/png",
    "jpg": "image/jpeg",
}
OCTET_STREAM = "application/octet-stream"


def strip(text: Column) -> Column:
    """Without leading and trailing white space, of all kinds."""
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


def clean_text(text: Column) -> Column:
    """Runs of white space as one space, and none at the ends."""
    return F.regexp_replace(strip(text), rf"{WHITE_SPACE}+", " ")


def parse_file_size(text: Column) -> Column:
    """Bytes that a size such as ``1.5 KB`` stands for (units of 1,024), or null."""
    upper = F.upper(text)
    pattern = r"^(\d+(?:\.\d+)?)\s*([KMGT]?B)$"
    number = F.regexp_extract(upper, pattern, 1).try_cast("double")
    power = F.create_map(*[F.lit(x) for unit, p in UNITS.items() for x in (unit, float(1024**p))])
    return F.floor(number * F.element_at(power, F.regexp_extract(upper, pattern, 2))).cast("bigint")


def extension(name: Column) -> Column:
    """The lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def guess_mime(name: Column) -> Column:
    """The MIME type that a name's extension stands for."""
    known = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(name)), F.lit(OCTET_STREAM))


def sniff_mime(content: Column) -> Column:
    """The MIME type that binary content shows by its first bytes; text if it is UTF-8."""
    head = F.hex(F.substring(content, 1, 80))
    is_epub = head.startswith("504B0304") & F.substring(head, 1, 160).contains(F.hex(F.lit("application/epub+zip").cast("binary")))
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(is_epub, MIME_BY_EXTENSION["epub"])
        .when(head.startswith("504B0304"), "application/zip")
        .when(F.substring(head, 121, 16) == F.hex(F.lit("BOOKMOBI").cast("binary")), MIME_BY_EXTENSION["mobi"])
        .when(F.is_valid_utf8(content.cast("string")), "text/plain")
        .otherwise(OCTET_STREAM)
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its extension; names that only begin with a dot stay."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def stored_name(key: Column, original: Column) -> Column:
    """A name for storage: an id derived from the key, with the original extension."""
    digest = F.sha2(key.cast("string"), 256)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.concat_ws("-", *parts), F.regexp_extract(original, r"(\.[^./]*)$", 1))


def split_authors(text: Column) -> Column:
    """Names separated by semicolons or commas, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), strip), lambda x: x != "")


def split_list(text: Column) -> Column:
    """Values separated by commas, stripped; empty ones stay."""
    return F.transform(F.split(text, ","), strip)


def fenced_json(text: Column) -> Column:
    """What stands in the first json fence, else in the first fence, if it is closed; else the stripped text.

    Where a json fence opens, a plain one is not looked for.
    """
    body = strip(text)
    has = body.contains("```json")
    inner = F.when(has, F.regexp_extract(body, r"(?s)```json(.*?)```", 1)).otherwise(F.regexp_extract(body, r"(?s)```(.*?)```", 1))
    closed = F.when(has, body.rlike(r"(?s)```json.*?```")).otherwise(body.rlike(r"(?s)```.*?```"))
    return F.when(closed, strip(inner)).otherwise(body)


def strict_fence(text: Column) -> Column:
    """What stands between a json fence's line and a closing one's, else the text itself."""
    return F.when(text.rlike(r"(?s)```json\n.*?\n```"), F.regexp_extract(text, r"(?s)```json\n(.*?)\n```", 1)).otherwise(text)


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else an empty one."""
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.when(is_object, text).otherwise(F.lit("{}"))


def title_words(key: Column) -> Column:
    """``publication_date`` as ``Publication Date``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
