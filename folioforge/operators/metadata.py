"""Document metadata: keys of file properties, merging with what a model extracted, and manual updates."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import split_authors, strip

#: The canonical keys.
CANONICAL = ("title", "authors", "publication_date", "publisher", "doi", "source_url", "language", "document_type", "keywords", "abstract", "harvard_citation")
#: File properties and the canonical keys they stand for; a later entry outdoes an earlier one.
FILE_KEYS = [
    ("Title", "title"),
    ("/Title", "title"),
    ("title", "title"),
    ("Subject", "abstract"),
    ("/Subject", "abstract"),
    ("Author", "authors"),
    ("/Author", "authors"),
    ("authors", "authors"),
    ("publisher", "publisher"),
    ("publication_date", "publication_date"),
    ("language", "language"),
    ("identifier", "doi"),
]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it appears."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_map(json: Column) -> Column:
    """A JSON object's values as strings (nested ones as JSON); an empty map for null and what is no object."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def overlay(below: Column, above: Column) -> Column:
    """Both maps' entries; where both have a key, that of ``above``."""
    return _let(above, lambda a: F.map_concat(F.map_filter(below, lambda k, _: ~F.array_contains(F.map_keys(a), k)), a))


def filled(values: Column) -> Column:
    """The canonical entries that are not null, empty or an empty list."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & ~v.isin("", "[]") & k.isin(*CANONICAL))


def _names(value: Column) -> Column:
    """Authors as a JSON list: of a JSON list its stripped items, else the names between semicolons and commas."""
    listed = F.from_json(value, "array<string>")
    names = F.when(value.startswith("[") & listed.isNotNull(), F.filter(F.transform(listed, strip), lambda x: x != "")).otherwise(split_authors(value))
    return F.to_json(names)


def map_file_keys(properties: Column) -> Column:
    """File properties by canonical key, stripped; blank and unknown ones are left out; authors are a JSON list.

    Of several properties for one key the last in FILE_KEYS that isn't blank counts.
    """
    entries = []
    for key in dict.fromkeys(target for _, target in FILE_KEYS):
        values = [strip(F.element_at(properties, source)) for source, target in reversed(FILE_KEYS) if target == key]
        found = F.coalesce(*[F.when(~v.isin("", "[]"), v) for v in values])
        entries.append(F.struct(F.lit(key).alias("key"), (_let(found, _names) if key == "authors" else found).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.value.isNotNull()))


def merge(file: Column, extracted: Column, raw: Column) -> Column:
    """File properties under what a model extracted, canonical and filled only, with where it came from.

    Provenance is added if any entry remains; the raw properties if there are any.
    """
    marks = F.create_map(F.lit("llm_extracted"), F.lit("true"), F.lit("extraction_method"), F.lit("llm_analysis"))
    origin = F.when(F.size(file) > 0, F.create_map(F.lit("_raw_file_metadata"), raw)).otherwise(F.create_map().cast("map<string,string>"))
    both = filled(overlay(map_file_keys(file), filled(extracted)))
    return _let(both, lambda m: F.map_concat(F.when(F.size(m) > 0, F.map_concat(m, marks)).otherwise(m), origin))


def update_manually(current: Column, update: Mapping[str, Column | str | None]) -> Column:
    """The current map with the set fields, which are listed; nulls aren't set; an empty update changes nothing."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in update.items() if v is not None}
    if not given:
        return current
    changes = F.map_filter(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    listed = F.array_join(F.array_sort(F.map_keys(changes)), ",")
    marked = F.map_concat(changes, F.create_map(F.lit("manually_updated"), F.lit("true"), F.lit("manual_update_fields"), listed))
    return F.when(F.size(changes) > 0, overlay(current, marked)).otherwise(current)


def update_bulk(documents: DataFrame, updates: DataFrame, id_col: str = "id", value_col: str = "document_metadata") -> DataFrame:
    """Documents with manual updates of ``updates`` (id, fields: a map) laid over their metadata, as JSON.

    Of several updates of one document the fields come together (of equal ones the greatest value); documents without
    an update, and with one of nulls only, stay as they are.
    """
    fields = updates.select(F.col(id_col), F.explode(F.map_filter("fields", lambda _, v: v.isNotNull())).alias("k", "v")).groupBy(id_col, "k").agg(F.max("v").alias("v"))
    given = fields.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("_set"))
    marks = F.create_map(F.lit("manually_updated"), F.lit("true"), F.lit("manual_update_fields"), F.array_join(F.array_sort(F.map_keys("_set")), ","))
    changed = F.to_json(overlay(as_map(F.col(value_col)), F.map_concat(F.col("_set"), marks)))
    return documents.join(given, id_col, "left").withColumn(value_col, F.when(F.col("_set").isNotNull(), changed).otherwise(F.col(value_col))).drop("_set")


def replace(documents: DataFrame, updates: DataFrame, id_col: str = "id", value_col: str = "document_metadata") -> DataFrame:
    """Documents with the values of ``updates`` (id, value) in place of theirs."""
    new = updates.select(F.col(id_col), F.col(value_col).alias("_new"), F.lit(True).alias("_given"))
    out = documents.join(new, id_col, "left")
    return out.withColumn(value_col, F.when(F.col("_given"), F.col("_new")).otherwise(F.col(value_col))).drop("_new", "_given")


def display(values: Column) -> Column:
    """Shown entries as ``Key Words: value``, sorted, without private keys; a list's items with commas."""
    shown = F.map_filter(values, lambda k, v: ~k.startswith("_") & v.isNotNull())
    items = F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(F.initcap(F.replace(e.key, F.lit("_"), F.lit(" "))), F.lit(": "), F.when(e.value.startswith("["), F.array_join(F.from_json(e.value, "array<string>"), ", ")).otherwise(e.value)))
    return F.array_join(items, "\n")
