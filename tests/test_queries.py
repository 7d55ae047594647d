import pytest

import folioforge.plans.store_queries  # noqa: F401  (registers its queries)
from folioforge.plans.queries import ORACLE, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_formats_of_whole_texts(spark, tmp_path):
    """What lies beyond the first characters of a text reaches the formatters."""
    text = "plain words " * 20 + 'then a "quoted" one,\r\na line and the end'
    spark.createDataFrame([(1, "a.txt", '{"title": "T"}', "S", text), (2, None, None, None, None)], "doc_id bigint, original_filename string, document_metadata string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    csv = {r.doc_id: r.csv for r in QUERIES["format_table_csv"](spark, str(tmp_path)).collect()}
    assert csv == {1: 'file,title,text\r\na.txt,T,"' + text.replace('"', '""') + '"\r\n', 2: "file,title,text\r\n,,\r\n"}
    essay = {r.doc_id: r.essay for r in QUERIES["format_essay"](spark, str(tmp_path)).collect()}
    assert essay == {1: f"# T\n\n## S\n{text}", 2: "# Untitled Essay\n\n## Introduction"}


def test_best_match_among_queries(spark, tmp_path):
    """The nearest other row may be another query's, and a query's copies may precede it."""
    vectors = [(0, [0.0, 0.0]), (100, [0.0, 1.0]), (7, [0.0, 9.0]), (200, [5.0, 5.0]), (150, [5.0, 5.0]), (120, [5.0, 5.0])]
    spark.createDataFrame([(i, 0, v) for i, v in vectors], "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(100, "b.pdf")], "doc_id bigint, original_filename string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query_id, r.chunk_id, r.filename, r.distance) for r in QUERIES["citation_best_match_all"](spark, str(tmp_path)).collect()}
    assert got == {(0, 100, "b.pdf", 1.0), (100, 0, None, 1.0), (200, 120, None, 0.0)}
