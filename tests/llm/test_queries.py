import pytest

from folioforge.llm.queries import ORACLE, QUERIES
from tests.oracle import check

COLUMNS = {
    "p1_found": {"chunk_id_a", "chunk_id_b"},
    "p2_found": {"chunk_id_a", "chunk_id_b"},
    "p3_found": {"job_id", "answer_no", "defect"},
    "p4_found": {"chunk_id", "noise"},
    "p5_found": {"doc_id", "kind", "chunk_index", "language"},
    "p6_found": {"field", "record_id"},
    "p7_found": {"chunk_id"},
    "p8_ids": {"doc_id", "ids"},
    "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_and_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    rows = df.collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
