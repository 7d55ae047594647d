"""What the plans must look like at any scale."""

import re

import pytest

from folioforge.plans.queries import QUERIES


def plan(spark, sf, name):
    df = QUERIES[name](spark, sf)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_knn_reaches_the_scan(spark, sf):
    p = plan(spark, sf, "knn_collection_top5")
    assert "TakeOrderedAndProject" in p and re.search(r"PushedFilters: \[[^\]]*EqualTo\(label,2\)", p)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["content_hash", "mime_guess", "clean_text", "fixed_chunks", "analysis_prompt", "llm_echo_cost", "metadata_merge", "format_table_csv", "author_split"])
def test_row_functions_do_not_shuffle(spark, sf, name):
    p = plan(spark, sf, name)
    assert "Exchange" not in p and "Python" not in p and "Arrow" not in p


@pytest.mark.parametrize(("name", "columns"), [("content_hash", {"doc_id", "content_hash", "text"}), ("mime_guess", {"doc_id", "original_filename", "mime_type"}), ("list_collections", {"id", "name"}), ("pdf_triage", {"id", "document_id", "chunk_index", "chunk_text"}), ("job_status_latest", {"id", "job_type", "status", "created_at", "updated_at"})])
def test_scans_read_only_what_is_used(spark, sf, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", plan(spark, sf, name))
    assert schemas
    for s in schemas:
        assert {c.split(":")[0] for c in re.split(r",(?=\w+:)", s)} <= columns


@pytest.mark.parametrize("name", ["knn_batched_top5", "citation_best_match"])
def test_ranks_are_cut_before_the_shuffle(spark, sf, name):
    p = plan(spark, sf, name)
    assert "WindowGroupLimit" in p and "Cartesian" not in p and "NestedLoop" not in p


@pytest.mark.parametrize("name", ["ingest_summary", "dedup_accepted", "collection_detail_counts", "job_status_latest", "hash_embedding"])
def test_groups_are_aggregated_before_the_shuffle(spark, sf, name):
    p = plan(spark, sf, name)
    assert "partial_" in p and " Window" not in p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"job_stream_available_now"}))
def test_no_cross_joins(spark, sf, name):
    p = plan(spark, sf, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
