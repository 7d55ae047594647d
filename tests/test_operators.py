import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge import config
from folioforge.functions.embedding import embed, hash_vectors
from folioforge.functions.vectors import cosine, l2_distance, literal
from folioforge.operators import catalog, formats, ingest, jobs, layout, metadata, models, prompts, rates, search
from folioforge.plans import rag

T0 = dt.datetime(2026, 1, 1)


def test_dedup(spark):
    rows = [(3, "c", "AA", 5, T0), (1, "c", "aa", 5, T0), (2, "c", "aA", 5, T0), (4, "d", "aa", 5, T0), (5, "c", "bb", 99, T0), (6, "c", None, 5, T0), (7, "c", None, 5, T0)]
    df = spark.createDataFrame(rows, "doc_id bigint, collection_id string, content_hash string, file_size bigint, created_at timestamp")
    got = {r.doc_id: (r.reason, r.winner) for r in ingest.decide(df, 50).collect()}
    assert got == {1: ("accepted", None), 2: ("duplicate", 1), 3: ("duplicate", 1), 4: ("accepted", None), 5: ("too_large", None), 6: ("accepted", None), 7: ("accepted", None)}
    assert {r.doc_id for r in ingest.decide(df, 99).where("reason = 'too_large'").collect()} == set()
    assert ingest.decide(df.limit(0), 50).count() == 0


def test_knn_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    assert [r.id for r in search.top_k(df, [1.0, 0.0], "v", "id", 9).collect()] == [1, 3, 2, 4, 5]
    assert [r.id for r in search.top_k(df, [1.0, 0.0], "v", "id", 2).collect()] == [1, 3]
    got = search.batched_top_k(df, df.where("id in (1, 2)"), "id", "v", 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, round(r.distance, 6)) for r in got] == [(1, 1, 0.0), (1, 3, 0.0), (2, 2, 0.0), (2, 1, 1.414214)]
    assert search.batched_top_k(df, df.limit(0), "id", "v", 2).count() == 0
    x = df.select("id", l2_distance(F.col("v"), literal([1.0, 1.0])).alias("d"), cosine(F.col("v"), literal([0.0, 2.0])).alias("c")).orderBy("id").collect()
    assert [(r.d, r.c) for r in x] == [(1.0, 0.0), (1.0, 1.0), (1.0, 0.0), (None, None), (None, None)]


def test_prompts(spark):
    df = spark.createDataFrame([("a b c d",), ("",), (None,)], "text string")
    task = {"prompt": "Say: {{ document_text }} {{ missing }}!", "document_text": "ignored"}
    got = [r.p for r in df.select(prompts.compose(task, {}, F.col("text"), 4).alias("p")).collect()]
    assert got == ["Say: a b" + prompts.TRUNCATED + " !", "Say:  !", "Say:  !"]
    exact = df.select(prompts.compose(task, {}, F.col("text"), 6).alias("p")).first().p
    assert exact == "Say: a b c d !"
    negative = df.select(prompts.compose(task, {}, F.col("text"), 1).alias("p")).first().p
    assert negative == "Say: a b c" + prompts.TRUNCATED + " !"
    with pytest.raises(ValueError):
        prompts.compose({"question": "x"}, {}, F.col("text"), 5)
    assert prompts.validate_template("a {{ b }}") and not prompts.validate_template("a {{ b ")


def test_model_seam(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return {"content": prompt.upper(), "model": "m", "cost": 0.5}

    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "bad")], "id bigint, prompt string")
    now = F.lit("2026-01-01 01:00:00").cast("timestamp")
    out, new = models.generate(df, model, "m", as_of=now, partitions=2, attempts=1)
    assert {(r.id, r.content, r.cached) for r in out.collect()} == {(1, "X", False), (2, "X", False), (3, "Y", False), (4, None, False)}
    assert "no answer" in out.where("id = 4").first().error
    assert calls.value == 3
    again, later = models.generate(df.where("id < 4"), model, "m", cache=new, as_of=now, partitions=2, attempts=1)
    assert all(r.cached for r in again.collect()) and later.count() == 0 and calls.value == 3
    old = F.lit("2026-01-01 02:00:01").cast("timestamp")
    models.generate(df.where("id = 3"), model, "m", cache=new, as_of=old, partitions=2, attempts=1)
    assert calls.value == 4


def test_limiter_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = models.RateLimiter(2, 60, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        limiter.wait()
    assert slept == [60.0]
    answers = iter([{}, {"content": " ", "model": "m"}, {"content": "ok", "model": "m"}])
    assert models.with_retries(lambda p: next(answers), "p", sleep=lambda s: None)["content"] == "ok"
    with pytest.raises(ValueError):
        models.with_retries(lambda p: {}, "p", attempts=2, sleep=lambda s: None)


def merged(spark, file, extracted):
    df = spark.createDataFrame([(file, extracted)], "f map<string,string>, e map<string,string>")
    return df.select(metadata.merge(F.col("f"), F.col("e"), F.to_json("f")).alias("m")).first().m


def test_metadata(spark):
    assert merged(spark, {}, {}) == {}
    raw = merged(spark, {"Title": " T ", "/Author": "A"}, {})
    assert json.loads(raw.pop("_raw_file_metadata")) == {"Title": " T ", "/Author": "A"}
    assert raw == {"title": "T", "authors": '["A"]', "llm_extracted": "true", "extraction_method": "llm_analysis"}
    both = merged(spark, {"Title": "T"}, {"title": "L", "doi": "", "keywords": "[]", "unknown": "x"})
    assert both["title"] == "L" and "doi" not in both and "keywords" not in both and "unknown" not in both
    assert merged(spark, {"Producer": "P"}, {}) == {"_raw_file_metadata": '{"Producer":"P"}'}
    df = spark.createDataFrame([({"title": "A", "manual_update_fields": "x"},)], "m map<string,string>")
    got = df.select(metadata.update_manually(F.col("m"), {"doi": "D", "publisher": None}).alias("m")).first().m
    assert got == {"title": "A", "doi": "D", "manually_updated": "true", "manual_update_fields": "doi"}
    assert df.select(metadata.update_manually(F.col("m"), {}).alias("m")).first().m == {"title": "A", "manual_update_fields": "x"}
    shown = spark.createDataFrame([('{"key_words": ["a", "b"], "_x": 1, "title": "T"}',)], "j string").select(metadata.display(metadata.as_map(F.col("j"))).alias("s")).first().s
    assert shown == "Key Words: a, b\nTitle: T"


def test_formats(spark):
    def run(f, data):
        return spark.createDataFrame([(data,)], "d string").select(f(F.col("d")).alias("x")).first().x

    assert run(formats.as_markdown, "{}") == "" and run(formats.as_markdown, '{"content": "c"}') == "c"
    assert run(formats.as_list, '{"response": ["a", "b"]}') == "- a\n- b" and run(formats.as_list, '{"response": "x"}') == "x" and run(formats.as_list, "{}") == ""
    assert run(formats.as_essay, "{}") == "# Untitled Essay"
    assert run(formats.as_essay, '{"title": "T", "sections": [{"content": "c"}, {"heading": "H"}]}') == "# T\n\n## Introduction\nc\n\n## H"
    table = '{"headers": ["a", "b,c"], "rows": [["1", "x \\"y\\""], ["2"], ["3", "l\\nm", "z"]]}'
    assert run(formats.as_csv, table) == 'a,"b,c"\r\n1,"x ""y"""\r\n2\r\n3,"l\nm",z\r\n'
    assert run(formats.as_records, table) == '[{"a":"1","b,c":"x \\"y\\""},{"a":"2"},{"a":"3","b,c":"l\\nm"}]'
    assert run(formats.as_json, 'x\n```json\n{"a": 1}\n```') == '{\n    "a": 1\n}' and run(formats.as_json, "plain") == "plain"
    with pytest.raises(ValueError):
        formats.formatter("pdf")


def test_jobs(spark):
    schema = "id string, document_id string, collection_id string, job_type string, status string, data string, created_at timestamp, updated_at timestamp"
    rows = [
        ("a", "d1", "c1", "query", "pending", "{}", T0, None),
        ("a", "d1", "c1", "query", "completed", "{}", T0, T0),
        ("b", "d2", None, "strange", "pending", None, T0, None),
        ("b", "d2", None, "strange", "pending", None, T0, None),
        ("c", None, "c2", "batch", "running", None, T0, T0),
        ("d", "d1", "c1", "query", "completed", "{}", T0, T0),
    ]
    df = spark.createDataFrame(rows, schema)
    assert {r.id: r.status for r in jobs.latest(df).collect()} == {"a": "completed", "b": "pending", "c": "running", "d": "completed"}
    assert [r.id for r in jobs.pending(df).collect()] == ["b"]
    assert {r.id: r.handler for r in jobs.dispatch(jobs.latest(df)).collect()}["b"] == "single_file"
    results = spark.createDataFrame([("a", "R")], "job_id string, data string")
    wanted = spark.createDataFrame([("a",), ("b",), ("d",), ("x",)], "job_id string")
    assert {r.job_id: (r.http_status, r.data) for r in jobs.result_gate(wanted, df, results).collect()} == {"a": (200, "R"), "b": (400, None), "d": (404, None), "x": (404, None)}
    changes = spark.createDataFrame([("b", "running", None), ("c", "failed", "boom"), ("d", "pending", None)], "id string, status string, error string")
    moved = {r.id: (r.status, r.error) for r in jobs.transition(jobs.latest(df), changes).collect()}
    assert moved["b"] == ("running", None) and moved["c"] == ("failed", "boom") and moved["d"] == ("completed", None)
    collections = spark.createDataFrame([("c1", "One"), ("c2", "Two")], "id string, name string")
    docs = spark.createDataFrame([("d1", "c1"), ("d2", "c2")], "id string, collection_id string")
    chunks = spark.createDataFrame([("k1", "d1", "c1"), ("k2", "d2", "c2")], "id string, document_id string, collection_id string")
    store = jobs.Store(collections, docs, chunks, df, results)
    left = store.delete_collections(spark.createDataFrame([("c1",)], "collection_id string"))
    assert [t.count() for t in (left.collections, left.documents, left.chunks, left.jobs, left.results)] == [1, 1, 1, 3, 0]
    left = store.delete_documents(spark.createDataFrame([("d1",)], "document_id string"))
    assert [t.count() for t in (left.documents, left.chunks, left.jobs)] == [1, 1, 6] and left.jobs.where("document_id = 'd1'").count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([("a", 0, "x" * 101), ("a", 1, " "), ("a", 9, "y" * 500), ("b", 0, "short"), ("c", 0, None)], "document_id string, page bigint, text string")
    assert {r.document_id: r.reader for r in layout.triage(pages).collect()} == {"a": "text", "b": "ocr", "c": "ocr"}
    docs = spark.createDataFrame([("a", "pdf"), ("b", "pdf"), ("d", "pdf"), ("e", "epub"), ("f", "png")], "document_id string, extension string")
    assert {r.document_id: r.document_type for r in layout.document_types(docs, pages).collect()} == {"a": "mixed_pdf", "b": "scanned_pdf", "d": "scanned_pdf", "e": "epub", "f": "image"}
    answer = '{"pages": [{"text_blocks": [{"text": "one"}, {"text": "two", "confidence": 0.5}], "tables": [{"headers": ["h", "i"], "rows": [["1", "2"]]}], "images": [{"description": "pic"}]}]}'
    elements = layout.parse_layout(spark.createDataFrame([("a", answer)], "document_id string, response string"))
    assert {(r.kind, r.text, r.confidence) for r in elements.collect()} == {("text", "one", 1.0), ("text", "two", 0.5), ("table", None, 1.0), ("image", "pic", 1.0)}
    assert layout.flatten(elements).first().text == "one\n\ntwo\n\nTable:\nh | i\n-----\n1 | 2"
    grouped = layout.group_pages(elements).first()
    assert grouped.text_blocks == ["one", "two"] and grouped.images == ["pic"]
    tried = spark.createDataFrame([("a", "x", 2, True), ("a", "y", 1, False), ("b", "x", 2, False)], "document_id string, engine string, priority int, valid boolean")
    assert [(r.document_id, r.engine) for r in layout.choose_engine(tried).collect()] == [("a", "x")]
    texts = spark.createDataFrame([("a", 0, "text", " " + "x" * 25), ("a", 1, "text", "y" * 24 + " "), ("b", 0, "text", "  "), ("c", 0, "table", "z" * 99)], "document_id string, element_index bigint, kind string, text string")
    assert {r.document_id: r.valid for r in layout.valid_results(texts, ["document_id"]).collect()} == {"a": True, "b": False, "c": False}


def test_rates(spark):
    times = [0, 30, 60, 3595, 3600, 3650, 3700, 7199, 7201]
    rows = [(i, "u", T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)] + [(99, None, T0)]
    got = {r.id: r.n_recent for r in rates.window_counts(spark.createDataFrame(rows, "id bigint, u string, ts timestamp"), "u", "ts").collect()}
    assert got == {i: sum(t - 60 <= s <= t for s in times) for i, t in enumerate(times)}


def test_pipelines(spark):
    docs = spark.createDataFrame([("d", "c", "A first sentence. " * 60), ("e", "c", None), ("f", "c", " ")], "id string, collection_id string, text string")
    chunks = rag.index(docs).collect()
    assert {r.document_id for r in chunks} == {"d"} and all(len(r.embedding) == 64 for r in chunks) and len({r.chunk_id for r in chunks}) == len(chunks)
    questions = spark.createDataFrame([(1, "Q?"), (2, "R?")], "query_id bigint, question string")
    hits = spark.createDataFrame([(1, "Q?", 2, "two", "f2", None), (1, "Q?", 1, "one", "f1", "{}")], "query_id bigint, question string, rank int, chunk_text string, filename string, document_metadata string")
    answers = {r.query_id: r.data for r in rag.answer(questions, hits, "separate").collect()}
    assert answers[2] == '{"content":"No relevant documents found."}' and answers[1].index('"f1"') < answers[1].index('"f2"')
    whole = {r.query_id: r.data for r in rag.answer(questions, hits, "anything else").collect()}
    assert "one\\n---\\ntwo" in whole[1] and '"sources":["f1","f2"]' in whole[1]


def test_analyses(spark):
    task = {"prompt": "{{ question }} {{ document_text }}", "question": "Q?"}
    assert rag.search_text(task) == "Q?" and rag.search_text({**task, "embedding_reference": "R"}) == "R"
    with pytest.raises(ValueError):
        rag.search_text({"prompt": "x"})
    hits = spark.createDataFrame([(1, 2, "two"), (1, 1, "one")], "query_id bigint, rank int, chunk_text string")
    assert {r.prompt for r in rag.analyse_hits(hits, task, "separate", 50).collect()} == {"Q? one", "Q? two"}
    assert [r.prompt for r in rag.analyse_hits(hits, task, "merge", 50).collect()] == ["Q? one\n---\ntwo"]
    elements = spark.createDataFrame([("/in/a.txt", 1, "B"), ("/in/a.txt", 0, "A"), ("/in/b.txt", None, None)], "path string, element_index bigint, text string")
    respond = lambda prompt: F.concat(F.lit('```json\n{"response": ["'), F.replace(prompt, F.lit("\n"), F.lit("/")), F.lit('"]}\n```'))
    assert [tuple(r) for r in rag.analyse_files(elements, task, "list", 50, respond).collect()] == [("/in/a.txt", "a_output.md", "- Q? A/B")]
    chunks = spark.createDataFrame([("d", i, f"c{i}") for i in range(5)], "document_id string, chunk_index bigint, chunk_text string")
    docs = spark.createDataFrame([("d", {"Title": "File"}), ("e", {"Title": "Other"})], "document_id string, properties map<string,string>")
    found = lambda prompt: F.concat(F.lit('{"title": "'), F.regexp_replace(prompt, r"\s+", " "), F.lit('", "doi": ""}'))
    got = {r.document_id: r.metadata for r in rag.extract_metadata(chunks, docs, task, 50, found).collect()}
    assert got["d"]["title"] == "Q? c0 c1 c2" and got["d"]["llm_extracted"] == "true" and got["e"] == {"Title": "Other"}
    plain = {r.document_id: r.metadata for r in rag.extract_metadata(chunks, docs, task, 50).collect()}
    assert plain["d"] == {"Title": "File"}


def test_search_in_blocks(spark):
    rows = spark.range(40).select("id", F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("v"))
    whole = {tuple(r) for r in search.batched_top_k(rows, rows.where("id % 4 = 0"), "id", "v", 3).collect()}
    assert whole == {tuple(r) for r in search.batched_top_k(rows, rows.where("id % 4 = 0"), "id", "v", 3, block=3).collect()} and len(whole) == 30


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_search_among_copies(spark, kind):
    """More equal nearest vectors in a batch than are kept a few of: the least ids come out, whatever the batches."""
    far = [(i, [float(i), 1.0 / 3]) for i in range(1000, 1100)]
    copies = [(i, [0.1, 1.0 / 3]) for i in range(100, 500)]
    rows = spark.createDataFrame(copies[::-1] + far + [(1, [0.1, 0.5]), (2, [float("nan"), 0.0])], "id bigint, v array<double>").withColumn("id", F.col("id").cast(kind))
    queries = rows.where("id in (150, 1, 1050)")
    want = {150: [100, 101, 102], 1: [1, 100, 101], 1050: [1050, 1049, 1051]}
    for parts in (1, 3):
        got = {}
        for r in search.batched_top_k(rows.repartition(parts), queries, "id", "v", 3).orderBy("query_id", "rank").collect():
            got.setdefault(int(r.query_id), []).append(int(r.id))
        assert got == want
    few = search.batched_top_k(rows.where("id = 2 or id >= 1000").coalesce(1), rows.where("id = 1"), "id", "v", 101).orderBy(F.desc("rank")).first()
    assert int(few.id) == 2 and few.rank == 101  # what has no distance comes last


def test_embedder(spark):
    df = spark.createDataFrame([("b b a",), (None,), ("",)], "t string")
    got = [r.e for r in df.select(embed(F.col("t")).alias("e")).collect()]
    assert [round(sum(x * x for x in v), 5) for v in got] == [1.0, 0.0, 0.0]
    assert max(abs(x - y) for x, y in zip(got[0], hash_vectors(["b b a"])[0])) < 1e-6


def test_config():
    assert config.fill({"a": ["${X}", "${Y:-z}"]}, {"X": "1"}) == {"a": ["1", "z"]}
    with pytest.raises(KeyError):
        config.fill("${X}", {})
    assert config.get({"a": {"b": None}}, "a.b", 3) == 3 and config.get({"a": {"b": 0}}, "a.b", 3) == 0


def test_file_keys_in_their_order(spark):
    rows = [{"authors": "A; B", "publication_date": "2020", "Title": "x", "title": " ", "creator": "tool", "date": "2001"}, {"/Author": '["C ", ""]', "Author": "D", "Subject": " s ", "/Subject": ""}, {"authors": "[]", "Author": "E,;"}, {}, None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p map<string,string>")
    got = {r.i: r.m for r in df.select("i", metadata.map_file_keys(F.col("p")).alias("m")).collect()}
    assert got[0] == {"title": "x", "authors": '["A","B"]', "publication_date": "2020"}
    assert got[1] == {"authors": '["C"]', "abstract": "s"} and got[2] == {"authors": '["E"]'} and got[3] == {} and not got[4]


def test_valid_results_strip_all_blanks(spark):
    text = "　 " + "x" * 49 + "  "
    df = spark.createDataFrame([("a", 0, "text", text), ("b", 0, "text", text + "x"), ("b", 1, "text", "　")], "document_id string, element_index int, kind string, text string")
    assert {r.document_id: r.valid for r in layout.valid_results(df, ["document_id"]).collect()} == {"a": False, "b": True}


def test_collection_pages(spark):
    docs = spark.createDataFrame([(f"d{i:03}", "c", "f", "o", i) for i in range(250)], "id string, collection_id string, filename string, original_filename string, file_size int")
    pages = catalog.collection_pages(spark.createDataFrame([("c", "n"), ("e", "m")], "id string, name string"), docs, page_size=50).collect()
    full = [p for p in pages if p.collection_id == "c"]
    assert len(full) == 5 and sorted(x.id for p in full for x in p.documents) == [f"d{i:03}" for i in range(250)] and {p.n_documents for p in full} == {250}
    assert [(p.n_documents, p.page, p.documents) for p in pages if p.collection_id == "e"] == [(0, 0, [])]


def test_blocks_by_group(spark):
    """Blocks of queries and rows that meet in a shuffle give what one pass gives, also within groups."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(120)] + [(900, 1, None), (901, 1, [1.0])], "id bigint, g int, v array<double>")
    for same in (None, "g"):
        want = {tuple(r) for r in search.batched_top_k(df, df.where("id % 2 = 0"), "id", "v", 3, same).collect()}
        assert {tuple(r) for r in search.batched_top_k(df, df.where("id % 2 = 0"), "id", "v", 3, same, block=7).collect()} == want
