import zipfile

from pyspark.sql import functions as F

from folioforge.sources import files, sinks
from folioforge.sources.html import html_to_text
from folioforge.streaming.jobs import counts_by_window, run_available


def make_epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/content.opf",
            '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></metadata>'
            '<manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
        )
        z.writestr("OEBPS/a.xhtml", "<html><body><p>First &amp; last</p></body></html>")
        z.writestr("OEBPS/b.xhtml", "<html><body> </body></html>")


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain", encoding="utf-8")
    (tmp_path / "b.md").write_text("# head", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "skip.exe").write_bytes(b"MZ")
    make_epub(tmp_path / "e.epub")
    (tmp_path / "sub" / "z.txt").write_text("deep", encoding="utf-8")
    flat = files.scan_folder(spark, str(tmp_path))
    assert [r.name for r in flat.select("name").collect()] == ["a.txt", "b.md", "bad.txt", "c.pdf", "e.epub"]
    assert files.scan_folder(spark, str(tmp_path), recursive=True).count() == 6
    assert files.scan_folder(spark, str(tmp_path), max_files=2).count() == 2
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_elements(flat).collect()}
    assert rows["a.txt"].text == "plain" and rows["b.md"].text == "# head"
    assert rows["e.epub"].text.strip() == "First & last" and rows["e.epub"].metadata == {"chapter": "a.xhtml"} and '"creators": ["A", "B"]' in rows["e.epub"].file_metadata
    assert "no pages" in rows["c.pdf"].error and rows["bad.txt"].error
    own = {"application/pdf": lambda content: ([("page", {"page_number": "1"})], {"Title": "T"})}
    assert files.read_elements(flat.where("name = 'c.pdf'"), own).first().text == "page"


def test_prompt_folder(spark, tmp_path):
    (tmp_path / "prompt.md").write_text("{{ document_text }}", encoding="utf-8")
    (tmp_path / "other.txt").write_text("x", encoding="utf-8")
    assert files.prompt_components(spark, str(tmp_path)) == {"prompt": "{{ document_text }}"}


def test_html():
    assert html_to_text("<p>a &amp; b<!-- c --><script>x</script><b>d") == "a & bd"
    assert html_to_text(None) is None and html_to_text("") == ""


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id bigint, v string")
    path = str(tmp_path / "t")
    assert sinks.append_new(df, path, "id") == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, "id") == 1
    assert spark.read.parquet(path).count() == 3
    sinks.dump({"t": df}, str(tmp_path / "dumps"), "2026-01-01")
    sinks.dump({"t": df}, str(tmp_path / "dumps"), "2026-01-02")
    assert sinks.latest_dump(spark, str(tmp_path / "dumps")).endswith("2026-01-02")
    sinks.write_texts(df.distinct(), str(tmp_path / "texts"), "id", "v")
    assert spark.read.text(str(tmp_path / "texts")).where("name = 2").first().value == "b"


def test_job_stream_is_idempotent(spark, tmp_path):
    schema = "id string, document_id string, collection_id string, job_type string, status string, data string, created_at timestamp, updated_at timestamp"
    source, sink = str(tmp_path / "jobs"), str(tmp_path / "sink")
    rows = [("a", None, None, "query", "pending", None, None, None), ("b", None, None, "odd", "pending", None, None, None), ("b", None, None, "odd", "running", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(source)
    run_available(spark, source, df.schema, sink, str(tmp_path / "cp1"))
    run_available(spark, source, df.schema, sink, str(tmp_path / "cp2"))
    assert [(r.id, r.handler) for r in spark.read.parquet(sink).collect()] == [("a", "query")]


def test_windowed_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = counts_by_window(stream, "ts", "event_type", "1 hour", "10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) s from counted").first().s == events.count()
