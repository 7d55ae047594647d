import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.functions.embedding import hash_vectors
from folioforge.plans import rag
from folioforge.service import NotFound, Service
from folioforge.sources.files import read_elements, scan_folder
from folioforge.sources.mobi import read_mobi
from folioforge.sources.pdf import read_pdf
from folioforge.sources.sinks import dump, restore, write_outputs


def pdf(pages, info=b"<< /Title (A \\(small\\) book) /Author <FEFF004A> >>"):
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        info,
    ]
    for i, page in enumerate(pages):
        body = zlib.compress(page.encode("cp1252"))
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>".encode(), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream"]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in enumerate(objects, 1))
    return out + b"trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF"


def mobi(records, encoding=65001):
    head = struct.pack(">HHIHHHH", 2, 0, 0, len(records), 4096, 0, 0) + b"MOBI" + struct.pack(">III", 0x20, 2, encoding)
    parts = [head, *records]
    at, index = 78 + 8 * len(parts) + 2, b""
    for p in parts:
        index += struct.pack(">II", at, 0)
        at += len(p)
    return b"book".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(parts)) + index + b"\0\0" + b"".join(parts)


def test_pdf_pages():
    pages = ["BT /F1 12 Tf 72 700 Td (Hello caf\xe9) Tj 0 -14 Td [(wor) 20 (ld) -300 (again)] TJ T* (end) Tj ET", "q Q", "BT /F1 9 Tf 1 0 0 1 5 5 Tm <7033> Tj ET"]
    elements, info = read_pdf(pdf(pages))
    assert elements == [("Hello caf\xe9\nworld again\nend", {"page_number": "1"}), ("p3", {"page_number": "3"})]
    assert info == {"Title": "A (small) book", "Author": "J"}
    with pytest.raises(ValueError):
        read_pdf(b"no such file")


def test_pdf_with_a_map_of_characters():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R] >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", b"<< /Type /Page /Contents 5 0 R /Resources << /Font << /F 3 0 R >> >> >>", b"<< >>\nstream\nBT /F 1 Tf <00010010 0011> Tj ET\nendstream", b"<< >>\nstream\n" + cmap + b"\nendstream"]
    data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in enumerate(objects, 1))
    assert read_pdf(data)[0] == [("Hiab", {"page_number": "1"})]


def test_mobi_text():
    # Literals, a blank with a letter, and a repetition of five bytes from six back.
    packed = b"<p>H\xe5" + b"\x01\xc3\x01\xa9" + b"abcdef" + struct.pack(">H", 0x8000 | 6 << 3 | 2) + b"</p>"
    assert read_mobi(mobi([packed, b"<b>two</b>"]))[0] == [("H eéabcdefabcdetwo", {"part": "book.html"})]
    assert read_mobi(mobi([b" "])) == ([], {})


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(["BT /F1 1 Tf (page) Tj ET"]))
    (tmp_path / "b.mobi").write_bytes(mobi([b"<p>book</p>"]))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 trailer << /Encrypt 1 0 R >>")
    (tmp_path / "d.xyz").write_text("other")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_elements(scan_folder(spark, str(tmp_path))).collect()}
    assert rows["a.pdf"].text == "page" and json.loads(rows["a.pdf"].file_metadata)["Author"] == "J" and rows["b.mobi"].text == "book" and "encrypted" in rows["c.pdf"].error
    assert scan_folder(spark, str(tmp_path), extensions=None, max_files=None).count() == 4


def test_outputs_and_dumps(spark, tmp_path):
    df = spark.createDataFrame([("x/a_output.md", "one\ntwo"), ("b c_output.csv", "1,2"), ("a_output.md", "later"), (None, "x"), ("n", None)], "name string, text string")
    assert write_outputs(df, f"{tmp_path}/out", "name", "text") == 2
    assert (tmp_path / "out/a_output.md").read_text() == "one\ntwo\n" and (tmp_path / "out/b c_output.csv").read_text() == "1,2\n"
    for stamp in ("2024", "2025"):
        dump({"t": spark.createDataFrame([(stamp,)], "s string"), "u": spark.range(2).toDF("n")}, f"{tmp_path}/dumps", stamp)
    back = restore(spark, f"{tmp_path}/dumps")
    assert set(back) == {"t", "u"} and back["t"].first().s == "2025" and back["u"].count() == 2


TASKS = {"summary": {"prompt": "{{ instruction }} {{ document_text }}", "instruction": "Sum up.", "question": "What is it about?"}}


def test_service(spark, tmp_path):
    s = Service(spark, f"{tmp_path}/tables", TASKS)
    s.reset()
    made = s.create_collection("Reports")
    s.create_collection("Empty")
    with pytest.raises(ValueError):
        s.create_collection("Reports")
    with pytest.raises(NotFound):
        s.collection("No such")
    assert {r.name for r in s.list_collections().collect()} == {"Reports", "Empty"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("The harbour report counts the boats.")
    (tmp_path / "in/b.txt").write_text("The harbour report counts the boats.")
    (tmp_path / "in/c.txt").write_text("Minutes of the school meeting about the roof.")
    files = scan_folder(spark, f"{tmp_path}/in")
    got = {r.path[-5:]: r for r in s.upload("Reports", files).collect()}
    assert sorted(r.reason for r in got.values()) == ["accepted", "accepted", "duplicate"]
    assert {r.reason for r in s.upload(made["id"], files).collect()} == {"duplicate"}
    page = s.collection("Reports").first()
    assert page.n_documents == 2 and {d.original_filename for d in page.documents} >= {"c.txt"} and s.collection("Empty").first().documents == []
    school = got["c.txt"].document_id
    asked = s.query("Reports", "What does the school meeting say?")
    one = s.query("Reports", "What is said?", "separate", school)
    analysis = s.analyse("Reports", "summary", document_id=school)
    nothing = s.query("Empty", "Anything?")
    assert s.job(asked)["status"] == "pending"
    with pytest.raises(ValueError):
        s.result(asked)
    assert s.work() == 6 and s.work() == 0
    assert "school meeting" in json.loads(s.result(asked))["result"]["content"]
    assert [r["source"]["filename"] for r in json.loads(s.result(one))["results"]] == ["c.txt"]
    assert json.loads(s.result(analysis))["result"]["content"].startswith("[echo] Sum up. Minutes")
    assert s.markdown(nothing) == rag.NO_DOCUMENTS and s.markdown(asked) == ""
    s.update_metadata({school: {"publisher": "The school"}})
    assert "Publisher: The school" in s.document(school).first().shown
    waits = s.query("Reports", "Later?")
    s.cancel(waits)
    assert s.job(waits) == {"id": waits, "status": "failed", "job_type": "query", "error": "cancelled"}
    s.retry(waits)
    assert s.job(waits)["status"] == "pending"
    s.delete_document(school)
    assert s.table("document_chunks").where(F.col("document_id") == school).count() == 0 and s.list_documents("Reports").count() == 1
    s.delete_collection("Reports")
    assert s.table("documents").count() == 0 and s.list_collections().count() == 1
    with pytest.raises(NotFound):
        s.job("none")


def test_contradicting(spark):
    chunks = spark.createDataFrame([(1, hash_vectors(["it is not true that boats are red"])[0]), (2, hash_vectors(["roofs"])[0])], "id bigint, embedding array<double>")
    claims = spark.createDataFrame([(9, "boats are red")], "claim_id bigint, claim string")
    assert [(r.claim_id, r.id) for r in rag.contradicting(claims, chunks, "id", 1).collect()] == [(9, 1)]
