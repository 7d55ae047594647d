import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import languages as L
from folioforge.llm import pairs as P


@pytest.fixture(scope="module")
def field(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    return L.train_on(docs, "doc_id", "text", sample=400)


TEXTS = {
    "en": "The committee met in May and decided that the report should be written by the end of the year, although nobody liked it.",
    "de": "Der Ausschuss hat im Mai getagt und beschlossen, dass der Bericht bis zum Ende des Jahres geschrieben werden soll.",
    "fr": "Le comité s'est réuni en mai et a décidé que le rapport devait être écrit avant la fin de l'année, bien que personne ne l'aime.",
    "es": "El comité se reunió en mayo y decidió que el informe debía escribirse antes del final del año, aunque a nadie le gustaba.",
    "it": "Il comitato si è riunito in maggio e ha deciso che il rapporto doveva essere scritto prima della fine dell'anno.",
    "pt": "O comitê se reuniu em maio e decidiu que o relatório devia ser escrito antes do fim do ano, embora ninguém gostasse.",
}


def test_languages_and_parts(field):
    labeller = L.Labeller(field)
    share, _ = labeller.label(list(TEXTS.values()), False)
    assert [L.LANGUAGES[k] for k in share.argmax(1)] == list(TEXTS) and share.max(1).min() > 0.8
    mixed = TEXTS["en"] + " " + TEXTS["de"] + " " + TEXTS["es"]
    _, parts = labeller.label([mixed], True)
    assert [L.LANGUAGES[k] for _, _, k, _ in parts[0]] == ["en", "de", "es"]
    a, b = parts[0][1][:2]
    assert abs(a - len(TEXTS["en"]) - 1) < 12 and abs(b - len(TEXTS["en"]) - 1 - len(TEXTS["de"])) < 12


def test_held_out_accuracy(field, spark, sf):
    """Words of made mixed sequences of documents that the field didn't see."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) >= 200").select("text").collect()]
    rng = np.random.default_rng(1)
    paragraphs = [[] for _ in L.LANGUAGES]
    for t in texts:
        words = L.WORD.findall(t.lower())
        hits = np.array([sum(w in own for w in words) for own in L._LEXICONS])
        if hits.max() * 5 > len(words) and hits.max() > 2 * np.sort(hits)[-2]:
            paragraphs[hits.argmax()].append(words)
    made, labels = L._mixed_sequences(paragraphs, 60, 80, rng)
    labeller = L.Labeller(field)
    at = labeller._lookup([w for s in made for w in s]).reshape(60, 80)
    p = L._marginals(labeller.scores[at].transpose(1, 0, 2), np.full(60, 80), field.transitions)
    assert (p.argmax(2).T == labels).mean() > 0.95


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    scores, move = rng.standard_normal((4, 1, L.N)).astype(np.float32), rng.standard_normal((L.N, L.N)).astype(np.float32)
    want, pairs = np.zeros((4, L.N)), np.zeros((3, L.N, L.N))
    for path in itertools.product(range(L.N), repeat=4):
        weight = np.exp(sum(scores[t, 0, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for t, k in enumerate(path):
            want[t, k] += weight
        for t, (a, b) in enumerate(zip(path, path[1:])):
            pairs[t, a, b] += weight
    got = L._marginals(scores, np.array([4]), move)[:, 0]
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-4)
    single, joint = L._pair_marginals(scores, np.array([4]), move)
    assert np.allclose(single[:, 0], got, atol=1e-5) and np.allclose(joint[:, 0], pairs / pairs.sum((1, 2), keepdims=True), atol=1e-4)


def test_stretches_of_a_text_know_each_other(monkeypatch):
    """A text in stretches is labelled as in one."""
    rng = np.random.default_rng(2)
    scores = rng.standard_normal((23, 1, L.N)).astype(np.float32)
    move = np.log(np.full((L.N, L.N), 0.02) + 0.9 * np.eye(L.N)).astype(np.float32)
    whole = L._marginals(scores, np.array([23]), move)[:, 0]
    lengths = np.array([10, 10, 3])
    cut = np.zeros((10, 3, L.N), np.float32)
    for k in range(3):
        cut[: lengths[k], k] = scores[k * 10 : k * 10 + lengths[k], 0]
    got = L._marginals(cut, lengths, move, *(x.astype(np.float32) for x in L._context(cut, lengths, move)))
    assert np.allclose(np.concatenate([got[: lengths[k], k] for k in range(3)]), whole, atol=1e-4)


def test_addresses_are_in_no_language(field):
    labeller = L.Labeller(field)
    links = " https://the-school-report.example/about/the/house/and/the/road www.The-Council.example/with/you"
    share, parts = labeller.label([TEXTS["pt"] + links * 20, links, TEXTS["en"] + links * 9 + " " + TEXTS["fr"]], True)
    assert L.LANGUAGES[share[0].argmax()] == "pt" and share[0].max() > 0.8 and not share[1].any()
    assert [L.LANGUAGES[k] for _, _, k, _ in parts[2]] == ["en", "fr"] and parts[2][1][0] >= len(TEXTS["en"]) + 9 * len(links)


def test_named_languages(spark):
    cases = {"en": "en", " EN ": "en", "en-GB": "en", "en_US": "en", "eng": "en", "English": "en", "ger": "de", "deu": "de", "fre": "fr", "Portuguese": "pt", "da": "other", "sv": "other", "Danish": "other", "": None, "-": None, "n/a": None, "und": None, "xx": None, "unknown": None, "zxx": None, "mul?": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.n for r in df.select("v", L.named_language(F.col("v")).alias("n")).collect()} == cases


def test_label_edges(spark, field):
    rows = [("a", TEXTS["fr"]), ("a", TEXTS["fr"]), ("b", None), ("c", ""), ("d", "123 456"), (None, TEXTS["it"]), ("e", TEXTS["it"] * 500)]
    df = spark.createDataFrame(rows, "id string, t string").select("*", F.lit(1).alias("language"), F.lit(2).alias("confidence"))
    got = sorted((r.id, r.language) for r in L.label_languages(df, "id", "t", field).collect())
    assert got == [("a", "fr"), ("a", "fr"), ("b", None), ("c", None), ("d", None), ("e", "it")] or sorted(got, key=str) == sorted([("a", "fr"), ("a", "fr"), ("b", None), ("c", None), ("d", None), ("e", "it")], key=str)
    assert L.label_languages(df.limit(0), "id", "t", field, parts=True).count() == 0


def test_wrong_labels(spark, field):
    text = {k: v * 3 for k, v in TEXTS.items()}
    docs = [(1, "d1", '{"language": "de"}', text["en"]), (2, "d2", "{}", text["fr"]), (3, "d3", None, text["es"]), (4, "d4", '{"language": "it-CH"}', text["it"]), (5, "d5", '{"language": "en"}', "short"), (6, "d6", '{"language": null}', text["pt"]), (7, "d7", "{}", None), (8, "d8", "not json", text["de"])]
    chunks = [("d4", 0, text["it"]), ("d4", 1, text["en"]), ("d4", 1, text["en"]), ("d4", 2, TEXTS["en"][:100]), ("d1", 0, text["en"]), ("d5", 0, text["fr"]), ("d4", 3, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, id string, document_metadata string, text string")
    c = spark.createDataFrame(chunks, "document_id string, chunk_index bigint, chunk_text string")
    got = {(r.doc_id, r.kind, r.chunk_index, r.language) for r in L.wrong_labels(d, c, field, spark.createDataFrame([(3,)], "doc_id bigint")).collect()}
    assert got == {(1, "wrong", -1, "en"), (2, "missing", -1, "fr"), (6, "missing", -1, "pt"), (8, "missing", -1, "de"), (4, "segment", 1, "en")}
    assert L.wrong_labels(d.limit(0), c.limit(0), field, d.select("doc_id").limit(0)).count() == 0


def test_empty_answers():
    assert all(P.is_empty(x) for x in (None, "", " ​", "```json\n```", "...", '""', "-"))
    assert not P.is_empty("5.") and not P.is_empty('```json\n{"a": 1}\n```')


def test_requests():
    assert P.requested_language("What is it? Please answer in German.") == "de"
    assert P.requested_language("Que resultados são citados? Responda em inglês.") == "en"
    assert P.requested_language("Wer ist zuständig? Antworte auf Französisch.") == "fr"
    assert P.requested_language("Who wrote the German report?") is None
    assert P.requested_language("") is None


@pytest.fixture(scope="module")
def sample(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    rows = P.answer_pairs(spark.read.parquet(f"{folder}/jobs.parquet"), spark.read.parquet(f"{folder}/results.parquet")).collect()
    return [(r.question, r.answer, r.finish) for r in sorted(rows, key=lambda r: (r.job_id, r.answer_no)) if r.answer is not None]


def test_classifier_on_held_out_made_pairs(sample):
    counts = P._count_words([P.plain(a)[0].lower() for _, a, _ in sample], P._Hashes())
    lexicon = P.Lexicon(*(c.astype(np.float32) for c in counts))
    half = len(sample) // 2
    model = P.fit(sample[:half], lexicon)
    held = [x for x, d in zip(sample[half:], model.decide([x if not P.is_empty(x[1]) else (x[0], "x.", None) for x in sample[half:]], P._Hashes()), strict=True) if d is None and not P.is_empty(x[1])]
    pairs, y = P.synthetic(held, model.lexicon, P._Hashes(), np.random.default_rng(8))
    got = model.decide(pairs, P._Hashes())
    right = [(g is None and not t.any()) or (g is not None and t[P.LABELS.index(g)] == 1) for g, t in zip(got, y, strict=True)]
    assert np.mean(right) > 0.93
    fixed = [("What is it?", "I'm sorry, but I can't help with that.", None), ("What is the role of the archive?", "What is the role of the archive?", "stop")]
    assert model.decide(fixed, P._Hashes()) == ["refusal", "copies_question"]
    assert model.decide([], P._Hashes()) == []


def test_answer_shapes(spark):
    R = {"content": "An answer.", "model": "m", "metadata": {"finish_reason": "stop"}}
    results = [
        ("a", json.dumps({"strategy": "merge", "result": R})), ("a", json.dumps({"strategy": "merge", "result": R})), ("b", json.dumps(json.dumps({"strategy": "separate", "results": [{"llm_response": R}, {"llm_response": {"content": None}}]}))),
        ("c", json.dumps({"content": "No relevant documents found."})), ("d", json.dumps(R)), ("e", "not json"), ("f", None), (None, json.dumps(R)), ("g", json.dumps({"strategy": "merge", "result": R}, indent=2)), ("h", "[]"), ("x", json.dumps(R)),
    ]
    jobs = [(k, json.dumps({"question": "Q?"})) for k in "abcdefgh"] + [("a", json.dumps({"question": "Q?"})), ("n", None), ("o", "{}"), ("p", '{"question": " "}'), (None, '{"question": "Q"}')]
    j = spark.createDataFrame(jobs, "id string, data string").withColumn("question", F.lit(1))
    r = spark.createDataFrame(results, "job_id string, data string").withColumn("answer", F.lit(1))
    got = {(x.job_id, x.answer_no, x.answer, x.finish) for x in P.answer_pairs(j, r).collect()}
    assert got == {("a", 0, "An answer.", "stop"), ("b", 0, "An answer.", "stop"), ("b", 1, None, None), ("d", 0, "An answer.", "stop"), ("g", 0, "An answer.", "stop")}
    defects = {(x.job_id, x.answer_no): x.defect for x in P.defective_pairs(j, r).collect()}
    assert defects[("b", 1)] == "empty" and len(defects) == 5
    assert P.defective_pairs(j.limit(0), r.limit(0)).count() == 0
