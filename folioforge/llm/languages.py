"""Languages of documents and of their parts, by a linear-chain conditional random field over words.

Each word has features: itself, its affixes, its character n-grams and the function-word lexicons it is in. Weights
and transitions between languages are learned from a bounded sample: paragraphs that their function words tell apart
are cut up and strung together into mixed sequences. Forward-backward then gives every word of a text its languages'
probabilities, for a batch of texts at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.sampling import hashed_sample
from folioforge.llm.wordlists import FUNCTION_WORDS

LANGUAGES = tuple(FUNCTION_WORDS)
N = len(LANGUAGES)
DIMENSIONS = 1 << 16
#: Documents that the field is trained on.
SAMPLE = 800
CACHED_WORDS = 300_000
#: Words that forward-backward runs over at once; a longer text is a sequence of such stretches, messages passing between them.
STRETCH = 4_000
#: A part of fewer words in another language must be as sure as this.
SHORT_PART, SURE = 6, 0.9
WORD = re.compile(r"[^\W\d_]+")
#: Addresses are in no language.
ADDRESS = re.compile(r"(?:https?://|www\.)\S+", re.I)

_LEXICONS = [frozenset(FUNCTION_WORDS[x].split()) for x in LANGUAGES]

#: Codes of ISO 639-1.
CODES_2 = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my "
    "na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty "
    "ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
#: Codes of ISO 639-2 of living languages with many writers.
CODES_3 = (
    "afr alb amh ara arm asm aze baq bel ben bos bre bul bur cat ces chi cos cym cze dan deu div dut ell eng epo est eus fao fas fij fin fra fre fry geo ger gla gle glg gre grn guj hat hau heb her hin hrv hun hye "
    "ibo ice ind isl ita jav jpn kal kan kat kaz khm kin kir kor kur lao lat lav lit ltz mac mal mao mar may mkd mlg mlt mon mri msa mya nav nep nld nno nob nor oci ori pan per pol por pus que roh ron rum run rus "
    "sag san scc scr sin slk slo slv smo sna snd som spa sqi srd srp ssw sun swa swe tah tam tat tel tgk tgl tha tib tir ton tuk tur uig ukr urd uzb ven vie wel wol xho yid yor zho zul"
).split()
#: English names of languages.
NAMES = (
    "afrikaans albanian arabic armenian azerbaijani basque belarusian bengali bosnian breton bulgarian catalan chinese croatian czech danish dutch esperanto estonian finnish galician georgian greek gujarati hebrew hindi "
    "hungarian icelandic indonesian irish japanese javanese kannada kazakh khmer korean kurdish lao latin latvian lithuanian luxembourgish macedonian malay malayalam maltese mandarin marathi mongolian nepali norwegian "
    "persian polish punjabi romanian russian serbian sinhala slovak slovenian somali swahili swedish tagalog tamil telugu thai tibetan turkish ukrainian urdu uzbek vietnamese welsh yiddish zulu"
).split()
#: The ways metadata name the languages told apart here.
NAMED = {
    "en": "en eng english",
    "de": "de ger deu german deutsch",
    "fr": "fr fre fra french français francais",
    "es": "es spa spanish castilian español espanol",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
}


def word_features(word: str) -> list[int]:
    """Hashed features of a word in lower case; the first N are the lexicons."""
    marked = f"^{word}$"
    parts = ["w" + word, *("p" + word[:k] for k in (1, 2, 3, 4)), *("s" + word[-k:] for k in (1, 2, 3, 4)), *("g" + marked[i : i + 3] for i in range(len(marked) - 2))]
    hashed = {N + 1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (DIMENSIONS - N - 1) for x in parts}
    return sorted(hashed) + [k for k, own in enumerate(_LEXICONS) if word in own]


def readable(text: str) -> str:
    """The text with blanks in place of its addresses, so that positions stay."""
    return ADDRESS.sub(lambda m: " " * len(m[0]), text) if "://" in text or "www." in text.lower() else text


@dataclass
class Field:
    """Weights of features by language, and log transitions between the languages of neighbouring words."""

    weights: np.ndarray
    transitions: np.ndarray


def _emissions(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(2, keepdims=True))


def _passes(e: np.ndarray, lengths: np.ndarray, move: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at every word of padded sequences (words, texts, N), texts by falling lengths.

    ``before`` is what comes to the first word, ``after`` what comes back to the last one; else all languages are alike.
    """
    steps, texts, _ = e.shape
    alive = (np.arange(steps)[:, None] < lengths).sum(1)
    forward, backward = np.full_like(e, 1 / N), np.ones_like(e)
    a = e[0] if before is None else e[0] * before
    a = a / a.sum(1, keepdims=True)
    forward[0] = a
    for t in range(1, steps):
        n = int(alive[t])
        a = (a[:n] @ move) * e[t, :n]
        a /= a.sum(1, keepdims=True)
        forward[t, :n] = a
    b = np.ones((texts, N), np.float32) if after is None else after.astype(np.float32).copy()
    back = move.T.copy()
    backward[-1] = b
    for t in range(steps - 2, -1, -1):
        n = int(alive[t + 1])
        x = (b[:n] * e[t + 1, :n]) @ back
        b[:n] = x / x.sum(1, keepdims=True)
        backward[t] = b
    return forward, backward


def _marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward: probabilities of the languages for padded scores of shape (words, texts, N)."""
    forward, backward = _passes(_emissions(scores), lengths, np.exp(transitions).astype(np.float32), before, after)
    out = forward * backward
    return out / out.sum(2, keepdims=True)


def _pair_marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the words' languages, and those of neighbouring words' pairs, shape (words - 1, texts, N, N).

    All texts must be of full length.
    """
    e, move = _emissions(scores), np.exp(transitions).astype(np.float32)
    forward, backward = _passes(e, lengths, move)
    single = forward * backward
    joint = forward[:-1, :, :, None] * move * (e[1:] * backward[1:])[:, :, None, :]
    return single / single.sum(2, keepdims=True), joint / joint.sum((2, 3), keepdims=True)


def _context(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes to the first word and back to the last one of each stretch of one text, in order; full ones first.

    The product of a stretch's transitions and emissions is one matrix, made for all stretches at once; messages then
    pass from stretch to stretch, so that each is labelled within the whole text.
    """
    e, move = _emissions(scores).astype(np.float64), np.exp(transitions).astype(np.float64)
    count = e.shape[1]
    through = move[None] * e[0][:, None, :]
    through[0] = e[0, 0]
    for t in range(1, len(e)):
        n = int((t < lengths).sum())
        through[:n] = (through[:n] @ move) * e[t, :n, None, :]
        through[:n] /= through[:n].sum((1, 2), keepdims=True)
    before, after = np.ones((count, N)), np.ones((count, N))
    a = through[0, 0]
    for k in range(1, count):
        before[k] = a @ move
        a = a @ through[k]
        a /= a.sum()
    for k in range(count - 2, -1, -1):
        after[k] = through[k + 1] @ after[k + 1]
        after[k] /= after[k].sum()
    return before / before.sum(1, keepdims=True), after


def _mixed_sequences(paragraphs: list[list[list[str]]], count: int, length: int, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of ``length`` words strung together from pieces of one to three languages, and each word's language."""
    known = [k for k in range(N) if paragraphs[k]]
    words, labels = [], np.empty((count, length), np.int64)
    for i in range(count):
        seq: list[str] = []
        langs = rng.choice(known, size=min(len(known), int(rng.integers(1, 4))), replace=False)
        while len(seq) < length:
            k = int(langs[int(rng.integers(len(langs)))])
            p = paragraphs[k][int(rng.integers(len(paragraphs[k])))]
            start = int(rng.integers(max(1, len(p) - 8)))
            piece = p[start : start + int(rng.integers(8, 60))]
            labels[i, len(seq) : len(seq) + len(piece)] = k
            seq += piece
        words.append(seq[:length])
    return words, labels


def train(texts: list[str], sequences: int = 1200, length: int = 80, epochs: int = 3, batch: int = 60, seed: int = 3) -> Field:
    """Learns the field by gradient ascent on the likelihood of made sequences."""
    rng = np.random.default_rng(seed)
    paragraphs: list[list[list[str]]] = [[] for _ in range(N)]
    for text in texts:
        for part in re.split(r"\n\s*\n", readable(text)):
            words = WORD.findall(part.lower())
            hits = np.array([sum(w in own for w in words) for own in _LEXICONS])
            best = int(hits.argmax())
            if len(words) >= 12 and hits[best] >= 4 and hits[best] * 5 >= len(words) and hits[best] > 1.4 * np.sort(hits)[-2]:
                paragraphs[best].append(words)
    weights = np.zeros((DIMENSIONS, N), np.float32)
    transitions = np.log(np.full((N, N), 0.02 / (N - 1)) + np.eye(N) * (0.98 - 0.02 / (N - 1))).astype(np.float32)
    weights[np.arange(N), np.arange(N)] = 1.0
    if not any(paragraphs):
        return Field(weights, transitions)
    made, labels = _mixed_sequences(paragraphs, sequences, length, rng)
    index: dict[str, int] = {}
    at = np.array([[index.setdefault(w, len(index)) for w in seq] for seq in made])
    lists = [word_features(w) for w in index]
    size = np.array([len(x) for x in lists])
    flat, starts = np.concatenate([np.array(x) for x in lists]), np.concatenate([[0], np.cumsum(size)])
    square_w, square_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(sequences)
        for lo in range(0, sequences, batch):
            rows = order[lo : lo + batch]
            types, inverse = np.unique(at[rows], return_inverse=True)
            n = size[types]
            stop = np.cumsum(n)
            feats = flat[np.repeat(starts[types] - (stop - n), n) + np.arange(stop[-1])]
            emission = np.add.reduceat(weights[feats], stop - n, axis=0)
            scores = emission[inverse.reshape(at[rows].shape)].transpose(1, 0, 2)
            y = labels[rows].T
            p, joint = _pair_marginals(scores, np.full(len(rows), length), transitions)
            error = -p
            error[np.arange(length)[:, None], np.arange(len(rows)), y] += 1
            per_type = np.stack([np.bincount(inverse.ravel(), error[:, :, k].T.ravel(), len(types)) for k in range(N)], 1)
            gradient = np.stack([np.bincount(feats, np.repeat(per_type[:, k], n), DIMENSIONS) for k in range(N)], 1).astype(np.float32) / len(rows)
            gradient -= 1e-4 * weights
            # Pairs of neighbours: observed less expected.
            seen = np.zeros((N, N))
            np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
            move = ((seen - joint.sum((0, 1))) / len(rows)).astype(np.float32)
            square_w += gradient**2
            square_t += move**2
            weights += 0.3 * gradient / np.sqrt(square_w)
            transitions += 0.05 * move / np.sqrt(square_t)
    return Field(weights, transitions)


class Labeller:
    """Labels batches of texts; keeps the scores of the words it has met, up to CACHED_WORDS."""

    def __init__(self, field: Field):
        self.field = field
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, N), np.float32)
        self.chars = np.zeros(1024, np.int64)

    def _lookup(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = list(dict.fromkeys(words[i] for i in np.nonzero(at < 0)[0]))
        if not new:
            return at
        base = len(self.index)
        lists = [word_features(w.lower()) for w in new]
        size = np.array([len(x) for x in lists])
        flat = np.concatenate([np.array(x) for x in lists])
        while base + len(new) > len(self.scores):
            self.scores, self.chars = np.vstack([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.scores[base : base + len(new)] = np.add.reduceat(self.field.weights[flat], np.cumsum(size) - size, axis=0)
        self.chars[base : base + len(new)] = [len(w) for w in new]
        self.index.update((w, base + i) for i, w in enumerate(new))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str], parts: bool) -> tuple[np.ndarray, list[list[tuple[int, int, int, float]]]]:
        """Shares of the languages in each text by characters (all 0 without words); parts as (start, end, language, confidence)."""
        if len(self.index) > CACHED_WORDS:
            self.reset()
        texts = [readable(t) for t in texts]
        found = [WORD.findall(t) for t in texts]
        words_of = np.array([len(w) for w in found], np.int64)
        at = self._lookup([w for words in found for w in words])
        first = np.cumsum(words_of) - words_of
        stretches = -(-words_of // STRETCH)
        row = np.repeat(np.arange(len(texts)), stretches)
        begin = (np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * STRETCH
        lengths = np.minimum(words_of[row] - begin, STRETCH)
        starts = first[row] + begin
        share = np.zeros((len(texts), N))
        best_of, sure_of = np.zeros(len(at), np.int8), np.zeros((len(at), N) if parts else (0, N), np.float32)
        before, after = np.ones((len(row), N), np.float32), np.ones((len(row), N), np.float32)
        for i in np.nonzero(stretches > 1)[0]:
            own = np.nonzero(row == i)[0]
            at_words = starts[own] + np.minimum(np.arange(STRETCH)[:, None], lengths[own] - 1)
            before[own], after[own] = _context(self.scores[at[at_words]], lengths[own], self.field.transitions)
        order = np.argsort(-lengths, kind="stable")
        lo = 0
        while lo < len(order):
            steps = int(lengths[order[lo]])
            some = order[lo : lo + max(1, 120_000 // steps)]
            lo += len(some)
            n = lengths[some]
            inside = np.arange(steps)[:, None] < n
            source = np.where(inside, starts[some] + np.arange(steps)[:, None], 0)
            words = at[source]
            p = _marginals(self.scores[words], n, self.field.transitions, before[some], after[some])
            weight = np.where(inside, self.chars[words], 0)
            np.add.at(share, row[some], (p * weight[:, :, None]).sum(0))
            if parts:
                best_of[source[inside]], sure_of[source[inside]] = p.argmax(2)[inside], p[inside]
        spans: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for i in np.nonzero(words_of)[0] if parts else ():
            here = slice(first[i], first[i] + words_of[i])
            if (best_of[here] != best_of[first[i]]).any():
                spans[i] = self._parts(texts[i], best_of[here], sure_of[here])
        return share / np.maximum(share.sum(1, keepdims=True), 1e-9), spans

    def _parts(self, text: str, best: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int, float]]:
        cuts = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        runs = [(int(s), int(e), int(best[s])) for s, e in zip(cuts, np.r_[cuts[1:], len(best)], strict=True)]
        kept: list[list[int]] = []
        for s, e, k in runs:
            doubtful = lambda s, e, k: e - s < SHORT_PART and p[s:e, k].mean() < SURE
            if kept and (kept[-1][2] == k or doubtful(s, e, k)):
                kept[-1][1] = e
            elif kept and doubtful(*kept[-1]):
                kept[-1][1], kept[-1][2] = e, k
            else:
                kept.append([s, e, k])
        if len(kept) < 2:
            return []
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        return [(at[s][0], at[e - 1][1], k, float(p[s:e, k].mean())) for s, e, k in kept]


_labellers: dict[int, Labeller] = {}


def _labeller(shared: Any) -> Labeller:
    key = id(shared.value)
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(shared.value)
    return _labellers[key]


def _label(shared: Any, parts: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                share, spans = labeller.label([t or "" for t in b.column("t").to_pylist()], parts)
                best, sure = share.argmax(1), share.max(1)
                language = pa.array([LANGUAGES[k] if s > 0 else None for k, s in zip(best, sure, strict=True)], pa.string())
                columns = [b.column("id"), language, pa.array(np.where(sure > 0, sure, np.nan), from_pandas=True)]
                names = ["id", "language", "confidence"]
                if parts:
                    columns.append(pa.array([[{"start": s, "end": e, "language": LANGUAGES[k], "confidence": c} for s, e, k, c in x] for x in spans], kind))
                    names.append("parts")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def train_on(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> Field:
    """A field trained on ``sample`` documents, the first in the order of a hash of their ids."""
    long = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.length("t") >= 200)
    return train([r.t for r in hashed_sample(long, ["i"], sample, df.count())])


def label_languages(df: DataFrame, id_col: str, text_col: str, field: Field, parts: bool = False) -> DataFrame:
    """``id, language, confidence`` (and ``parts``) of every row with an id.

    ``language`` is what most of the text's letters are in, ``confidence`` the probability-weighted share of them;
    both are null for a text without letters (null, empty, blank, digits or addresses only). ``parts`` lists the runs of a text in
    several languages as start, end, language and confidence, and is empty for a text in one. Whole texts are read.
    Repeated rows come out as often as they go in; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString() if isinstance(id_col, str) else "string"
    schema = f"id {kind}, language string, confidence double" + (", parts array<struct<start: int, end: int, language: string, confidence: double>>" if parts else "")
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    return src.mapInArrow(_label(spark.sparkContext.broadcast(field), parts), schema)


def named_language(value: Column) -> Column:
    """The language that a metadata value names: one of LANGUAGES, 'other', or null if it names none.

    Codes of ISO 639-1 and 639-2, with or without regional tags, and English names count, in any case.
    """
    first = F.lower(F.regexp_extract(F.trim(F.coalesce(value, F.lit(""))), r"^([\p{L}]+)(?:$|[-_ (])", 1))
    out = F.when(first.isin(*CODES_2, *CODES_3, *NAMES), F.lit("other"))
    for lang, names in reversed(NAMED.items()):
        out = F.when(first.isin(*names.split()), F.lit(lang)).otherwise(out)
    return out


def wrong_labels(documents: DataFrame, chunks: DataFrame, field: Field, exclude: DataFrame, min_chars: int = 200) -> DataFrame:
    """``doc_id, kind, chunk_index, language, confidence`` of documents and chunks whose language isn't what is claimed.

    ``missing``: the metadata's ``language`` is absent, null or names none; ``wrong``: it names another than most of
    the text is in (both with chunk_index -1); ``segment``: a chunk of ``min_chars`` or more that is mostly in another
    language than its document. Documents under ``min_chars`` and those whose doc_id is in ``exclude`` are left out.
    """
    claimed = named_language(F.try_variant_get(F.try_parse_json(F.col("document_metadata").cast("string")), "$.language", "string"))
    docs = documents.where(F.length("text") >= min_chars).join(exclude.select("doc_id").distinct(), "doc_id", "left_anti")
    key = F.struct("doc_id", F.col("id").alias("document_id"), claimed.alias("claimed"))
    labelled = label_languages(docs.select(key.alias("k"), "text"), "k", "text", field).where("language is not null").select("id.*", "language", "confidence")
    labelled = labelled.groupBy("doc_id").agg(F.max_by(F.struct("document_id", "claimed", "language", "confidence"), "confidence").alias("x")).select("doc_id", "x.*")
    whole = labelled.where("claimed is null or claimed <> language").select("doc_id", F.when(F.col("claimed").isNull(), "missing").otherwise("wrong").alias("kind"), F.lit(-1).cast("bigint").alias("chunk_index"), "language", "confidence")
    part_key = F.struct("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"))
    parts = label_languages(chunks.where(F.length("chunk_text") >= min_chars).select(part_key.alias("k"), "chunk_text"), "k", "chunk_text", field).where("language is not null").select("id.*", F.col("language").alias("own"), F.col("confidence").alias("own_confidence"))
    parts = parts.groupBy("document_id", "chunk_index").agg(F.max_by(F.struct("own", "own_confidence"), "own_confidence").alias("x")).select("document_id", "chunk_index", "x.*")
    segments = parts.join(labelled.select("doc_id", "document_id", "language"), "document_id").where("own <> language")
    return whole.unionByName(segments.select("doc_id", F.lit("segment").alias("kind"), "chunk_index", F.col("own").alias("language"), F.col("own_confidence").alias("confidence")))
