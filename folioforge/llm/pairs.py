"""Broken question-answer pairs, by a multi-label linear classifier.

Features are hashed n-grams of the answer's words and dense features of the pair: how the answer ends, how far the
question covers it, and which languages both are in. The classifier learns from a bounded sample of pairs, out of
which it makes truncated, copied, swapped and refused answers itself; thresholds are calibrated on held-out ones.
How words end is counted over the answers of the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.sampling import hashed_sample
from folioforge.llm.wordlists import FUNCTION_WORDS, function_words
from folioforge.session import materialize

LABELS = ("truncated", "refusal", "copies_question", "other_language")
#: Labels that n-grams speak for; a language is only wrong for its question.
USES_GRAMS = np.array([1, 1, 1, 0])
DIMENSIONS = 1 << 15
#: Buckets of the hashed counts of words, which bounds what is sent to the driver and back.
BUCKETS = 1 << 19
STRIPE = 1 << 13
#: Pairs that the classifier is fitted on.
SAMPLE = 4000
#: How many more sound pairs there are to a defective one than among made pairs; thresholds allow for it.
SOUND_WEIGHT = 5.0
FIXED_MESSAGES = ("No relevant documents found.", "No relevant chunks found in the document.")

WORD = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_CLOSERS = "\"'»”’)]}*_`"

#: Names of languages in the languages themselves and in each other.
LANGUAGE_NAMES = {
    "en": "english inglés ingles anglais englisch inglese inglês",
    "de": "german alemán aleman allemand deutsch tedesco alemão alemao",
    "fr": "french francés frances français francais französisch francese francês",
    "es": "spanish español espanol castellano espagnol spanisch spagnolo espanhol",
    "it": "italian italiano italien italienisch italiana",
    "pt": "portuguese portugués portugues portugais portugiesisch portoghese português",
}
_NAMED = {w: lang for lang, names in LANGUAGE_NAMES.items() for w in names.split()}
#: Beginnings of words that ask for an answer.
_ASKING = ("answer", "reply", "respond", "write", "antwort", "schreib", "répon", "repon", "écri", "contest", "escrib", "rispo", "rispond", "scriv", "escrev", "respost", "auf", "in", "en", "em")

#: How models decline, put together as an opening, a refusal and a closing.
REFUSALS = {
    "en": (
        ["", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "Apologies, ", "I apologize, but ", "As a language model, ", "As an AI, ", "Regrettably, "],
        ["I cannot answer this question", "I can't help with that", "I am unable to assist", "I am not able to help with that request", "I have to decline this request", "I must decline to answer", "it is not possible for me to comment on this", "I can't provide that information", "this is something I must not discuss", "I don't have the ability to review this material", "I won't be able to assist with this", "I am not allowed to give this information"],
        ["", "", " at this time", " because it falls outside my guidelines", ". Please consult a professional", ". Is there anything else I can do?", ". You may want to ask the author instead", ". Can I help you with something else?"],
    ),
    "de": (
        ["", "Es tut mir leid, aber ", "Entschuldigung, ", "Leider gilt: ", "Leider ", "Als Sprachmodell gilt: ", "Tut mir leid, "],
        ["diese Frage kann ich nicht beantworten", "dabei kann ich nicht helfen", "ich muss diese Anfrage ablehnen", "ich darf dazu keine Auskunft geben", "ich kann diese Frage nicht beantworten", "dazu kann ich nichts sagen", "ich bin nicht in der Lage, dabei zu helfen"],
        ["", "", ". Bitte wenden Sie sich an eine Fachperson", ". Kann ich sonst etwas tun?", ". Bitte fragen Sie jemand anderen"],
    ),
    "fr": (
        ["", "Je suis désolé, mais ", "Désolé, ", "Pardon, ", "Malheureusement, ", "En tant que modèle de langue, ", "Je regrette, mais "],
        ["je ne peux pas répondre à cette question", "je ne suis pas en mesure d'aider sur ce point", "il m'est impossible de fournir cette information", "je dois refuser cette demande", "je ne peux pas vous aider", "je ne suis pas autorisé à donner cette information"],
        ["", "", ". Veuillez consulter un spécialiste", ". Puis-je aider autrement ?"],
    ),
    "es": (
        ["", "Lo siento, pero ", "Lo siento, ", "Lamentablemente, ", "Perdón, ", "Disculpe, ", "Como modelo de lenguaje, "],
        ["no puedo responder a esta pregunta", "no puedo ayudar con eso", "no estoy autorizado a dar esa información", "debo rechazar esta solicitud", "no me es posible dar esa información", "no soy capaz de ayudar en esto"],
        ["", "", ". Consulte a un especialista", ". ¿Puedo ayudar en otra cosa?"],
    ),
    "it": (
        ["", "Mi dispiace, ma ", "Scusa, ", "Purtroppo ", "Purtroppo, ", "Spiacente, ", "Come modello linguistico, "],
        ["non posso rispondere a questa domanda", "non posso aiutare con questo", "non mi è possibile fornire queste informazioni", "devo rifiutare questa richiesta", "non sono in grado di aiutare", "non sono autorizzato a dare queste informazioni"],
        ["", "", ". Rivolgiti a uno specialista", ". Posso fare altro?"],
    ),
    "pt": (
        ["", "Desculpe, mas ", "Desculpe, ", "Infelizmente, ", "Lamento, mas ", "Sinto muito, mas ", "Como modelo de linguagem, "],
        ["não posso responder a esta pergunta", "não consigo ajudar com isso", "não tenho permissão para dar essa informação", "devo recusar este pedido", "não me é possível fornecer essa informação", "não sou capaz de ajudar"],
        ["", "", ". Consulte um especialista", ". Posso ajudar em outra coisa?"],
    ),
}
#: Phrases before a repeated question, and openings that only look like a refusal.
REPEATS = ["", "", "", "You asked: ", "Question: ", "The question is: ", "Die Frage lautet: ", "Sie fragten: ", "La question est : ", "Vous demandez : ", "La pregunta es: ", "La domanda è: ", "A pergunta é: "]
NEAR_REFUSALS = {
    "en": ["Sorry figures recur in the text: ", "The meeting could not be held. Instead, ", "The board was unable to meet. Instead, ", "The text does not state the exact number. It does say that ", "The text cannot be dated. It says that "],
    "de": ["Der Ausschuss konnte nicht tagen. Stattdessen: ", "Die genaue Zahl nennt der Text nicht. Es heißt aber: ", "Leider fehlen Zahlen im Text, doch es heißt: "],
    "fr": ["Le comité n'a pas pu se réunir. À la place : ", "Le texte ne donne pas le chiffre exact. Il dit toutefois : "],
    "es": ["La junta no pudo reunirse. En su lugar: ", "La cifra exacta no consta en el texto. Sí se lee: "],
    "it": ["Il comitato non ha potuto riunirsi. Invece: ", "Il testo non riporta la cifra esatta. Dice però: "],
    "pt": ["A comissão não pôde se reunir. Em vez disso: ", "O texto não traz o número exato. Diz, porém: "],
}
REPORTED = ['"{r}", the clerk is quoted as saying; the record adds that {a}', 'The note "{r}" was crossed out. {a}', '"{r}", so der Schreiber; im Protokoll steht auch: {a}', '«{r}», a dit le greffier. {a}', '"{r}", dijo el secretario. {a}', '"{r}", ha detto il segretario. {a}', '"{r}", disse o secretário. {a}']
REQUESTS = {
    "en": ["Please answer in English.", "Auf Englisch antworten.", "Responde en inglés.", "Réponds en anglais.", "Rispondi in inglese.", "Responda em inglês."],
    "de": ["Please answer in German.", "Bitte auf Deutsch antworten.", "Responde en alemán.", "Réponse en allemand.", "Rispondi in tedesco.", "Responda em alemão."],
    "fr": ["Reply in French.", "Antworte auf Französisch.", "Contesta en francés.", "Réponds en français.", "Rispondi in francese.", "Responda em francês."],
    "es": ["Give the answer in Spanish.", "Antworte auf Spanisch.", "Responde en español.", "Réponds en espagnol.", "Rispondi in spagnolo.", "Responda em espanhol."],
    "it": ["Answer in Italian.", "Antworte auf Italienisch.", "Responde en italiano.", "Réponds en italien.", "Rispondi in italiano.", "Responda em italiano."],
    "pt": ["Answer in Portuguese.", "Antworte auf Portugiesisch.", "Responde en portugués.", "Réponds en portugais.", "Rispondi in portoghese.", "Responda em português."],
}

_LANGS = tuple(FUNCTION_WORDS)
_FUNCTION = function_words()
_BY_LANGUAGE = [frozenset(FUNCTION_WORDS[x].split()) for x in _LANGS]


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = _hash(word)
        return h


class Languages:
    """Naive Bayes over words and their endings; learns from texts that their function words tell apart."""

    SIZE = 1 << 14

    def __init__(self, texts: list[list[str]], hashes: dict[str, int]):
        counts = np.full((self.SIZE, len(_LANGS)), 0.05)
        for words in texts:
            hits = np.array([sum(w in own for w in words) for own in _BY_LANGUAGE])
            best = int(hits.argmax())
            if hits[best] >= 4 and hits[best] > 1.5 * np.sort(hits)[-2]:
                np.add.at(counts[:, best], self._features(words, hashes), 1)
        share = counts / counts.sum(0)
        self.odds = np.clip(np.log(share) - np.log(share).mean(1, keepdims=True), -3, 3).astype(np.float32)
        # Buckets that were never seen tell nothing.
        self.odds[counts.sum(1) < 2] = 0

    def _features(self, words: list[str], hashes: dict[str, int]) -> np.ndarray:
        return np.fromiter((hashes[x] & (self.SIZE - 1) for w in words if not w.isdigit() for x in (w, "~" + w[-3:])), np.int64)

    def scores(self, words: list[str], hashes: dict[str, int]) -> np.ndarray:
        """Log odds of the languages, up to a constant; all 0 for no words."""
        return self.odds[self._features(words, hashes)].sum(0) / 1.5 if words else np.zeros(len(_LANGS), np.float32)


def requested_language(question: str) -> str | None:
    """The language that a question asks to be answered in, by its last sentence, or None."""
    last = re.split(r"(?<=[.?!])\s+", question.strip())[-1].lower()
    words = WORD.findall(last)
    for k, w in enumerate(words):
        if w in _NAMED and any(x.startswith(_ASKING) for x in words[max(0, k - 3) : k]) and len(words) <= 12:
            return _NAMED[w]
    return None


def is_empty(answer: str | None) -> bool:
    """Whether there is no letter or digit besides a code fence."""
    return answer is None or not any(ch.isalnum() for ch in re.sub(r"```[a-zA-Z]*", " ", answer))


def plain(answer: str) -> tuple[str, int]:
    """An answer's readable text, and its form: 0 text, 1 a closed fence or JSON, 2 one that isn't closed."""
    body = answer.strip()
    if not body.startswith(("```", "{", "[{")):
        return body, 0
    closed = not body.startswith("```") or (len(body) > 3 and body.endswith("```"))
    inner = _FENCE.sub("", body)
    try:
        value = json.loads(inner, strict=False)
    except ValueError:
        return re.sub(r'["{}\[\]]|\\n', " ", inner), 2

    def strings(x: Any) -> Iterator[str]:
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            for v in x.values():
                yield from strings(v)
        elif isinstance(x, list):
            for v in x:
                yield from strings(v)

    return ". ".join(strings(value)), 1 if closed else 2


DENSE = 30


@dataclass
class Lexicon:
    """Hashed counts over all answers: how often a word occurs, ends a sentence or line, or begins a longer word."""

    seen: np.ndarray
    last: np.ndarray
    begun: np.ndarray
    languages: Languages | None = None


def pair_features(question: str, answer: str, finish: str | None, lexicon: Lexicon, hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Dense features, and the hashed n-grams of the answer's words (distinct, to be weighted by one over their root)."""
    text, form = plain(answer)
    words = WORD.findall(text.lower())
    asked = WORD.findall(question.lower())
    n = len(words)
    d = np.zeros(DENSE, np.float32)
    tail = text.rstrip().rstrip(_CLOSERS).rstrip()
    end = tail[-1:] if tail else ""
    terminal = end in ".!?…。"
    lines = [x for x in text.split("\n") if x.strip()]
    bullets = bool(lines) and all(re.match(r"\s*(?:[-*•]|\d+[.)])\s", x) for x in lines)
    last = words[-1] if words else ""
    at = hashes[last] & (BUCKETS - 1)
    seen, ends = float(lexicon.seen[at]), float(lexicon.last[at])
    ending = ends / seen if seen else 0.0
    numeric = last.isdigit()
    if numeric:
        seen, ending = max(seen, 50.0), max(ending, 0.5)
    open_text = form == 0 and not terminal
    d[0] = 1
    d[1], d[2], d[3] = terminal, form == 2, form == 1
    d[4] = bullets
    begun = float(lexicon.begun[at])
    # A word that is hardly seen whole, but often at the beginning of longer ones, and ends nothing elsewhere.
    open_end = max(0.0, 1 - ending * 5)
    cut_word = 0.0 if numeric else begun / (begun + 20 * seen + 3) * open_end
    d[5] = open_text and not bullets
    loose = open_text and bullets
    d[6] = loose * (seen >= 20) * max(0.0, 1 - ending * 20)  # a common word that hardly ever ends anything
    d[7] = loose * cut_word
    d[8] = loose * (last in _FUNCTION) * open_end
    d[9] = loose * (cut_word > 0.5)
    d[10], d[11] = finish == "length", finish == "stop"
    d[12] = end in ",:;-–(" and bool(end)
    d[13] = text.count('"') % 2 or text.count("(") > text.count(")")
    # How far the question covers the answer: what stands before its first and after its last repetition.
    m = len(asked)
    before = after = n
    inner = 0
    if m and n >= m:
        k, stop = 0, -1
        while k <= n - m:
            if words[k] == asked[0] and words[k : k + m] == asked:
                if stop < 0:
                    before = k
                else:
                    inner += k - stop
                k = stop = k + m
            else:
                k += 1
        after = n - stop if stop >= 0 else n
    elif m and n and n * 2 >= m and words == asked[:n]:
        before = after = 0
    contained = after < n or (n > 0 and before == 0 and after == 0)
    d[14] = contained
    d[15] = contained and after == 0 and before <= 5 and inner == 0
    d[16] = contained and after > 0
    overlap = len(set(words) & set(asked)) / max(1, len(set(words)))
    d[17] = overlap
    d[18] = d[15] and before == 0
    # Languages.
    wanted = requested_language(question)
    if wanted:
        body = re.split(r"(?<=[.?!])\s+", question.strip())
        asked = WORD.findall(" ".join(body[:-1]).lower()) or asked
    if lexicon.languages is not None:
        ours, theirs = lexicon.languages.scores(asked, hashes), lexicon.languages.scores(words, hashes)
        q_lang, a_lang = int(ours.argmax()), int(theirs.argmax())
        margin = float(theirs[a_lang] - theirs[q_lang])
        sure = float(ours[q_lang] - np.sort(ours)[-2])
        fits = wanted is not None and a_lang == _LANGS.index(wanted)
        d[19] = min(1.0, margin / 15) * (not fits) * min(1.0, sure / 3)
        d[20] = margin > 4 and sure > 1 and not fits
        d[21] = margin > 10 and sure > 2 and not fits
        d[22] = fits and margin > 2
        d[23] = a_lang == q_lang
    d[24] = min(1.0, np.log1p(n) / 6)
    d[25] = n <= 3
    d[26] = n <= 12
    d[27] = n > 30
    d[28] = min(1.0, len(text) / 300)
    d[29] = d[5] * d[16]
    if not n:
        return d, np.zeros(0, np.int64)
    h = np.fromiter((hashes[w if not w.isdigit() else "0"] for w in words), np.uint64, n)
    grams = [h]
    if n > 1:
        two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        grams.append(two ^ (two >> np.uint64(31)))
    if n > 2:
        three = (h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:]
        grams.append(three ^ (three >> np.uint64(29)))
    return d, np.unique(np.concatenate(grams) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


class Rows:
    """Feature rows of many pairs: dense, and n-grams as one flat array."""

    def __init__(self, pairs: list[tuple[str, str, str | None]], lexicon: Lexicon, hashes: dict[str, int]):
        made = [pair_features(q, a, f, lexicon, hashes) for q, a, f in pairs]
        self.dense = np.array([d for d, _ in made], np.float32).reshape(len(made), DENSE)
        size = np.array([len(g) for _, g in made], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.concatenate([g for _, g in made]) if made else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(made)), size)
        self.value = (1 / np.sqrt(np.maximum(size, 1)))[self.row].astype(np.float32)

    def scores(self, w_dense: np.ndarray, w_grams: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Log odds of each label for rows lo to hi, shape (rows, labels)."""
        hi = len(self.dense) if hi is None else hi
        part = slice(self.ends[lo], self.ends[hi])
        out = self.dense[lo:hi] @ w_dense
        for k in range(w_grams.shape[1]):
            out[:, k] += np.bincount(self.row[part] - lo, w_grams[self.flat[part], k] * self.value[part], hi - lo)
        return out


@dataclass
class Classifier:
    w_dense: np.ndarray
    w_grams: np.ndarray
    thresholds: np.ndarray
    lexicon: Lexicon

    def decide(self, pairs: list[tuple[str, str, str | None]], hashes: dict[str, int]) -> list[str | None]:
        """The defect of each pair, or None: a refusal or a copy before others, else the one farthest above its threshold."""
        if not pairs:
            return []
        over = Rows(pairs, self.lexicon, hashes).scores(self.w_dense, self.w_grams) - self.thresholds
        best = np.where(over[:, 1] > 0, 1, np.where(over[:, 2] > 0, 2, over.argmax(1)))
        return [LABELS[k] if over[i, k] > 0 else None for i, k in enumerate(best)]


def _train(rows: Rows, y: np.ndarray, epochs: int, batch: int = 512, rate: float = 0.08, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all labels, by Adam on batches in the order of the rows."""
    w = [np.zeros((DENSE, len(LABELS)), np.float32), np.zeros((DIMENSIONS, len(LABELS)), np.float32)]
    mean, square = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        for lo in range(0, len(y), batch):
            hi = min(lo + batch, len(y))
            step += 1
            part = slice(rows.ends[lo], rows.ends[hi])
            error = (1 / (1 + np.exp(-np.clip(rows.scores(*w, lo, hi), -30, 30))) - y[lo:hi]) / (hi - lo)
            error[:, 3] *= y[lo:hi, 1] == 0  # a refusal may be in any language
            at = rows.row[part] - lo
            grams = np.stack([np.bincount(rows.flat[part], error[at, k] * rows.value[part], DIMENSIONS) for k in range(len(LABELS))], 1)
            grams *= USES_GRAMS
            for x, m, s, g in zip(w, mean, square, (rows.dense[lo:hi].T @ error, grams), strict=True):
                g = (g + decay * x).astype(np.float32)
                m *= 0.9
                m += 0.1 * g
                s *= 0.995
                s += 0.005 * g * g
                x -= rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-7)
    return w[0], w[1]


def refusal(rng: np.random.Generator, lang: str) -> str:
    """One way to decline."""
    opening, core, closing = ([x[int(rng.integers(len(x)))] for x in REFUSALS[lang]])
    text = opening + core + closing
    if rng.random() < 0.15:
        other = REFUSALS[lang][1][int(rng.integers(len(REFUSALS[lang][1])))]
        text = text.rstrip(".?!") + "." + ("\n" if rng.random() < 0.3 else " ") + other[0].upper() + other[1:]
    text = text[0].upper() + text[1:]
    return text if text[-1] in ".?!" else text + "."


def synthetic(base: list[tuple[str, str, str | None]], lexicon: Lexicon, hashes: dict[str, int], rng: np.random.Generator) -> tuple[list[tuple[str, str, str | None]], np.ndarray]:
    """Made pairs and their labels, out of pairs that are sound for the most part."""
    pairs: list[tuple[str, str, str | None]] = []
    labels: list[int] = []
    langs = [int(s.argmax()) if np.sort(s)[-1] - np.sort(s)[-2] > 3 else -1 for s in (lexicon.languages.scores(WORD.findall(plain(a)[0].lower()), hashes) for _, a, _ in base)]
    by_lang: dict[int, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    known = [k for k in by_lang if k >= 0]

    def add(q: str, a: str, f: str | None, label: int) -> None:
        pairs.append((q, a, f))
        labels.append(label)

    def finish(f: str | None) -> str | None:
        return "length" if rng.random() < 0.15 else f

    for i, (q, a, f) in enumerate(base):
        lang = _LANGS[langs[i]] if langs[i] >= 0 else "en"
        add(q, a, f, -1)
        u = rng.random()
        if len(a) > 30:
            at = int(rng.integers(int(len(a) * 0.15) + 8, max(int(len(a) * 0.15) + 9, len(a) - 4)))
            cut = a[:at].rstrip()
            # A list that ends with a whole word may be complete; it is cut off for certain within a word or before a further one.
            whole = a[0] in "-*•" and not (cut[-1:].isalnum() and a[at : at + 1].isalnum()) and WORD.findall(cut.lower())[-1:] != [] and WORD.findall(cut.lower())[-1] not in _FUNCTION
            if not whole and (not cut.rstrip(_CLOSERS).endswith((".", "!", "?")) or cut.startswith("```")):
                add(q, cut, finish(f), 0)
        if u < 0.3:
            add(q, refusal(rng, lang), f, 1)
        elif u < 0.6:
            add(q, refusal(rng, _LANGS[int(rng.integers(len(_LANGS)))]), f, 1)
        elif u < 0.8 and a[0] not in "-`{":
            quoted = REPORTED[int(rng.integers(len(REPORTED)))].format(r=refusal(rng, lang).rstrip("."), a=a)
            opened = NEAR_REFUSALS[lang][int(rng.integers(len(NEAR_REFUSALS[lang])))] + a
            add(q, quoted if rng.random() < 0.5 else opened, f, -1)
        v = rng.random()
        if v < 0.5:
            bare = q.strip()
            made = (bare, f'"{bare}"', bare.lower(), bare.rstrip(" ?.!"), f"{bare} {bare}", f"{bare}\n\n{bare}", f"**{bare}**")[int(rng.integers(7))]
            add(q, REPEATS[int(rng.integers(len(REPEATS)))] + made, f, 2)
        elif v < 0.8:
            add(q, q.strip() + (" ", "\n", "\n\n")[int(rng.integers(3))] + a, f, -1)
        if langs[i] >= 0 and len(known) > 1:
            other = known[int(rng.integers(len(known)))]
            if other != langs[i]:
                swapped = base[by_lang[other][int(rng.integers(len(by_lang[other])))]][1]
                if rng.random() < 0.65:
                    add(q, swapped, f, 3)
                else:
                    ask = REQUESTS[_LANGS[other]]
                    add(f"{q.strip()} {ask[int(rng.integers(len(ask)))]}", swapped, f, -1)
    y = np.zeros((len(pairs), len(LABELS)), np.float32)
    for i, k in enumerate(labels):
        if k >= 0:
            y[i, k] = 1
    return pairs, y


def fit(sample: list[tuple[str, str, str | None]], lexicon: Lexicon, seed: int = 5) -> Classifier:
    """Fits on made pairs, drops sample pairs that look broken themselves, fits again, and calibrates thresholds.

    A threshold is the middle of the range in which the held-out pairs' F-measure is highest.
    """
    hashes = _Hashes()
    rng = np.random.default_rng(seed)
    usable = [x for x in sample if not is_empty(x[1])]
    languages = Languages([WORD.findall(plain(a)[0].lower()) for _, a, _ in usable] + [WORD.findall(q.lower()) for q, _, _ in usable], hashes)
    lexicon = Lexicon(lexicon.seen, lexicon.last, lexicon.begun, languages)
    base = [x for x in usable if x[2] != "length"]
    thresholds = np.full(len(LABELS), np.inf)
    w = np.zeros((DENSE, len(LABELS)), np.float32), np.zeros((DIMENSIONS, len(LABELS)), np.float32)
    for epochs in (3, 8):
        if not base:
            break
        pairs, y = synthetic(base, lexicon, hashes, rng)
        order = rng.permutation(len(pairs))
        pairs, y = [pairs[i] for i in order], y[order]
        cut = int(len(pairs) * 0.8)
        w = _train(Rows(pairs[:cut], lexicon, hashes), y[:cut], epochs)
        if epochs == 3:
            scores = Rows(base, lexicon, hashes).scores(*w)
            base = [x for x, s in zip(base, scores, strict=True) if s.max() < -1]
            continue
        scores, truth = Rows(pairs[cut:], lexicon, hashes).scores(*w), y[cut:] > 0
        for k in range(len(LABELS)):
            o = np.argsort(-scores[:, k])
            o = o[~truth[o, 1]] if k == 3 else o
            hit = truth[o, k]
            found, wrong = np.cumsum(hit), np.cumsum(~hit) * SOUND_WEIGHT
            f1 = 2 * found / np.maximum(1, found + wrong + truth[:, k].sum())
            if not len(f1) or not hit.any():
                continue
            good = np.nonzero(f1 >= f1.max() - 1e-9)[0]
            beyond = scores[o[min(good[-1] + 1, len(o) - 1)], k]
            thresholds[k] = np.clip((scores[o[good[-1]], k] + beyond) / 2, -2, 3)
    return Classifier(w[0], w[1], thresholds, lexicon)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers within results, in all shapes a worker writes them."""
    for b in batches:
        out: dict[str, list[Any]] = {"job_id": [], "answer_no": [], "answer": [], "finish": []}
        for job, data in zip(b.column("job_id").to_pylist(), b.column("data").to_pylist(), strict=True):
            value: Any = data
            for _ in range(3):
                if not isinstance(value, str):
                    break
                try:
                    value = json.loads(value, strict=False)
                except ValueError:
                    value = None
            if not isinstance(value, dict):
                continue
            if isinstance(value.get("results"), list):
                found = [x.get("llm_response") if isinstance(x, dict) else None for x in value["results"]]
            elif "result" in value:
                found = [value["result"]]
            elif set(value) == {"content"} and value["content"] in FIXED_MESSAGES:
                continue
            else:
                found = [value]
            for k, r in enumerate(found):
                r = r if isinstance(r, dict) else {"content": r if isinstance(r, str) else None}
                content, meta = r.get("content"), r.get("metadata")
                reason = meta.get("finish_reason") if isinstance(meta, dict) else None
                out["job_id"].append(job)
                out["answer_no"].append(k)
                out["answer"].append(content if isinstance(content, str) else None if content is None else json.dumps(content, ensure_ascii=False))
                out["finish"].append(reason if isinstance(reason, str) else None)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("job_id", pa.string()), ("answer_no", pa.int64()), ("answer", pa.string()), ("finish", pa.string())]))


def answer_pairs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``job_id, answer_no, question, answer, finish`` for every answer to a question.

    Jobs whose data is null, not JSON or without a question, and the worker's fixed messages, give none. Older
    versions of a job and repeated rows count once. An answer is null where its content is.
    """
    question = F.try_variant_get(F.try_parse_json(F.col("data").cast("string")), "$.question", "string")
    asked = jobs.select(F.col("id").cast("string").alias("job_id"), question.alias("question")).where("job_id is not null and length(trim(question)) > 0").groupBy("job_id").agg(F.max("question").alias("question"))
    found = results.select(F.col("job_id").cast("string").alias("job_id"), F.col("data").cast("string").alias("data")).where("job_id is not null and data is not null")
    answers = found.join(asked.select("job_id"), "job_id", "left_semi").mapInArrow(_answers, "job_id string, answer_no bigint, answer string, finish string")
    once = answers.groupBy("job_id", "answer_no").agg(F.max(F.struct(F.coalesce("answer", F.lit("")), "answer", "finish")).alias("x")).select("job_id", "answer_no", "x.answer", "x.finish")
    return asked.join(once, "job_id").select("job_id", "answer_no", "question", "answer", "finish")


_SEGMENT_END = re.compile(r"(?<![^\W_])([^\W_]++)[\"'»”’)\]]*+(?:[.!?…]|\n|$)")


def _count_words(texts: list[str], hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of BUCKETS entries each, of the fields of a Lexicon."""
    words, last = Counter[str](), Counter[str]()
    for t in texts:
        words.update(WORD.findall(t))
        # The last word of a whole answer tells nothing: it may be cut off. That of an inner line or sentence does.
        last.update(_SEGMENT_END.findall(t)[: None if t.rstrip()[-1:] in ".!?" else -1])
    begun = Counter[str]()
    for w, n in words.items():
        for k in range(2, min(len(w), 24)):
            begun[w[:k]] += n
    out = []
    for counts in (words, last, begun):
        at = np.fromiter((hashes[w] & (BUCKETS - 1) for w in counts), np.int64, len(counts))
        out.append(np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS))
    return out[0], out[1], out[2]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, BUCKETS))
    hashes = _Hashes()
    for b in batches:
        total += _count_words([plain(t)[0].lower() for t in b.column("answer").to_pylist() if t], hashes)
    at = np.nonzero(total.any(0))[0]
    yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[0, at].astype(np.int64), "ends": total[1, at].astype(np.int64), "begins": total[2, at].astype(np.int64)})


def _dense(t: pa.Table) -> pa.Table:
    """One stripe of buckets as arrays of a fixed length, whatever has been counted."""
    stripe = t.column("stripe")[0].as_py()
    out = np.zeros((3, STRIPE), np.float32)
    for k, name in enumerate(("n", "ends", "begins")):
        out[k, t.column("bucket").to_numpy() - stripe * STRIPE] = t.column(name).to_numpy()
    return pa.table({"stripe": pa.array([stripe], pa.int64()), "counts": pa.array([out.tobytes()], pa.binary())})


def word_endings(pairs: DataFrame) -> Lexicon:
    """Counts over all answers, hashed into BUCKETS, so that their size is bounded."""
    counts = pairs.select("answer").where("answer is not null").mapInArrow(_word_counts, "bucket bigint, n bigint, ends bigint, begins bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("begins").alias("begins"))
    stripes = counts.withColumn("stripe", F.floor(F.col("bucket") / STRIPE)).groupBy("stripe").applyInArrow(_dense, "stripe bigint, counts binary")
    out = np.zeros((3, BUCKETS), np.float32)
    for r in stripes.collect():
        out[:, r.stripe * STRIPE : (r.stripe + 1) * STRIPE] = np.frombuffer(r.counts, np.float32).reshape(3, STRIPE)
    return Lexicon(*out)


def _score(shared: Any):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        hashes = _Hashes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                q, a, f = (b.column(c).to_pylist() for c in ("question", "answer", "finish"))
                empty = [is_empty(x) for x in a]
                full = [i for i, e in enumerate(empty) if not e]
                defect: list[str | None] = ["empty" if e else None for e in empty]
                for i, k in zip(full, model.decide([(q[i], a[i], f[i]) for i in full], hashes), strict=True):
                    defect[i] = k
                yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("answer_no"), pa.array(defect, pa.string())], ["job_id", "answer_no", "defect"])

    return run


def defective_pairs(jobs: DataFrame, results: DataFrame, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """``job_id, answer_no, defect`` of every pair: empty, truncated, refusal, copies_question, other_language or null.

    The classifier is fitted on ``sample`` pairs (the bound), the first in the order of a hash of their keys; counts of
    words cover all answers. No pair has two defects. Pairs are those of answer_pairs(). Empty tables give no rows;
    other columns are ignored, whatever their names.
    """
    spark = jobs.sparkSession
    pairs = materialize(answer_pairs(jobs, results), "pairs")
    lexicon = word_endings(pairs)
    chosen = hashed_sample(pairs.where("answer is not null"), ["job_id", "answer_no"], sample, pairs.count())
    model = fit([(r.question, r.answer, r.finish) for r in chosen], lexicon, seed)
    return pairs.mapInArrow(_score(spark.sparkContext.broadcast(model)), "job_id string, answer_no bigint, defect string")
