"""Defective prompt and response pairs: empty, copied, refused, truncated or in another language.

A multi-label linear classifier reads hashed word n-grams of the response (names and figures masked) and graded
features of the pair: how many letters and digits, how much of the response is the question and what is left, shared
words, the end's log-odds of :mod:`ledgerloom.llm.truncation`, and how far a sentence is in another language. It is
trained on the table's own responses, made defective on purpose: cut at random places, replaced by the question in
its disguises, swapped for a response to a question in another language, refused, or emptied.

Only a few general refusals are given. More are mined from the table: where most responses to questions of a form
state a figure, those without one that are whole and in the question's language mostly decline. Responses that a
first classifier suspects leave the clean examples of a second. Thresholds are set per label on held-out examples, where
recall counts four times as much as precision if an exact check follows: for refusals none does, and the threshold lies in the
emptiest place between the scores of all the table's responses and those of the made ones. What the classifier
flags as empty, copied, truncated or in another language is checked exactly; each pair has the first defect that applies.

The classifier is fitted on ``SAMPLE`` pairs and ``MINED`` candidates of refusals drawn by the hash of their id; every
pair is judged. The refusals' threshold and the cuts of truncation, per language and field, come from all pairs.

Defined results: a null or blank response is empty; a null or blank question can't be copied and has no
language to differ from; a null ``expected_refusal`` expects none; repeated rows are judged each; an empty table
gives an empty result; extra columns are ignored; a response of millions of characters is read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.quantities import LANGUAGE_WORDS, language
from ledgerloom.llm import truncation as T
from ledgerloom.session import checkpointed

LABELS = ("empty", "copy", "refusal", "truncated", "other_language")
SAMPLE, MINED, BITS, STEPS, RATE, DECAY = 2000, 4000, 16, 60, 0.7, 2e-5
FIGURED = 0.5  # share of a form's responses with a figure from which one without is a candidate of a refusal
FOLDS, SURE = 4, 1.5  # log-odds from which a candidate is taken for a refusal
ODDS = 5  # place of the end's log-odds among the pair features
FINE = 64  # bins of refusal scores a unit, over all rows
DENSE = 10
SUSPECT, SUSPICION = 0.1, 0.0  # weight of the table's own texts against refusals, and score of a suspect, in the first round
_SPECIAL = re.compile(r"<\|[a-z_]+\|>")
_ALNUM = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_PLAIN = re.compile(r"[^\W\d_]+")

# General refusals by language, the seed of those mined; {n} is a name from the question.
REFUSALS = {
    "en": (["", "", "Sorry, ", "Unfortunately, "], ["I do not know.", "I don't know the answer.", "I cannot answer this question.", "I am unable to answer that.", "not enough information.", "I cannot help with that.", "the text does not answer this question.", "no information about {n} is available."]),
    "fr": (["", "Désolé, ", "Malheureusement, "], ["je ne sais pas.", "je ne peux pas répondre à cette question.", "le contexte ne permet pas de répondre.", "aucune réponse ne peut être donnée sur {n}.", "l'extrait ne dit rien sur {n}.", "le document ne donne pas cette information.", "les informations sont insuffisantes."]),
    "de": (["", "Leider ", "Entschuldigung, "], ["weiß ich es nicht.", "ich kann diese Frage nicht beantworten.", "der Auszug sagt nichts über {n}.", "dazu liegen keine Angaben vor.", "die Angaben reichen nicht aus.", "lässt sich das aus dem Kontext nicht beantworten.", "zu {n} gibt es im Text keine Antwort."]),
    "es": (["", "Lo siento, ", "Lamentablemente, "], ["no lo sé.", "no puedo responder a esta pregunta.", "el contexto no dice nada sobre {n}.", "no hay información suficiente.", "no se puede responder con el texto dado.", "el extracto no menciona {n}.", "la respuesta no figura en el documento."]),
}


# Further words that tell languages apart, besides the frequent ones: months, scales, units, periods, verbs and short words.
LANGUAGE_CUES = {
    "en": "a an this these there were was has had have be been are or if no it we they than more less about over under after before during because due main reason see item year fiscal million billion thousand dollars percent shares richer mix fell rose reached total company report",
    "de": "im am zum zur vom aus bei über unter nach durch wurde wurden wird hat haben sind war waren sich auch nicht kein keine einer einem einen oder aber wie als zu an erreichte erreichten betrug betrugen stieg stiegen sank sanken lag lagen belief erzielte meldete geschäftsjahr jahr jahre milliarde milliarden millionen tausend prozent basispunkte "
    "aktien quadratmeter tonnen umsatz umsätze erlöse gewinn verlust ergebnis höhere niedrigere geringere grund hauptgrund aufgrund infolge gegenüber vorjahr januar februar märz mai juni juli oktober dezember unternehmen gesellschaft bericht",
    "fr": "au aux ce cette ces son sa ses leur est sont ont avait avaient fut ne pas plus moins sur sous selon entre depuis donc ou où il elle ils d'un d'une s'est s'élève exercice année année fiscale milliard milliards millions mille cent actions mètres carrés tonnes chiffre d'affaires bénéfice perte résultat hausse baisse augmenté "
    "diminué atteignait atteignent élevé raison principale janvier février mars avril mai juin juillet août septembre octobre novembre décembre société entreprise rapport",
    "es": "al del este esta estos su sus es son fue fueron ha han había no más menos sobre según entre desde pero o como lo le alcanzó alcanzaron ascendió ascendieron registró aumentó disminuyó creció cayó subió bajó año fiscal ejercicio mil millones millón miles por ciento dólares acciones metros cuadrados toneladas ventas ingresos beneficio "
    "pérdida resultado mayor mayores menor menores causa motivo principal debido enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre empresa compañía sociedad informe",
}
# Letters that only one of the languages writes; they count in words that begin with a small letter, as names keep theirs.
LANGUAGE_LETTERS = {"de": "äöüß", "fr": "àâçèêëîïœùû", "es": "ñáíóú"}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
_plain_letters = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
_EVIDENCE: dict[str, set[str]] = {}
for _k in LANGUAGE_WORDS:
    for _w in f"{LANGUAGE_WORDS[_k]} {LANGUAGE_CUES[_k]}".split():
        for _v in {_w, _w.translate(_UMLAUTS) if _k == "de" else _w if len(_w) < 4 else _plain_letters(_w)}:
            _EVIDENCE.setdefault(_v, set()).add(_k)


def language_evidence(text: str) -> dict[str, int]:
    """How many words of a text speak for each language, by the word or by its letters."""
    hits = dict.fromkeys(LANGUAGE_WORDS, 0)
    for w in _WORD.findall(text):
        low = w.lower()
        of = _EVIDENCE.get(low)
        if of is None and not w.isascii() and w == low:
            of = {k for k, letters in LANGUAGE_LETTERS.items() if any(c in letters for c in low)}
        for k in of or ():
            hits[k] += 1
    return hits


class Example(NamedTuple):
    """A response to a question, with the log-odds of its end."""

    question: str
    response: str
    odds: float


class Model(NamedTuple):
    """Weights of n-grams and of pair features, and a threshold, for each label; held-out scores of made refusals."""

    grams: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray
    refused: np.ndarray


def bare(response: str | None) -> str:
    """The response without special tokens."""
    return _SPECIAL.sub(" ", response or "")


def is_empty(response: str | None) -> bool:
    """No letter or digit besides special tokens."""
    return not _ALNUM.search(bare(response))


def foreign(question: str | None, response: str | None) -> float:
    """By how many words the response's most foreign sentence is in another language than the question's."""
    if not question or not question.strip() or not response:
        return 0.0
    own, most = _question(question)[2], 0
    for s in _SENTENCE.split(bare(response)):
        hits = language_evidence(s)
        mine = hits.pop(own)
        most = max(most, max(hits.values()) - mine)
    return float(most)


def _mask(token: str) -> str:
    if token[0].isdigit():
        return "9"
    return "N" if len(token) > 3 and token[0].isupper() and token[1:].islower() and token.lower() not in _COMMON else token.lower()


# Capitalised words that begin sentences and are no names.
_COMMON = frozenset("sorry unfortunately regrettably this that there these nothing insufficient unable please with the what which when where does management demand because under while main reason reasons named question answer filing context not disclosed stated enough leider entschuldigung bitte désolé malheureusement lamentablemente consulte veuillez dazu".split())
_seen: dict[str, int] = {}


def _token_id(token: str) -> int:
    v = _seen.get(token)
    if v is None:
        if len(_seen) > 500_000:
            _seen.clear()
        v = _seen[token] = zlib.crc32(_mask(token).encode()) & 0x7FFFFFFF
    return v


def gram_slots(responses: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owner) of the words, pairs and triples of words of the responses, their ends marked."""
    ids, sizes = [], []
    for r in responses:
        own = [_token_id(t) for t in _TOKEN.findall(bare(r))]
        ids += [1, *own, 2]
        sizes.append(len(own) + 2)
    a = np.array(ids, dtype=np.uint64)
    owner = np.repeat(np.arange(len(responses)), sizes)
    prime, shift, out, who = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS), [], []
    v = np.zeros(len(a), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 4):
            v = v[: len(a) - n + 1] * np.uint64(1000003) + a[n - 1 :]
            whole = owner[: len(v)] == owner[n - 1 :]
            out.append(((v[whole] + np.uint64(n)) * prime >> shift).astype(np.int32))
            who.append(owner[: len(v)][whole])
    return np.concatenate(out), np.concatenate(who)


_asked: dict[str, tuple[str, frozenset, str]] = {}


def _question(q: str) -> tuple[str, frozenset, str]:
    """(letters and digits, words, language) of a question."""
    v = _asked.get(q)
    if v is None:
        if len(_asked) > 100_000:
            _asked.clear()
        v = _asked[q] = (T._same(q), frozenset(_PLAIN.findall(q.lower())), language(q))
    return v


class Facts(NamedTuple):
    """Graded features of pairs, a row each, and what the exact checks ask: whether the response is empty or a copy, and by how many words it is foreign."""

    features: np.ndarray
    empty: np.ndarray
    copy: np.ndarray
    strange: np.ndarray


def pair_facts(questions: list[str], responses: list[str], odds: list[float] | None = None) -> Facts:
    """Features and facts of pairs, each text read once."""
    n = len(responses)
    out, empty, copy, strange = np.zeros((n, DENSE), dtype=np.float32), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n)
    for i, (question, response) in enumerate(zip(questions, responses, strict=True)):
        r = bare(response) if response and "<|" in response else response or ""
        q, asked, _ = _question(question or "")
        same = T._same(r)
        mine = set(_PLAIN.findall(r.lower()))
        rest = same.replace(q, "") if q and q in same else same
        empty[i], copy[i], strange[i] = not same, len(rest) < len(same) and rest in T._LABELS, foreign(question, r) if same else 0.0
        out[i] = (
            1.0, np.log1p(len(same)) / 5, 1 - len(rest) / len(same) if same else 0.0, np.log1p(len(rest)) / 5, len(asked & mine) / max(len(mine), 1) if mine else 0.0, 0.0,
            min(strange[i], 8) / 4, len(mine) / 20 if len(mine) < 60 else 3.0, not mine, any(map(str.isdigit, same)),
        )
    if odds is not None and n:
        out[:, ODDS] = np.clip(odds, -10, 4) / 2
    return Facts(out, empty, copy, strange)


def pair_features(examples: list[Example]) -> np.ndarray:
    """One row of pair features per example."""
    return pair_facts([e.question for e in examples], [e.response for e in examples], [e.odds for e in examples]).features


def _scores(slots: np.ndarray, owner: np.ndarray, dense: np.ndarray, grams: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = dense @ w
    for k in range(grams.shape[1]):
        out[:, k] += np.bincount(owner, grams[slots, k], minlength=len(dense)) / np.sqrt(np.maximum(np.bincount(owner, minlength=len(dense)), 1))
    return out


def _learn(slots, owner, dense, y, weight) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all labels by accelerated full-batch steps with per-weight rates."""
    n, k = y.shape
    grams, w = np.zeros((1 << BITS, k), dtype=np.float32), np.zeros((DENSE, k), dtype=np.float32)
    g2, d2 = np.full_like(grams, 1e-8), np.full_like(w, 1e-8)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(_scores(slots, owner, dense, grams, w), -30, 30)))
        err = (p - y) * weight / n
        dg = dense.T @ err + DECAY * w
        d2 += dg**2
        w -= RATE * dg / np.sqrt(d2)
        for j in range(k):
            gg = np.bincount(slots, (err[:, j] * scale)[owner], minlength=1 << BITS) + DECAY * grams[:, j]
            g2[:, j] += gg**2
            grams[:, j] -= RATE * gg / np.sqrt(g2[:, j])
    return grams, w


class Made(NamedTuple):
    """An example made of a sampled pair: its question, response, column and labels, and whether the text is the table's own."""

    source: int
    question: str
    response: str
    column: int
    labels: tuple[int, ...]
    real: bool


def synthesise(pairs: list[tuple[str, str, int]], rng: np.random.Generator) -> list[Made]:
    """Each pair (question, response, column) as it is and made defective in every way."""
    out: list[Made] = []
    langs = [language(q) for q, _, _ in pairs]
    by_lang: dict[str, list[int]] = {}
    for i, (q, r, _) in enumerate(pairs):
        if len(r) > 25 and not T.is_copy(r, q) and (own := language(r, "?")) != "?":
            by_lang.setdefault(own, []).append(i)
    for i, ((q, r, column), lang) in enumerate(zip(pairs, langs, strict=True)):

        def add(text: str, i=i, q=q, column=column, **on):
            out.append(Made(i, q, text, column, tuple(on.get(k, 0) for k in LABELS), not {"empty", "copy", "refusal"} & set(on)))

        add(r)
        kind = rng.integers(6)
        if kind < 2 and r.rstrip().endswith("."):  # a mark of exclamation is no refusal's own
            add(r.rstrip()[:-1] + "!")
        add(["", " ", "...", "<|endoftext|>", "-", "\n\n"][kind], empty=1)
        if q:
            add([q, q.lower(), f"Answer: {q}", f"Question: {q}", f'"{q}"', f"{q} {q}"][kind], copy=1)
            if r.strip():  # the question and then an answer is no copy
                add(f"{q} {r}")
        t = T.proper(r)
        if len(t) > 40:
            at = int(rng.integers(max(20, len(t) // 2), len(t) - 4))  # what is missing is mostly the smaller part
            add(t[:at] + ["", "", "...", " ", "<|endoftext|>", "…"][kind], truncated=1)
        head, body = REFUSALS[lang if rng.random() < 0.7 else "en"]
        names = re.findall(r"\b[A-Z][a-z]{4,}\b", q)[1:] or ["the company"]
        text = head[rng.integers(len(head))] + body[rng.integers(len(body))].replace("{n}", names[rng.integers(len(names))])
        text = text[0].upper() + text[1:]
        add(text[:-1] + "!" if kind == 5 else text + ["", "", "", "<|endoftext|>", "\n"][kind if kind < 5 else 0], refusal=1)
        others = [j for k, v in by_lang.items() if k != lang for j in v]
        if others:
            add(pairs[others[rng.integers(len(others))]][1], other_language=1)
    return out


def calibrated(score: np.ndarray, y: np.ndarray, beta: float = 4.0) -> float:
    """Threshold with the best F-score on held-out examples, recall counting ``beta`` times: the middle of the best gap."""
    if not y.any():
        return np.inf
    order = np.argsort(-score, kind="stable")
    hit, n = np.cumsum(y[order] > 0), np.arange(1, len(y) + 1)
    f = (1 + beta**2) * hit / (n + beta**2 * hit[-1])
    k = int(f.argmax())
    return float((score[order[k]] + score[order[min(k + 1, len(y) - 1)]]) / 2)


def _valley(real: np.ndarray, made: np.ndarray, rows: np.ndarray | None = None) -> float:
    """Middle of the first wide empty stretch, else the widest, between the bulk of the table's own scores and that of the made positives.

    ``rows`` is how many rows have each of the table's scores, one if not given.
    """
    rows = np.ones(len(real)) if rows is None else rows
    order = np.argsort(real)
    real, rows = real[order], rows[order]
    low, high = float(real[np.searchsorted(np.cumsum(rows), rows.sum() / 2)]), float(np.median(made))
    if high - low < 0.5:
        return high
    at = np.arange(low, high + 0.25, 0.25)
    n = np.histogram(real, at, weights=rows)[0] / rows.sum() + np.histogram(made, at)[0] / len(made)
    n = np.convolve(np.r_[n[0], n, n[-1]], [0.25, 0.5, 0.25], mode="valid")
    empty = np.flatnonzero(n <= n.min() + 1e-12)
    runs = np.split(empty, np.flatnonzero(np.diff(empty) > 1) + 1)
    run = next((r for r in runs if len(r) >= 4), max(runs, key=len))
    return float((at[run[0]] + at[run[-1] + 1]) / 2)


def fit(made: list[Made], odds: list[float], mined: list[Example], own: list[Example], seed: int = 3) -> Model | None:
    """Classifier from made examples with the log-odds of their ends, mined refusals and the sampled pairs themselves; None without any.

    A second round leaves out the table's texts that the first takes for refusals, and mined ones that it doesn't.
    """
    if not made:
        return None
    rng = np.random.default_rng(seed)
    examples = [Example(m.question, m.response, o) for m, o in zip(made, odds, strict=True)]
    suspected = np.array([is_empty(p.response) or T.is_copy(p.response, p.question) or p.odds <= T.DEFAULT_THRESHOLD or foreign(p.question, p.response) >= 2 for p in own])
    source = np.array([m.source for m in made])
    if suspected.all():
        suspected[:] = False
    refusal, cut = LABELS.index("refusal"), LABELS.index("truncated")
    clear = np.array([not m.labels[cut] or o < T.HIGH for m, o in zip(made, odds, strict=True)])  # a cut at what may be an end teaches nothing
    all_y, all_real = np.array([m.labels for m in made], dtype=np.float32), np.array([m.real for m in made])
    half = lambda n: np.arange(n) % 2

    def prepared(use: np.ndarray, mined: list[Example]):
        chosen = [examples[i] for i in use] + mined
        extra_y = np.zeros((len(mined), len(LABELS)), dtype=np.float32)
        extra_y[:, refusal] = 1
        return *gram_slots([e.response for e in chosen]), pair_features(chosen), np.concatenate([all_y[use], extra_y])

    def learn(slots, owner, dense, y, weight, rows):
        take, new = rows[owner], np.cumsum(rows) - 1
        return _learn(slots[take], new[owner[take]], dense[rows], y[rows], weight[rows])

    # first round: the table's texts count little against a refusal's wording, and each is judged by a machine that has not seen it
    use = np.flatnonzero(~suspected[source] & clear)
    slots, owner, dense, y = prepared(use, mined)
    weight = np.ones_like(y)
    weight[np.flatnonzero(all_real[use]), refusal] = SUSPECT
    fold = np.concatenate([half(len(own))[source[use]], half(len(mined))])
    doubt, sure = np.full(len(own), -np.inf), np.full(len(mined), -np.inf)
    for k in (0, 1):
        grams, w = learn(slots, owner, dense, y, weight, fold != k)
        own_part, mined_part = np.flatnonzero(half(len(own)) == k), np.flatnonzero(half(len(mined)) == k)
        for part, texts, into in ((own_part, own, doubt), (mined_part, mined, sure)):
            if len(part):
                rows = [texts[i] for i in part]
                into[part] = _scores(*gram_slots([e.response for e in rows]), pair_features(rows), grams, w)[:, refusal]
    # second round: the texts that the first takes for refusals are none of the clean ones, the surest are examples, and mined ones that it doesn't take for any are out
    more = [e for e, s, out in zip(own, doubt, suspected, strict=True) if s >= SURE and not out]
    if not (suspected | (doubt >= SUSPICION)).all():
        suspected = suspected | (doubt >= SUSPICION)
    slots, owner, dense, y = prepared(np.flatnonzero(~suspected[source] & clear), [e for e, s in zip(mined, sure, strict=True) if s >= SUSPICION] + more)
    held = rng.random(len(y)) < 0.25
    grams, w = learn(slots, owner, dense, y, np.ones_like(y), ~held)
    score = _scores(slots, owner, dense, grams, w)
    cuts = np.array([calibrated(score[held, k], y[held, k]) for k in range(len(LABELS))])
    return Model(grams, w, cuts, score[held & (y[:, refusal] > 0), refusal])


def label_scores(examples: list[Example], model: Model) -> np.ndarray:
    """Score of each label, one row per example."""
    if not examples:
        return np.zeros((0, len(LABELS)))
    slots, owner = gram_slots([e.response for e in examples])
    return _scores(slots, owner, pair_features(examples), model.grams, model.dense)


def classify(examples: list[Example], model: Model) -> np.ndarray:
    """Whether each label is on, one row per example."""
    return label_scores(examples, model) >= model.thresholds


def question_form(question: Column) -> Column:
    """The first two words of a question."""
    return F.lower(F.regexp_extract(question, r"^\P{L}*(\p{L}[\p{L}'’-]*\P{L}+\p{L}+)", 1))


def without_figures(replies: DataFrame) -> DataFrame:
    """(q, r, column, asked): responses (id, q, r, column) without a figure, at most ``MINED`` of those to questions of a form whose responses mostly have one (asked) and as many of others."""
    figure = F.regexp_replace("r", r"(?<!\d)(?:19|20)\d\d(?!\d)", "").rlike(r"\p{Nd}")
    rows = replies.where(F.col("r").rlike(r"[\p{L}\p{N}]")).withColumns({"form": question_form(F.col("q")), "figure": figure})
    forms = rows.groupBy("form").agg(F.avg(F.col("figure").cast("double")).alias("share")).where(F.col("form") != "").select("form", (F.col("share") >= FIGURED).alias("asked"))
    found = rows.where(~F.col("figure") & F.col("r").rlike(r"\p{L}")).join(forms, "form")
    drawn = [found.where(F.col("asked") == a).orderBy(F.xxhash64("id", "column"), "id", "column").limit(MINED) for a in (True, False)]
    return drawn[0].unionByName(drawn[1]).select("q", "r", "column", "asked")


def screened(candidates: list[tuple], others: list[tuple]) -> list[tuple]:
    """Candidates of refusals (question, response, ...) less those that read like responses to questions that ask for no figure.

    Such responses decline as rarely as any, so words that candidates have much more often are those of refusals.
    """
    if not candidates or not others:
        return candidates
    slots, owner = gram_slots([r for _, r, *_ in candidates + others])
    y = np.r_[np.ones(len(candidates)), np.zeros(len(others))].astype(np.float32)[:, None]
    weight = np.where(y > 0, len(y) / 2 / len(candidates), len(y) / 2 / len(others)).astype(np.float32)
    dense = np.zeros((len(y), DENSE), dtype=np.float32)
    dense[:, 0] = 1
    fold, kept = np.arange(len(y)) % FOLDS, []
    for k in range(FOLDS):  # a candidate is judged by a machine that has not seen it
        take = fold[owner] != k
        new = np.cumsum(fold != k) - 1
        score = _scores(slots, owner, dense, *_learn(slots[take], new[owner[take]], dense[fold != k], y[fold != k], weight[fold != k]))[:, 0]
        kept += np.flatnonzero((score >= SURE) & (fold == k) & (y[:, 0] > 0)).tolist()
    return [candidates[i] for i in sorted(kept)]


def sampled(src: DataFrame, fields: list[str]) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """(pairs to make examples of, candidates of refusals), each (question, response, column), of rows (_id, _q, fields)."""
    got = src.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).toPandas()
    pairs = [(q or "", r or "", k) for k, name in enumerate(fields) for q, r in zip(got["_q"], got[name], strict=True)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.col(c).alias("r")) for k, c in enumerate(fields))))
    drawn = without_figures(src.select(F.col("_id").alias("id"), F.col("_q").alias("q"), each.alias("x")).select("id", "q", "x.*")).collect()
    whole = [((r.q, r.r, r.column), r.asked) for r in drawn if not is_empty(r.r) and not T.is_copy(r.r, r.q) and foreign(r.q, r.r) < 1]
    return pairs, screened([x for x, asked in whole if asked], [x for x, asked in whole if not asked])


def _odds_of(scores: DataFrame, texts: list[tuple[str, str, int]], counted: bool) -> list[float]:
    """Log-odds of the ends of some texts (question, response, column), which the scores hold as the table's own or as extra ones; 0 where there is none."""
    ends = [T.end_of(r, q) for q, r, _ in texts]
    kinds = (0, 1) if counted else (2, 3)
    ids = {(kinds[0], T.tail_id(e.tail, c)) for e, (_, _, c) in zip(ends, texts, strict=True) if e} | {(kinds[1], T.token_id(e.token)) for e in ends if e and e.token}
    if not ids:
        return [0.0] * len(texts)
    wanted = scores.sparkSession.createDataFrame(sorted(ids), "kind int, id long")
    known = {(r.kind, r.id): r.logit for r in scores.join(F.broadcast(wanted), ["kind", "id"]).collect()}
    out = []
    for e, (_, _, c) in zip(ends, texts, strict=True):
        if e is None or not e.case:
            out.append(0.0)
            continue
        s, w = known.get((kinds[0], T.tail_id(e.tail, c)), 0.0), known.get((kinds[1], T.token_id(e.token)), 9.0) if e.token else 9.0
        out.append((min(s, -9.0) if e.forced else s) + min(w + T.SLACK, 0.0) - (T.MARKED if e.marked else 0.0))
    return out


def defects(rows: DataFrame, row_id: str, question: str, fields: list[str], expected_refusal: str) -> DataFrame:
    """(row_id, field, defect) of every response, defect being null where there is none."""
    spark = rows.sparkSession
    kind = rows.schema[row_id].dataType.simpleString()
    src = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), F.col(question).alias("_q"), F.coalesce(F.col(expected_refusal), F.lit(False)).alias("_e"), *fields)
    pairs, candidates = sampled(src, fields)
    made = synthesise(pairs, np.random.default_rng(5))
    if not made:
        return spark.createDataFrame([], f"{row_id} {kind}, field string, defect string")
    texts = [(m.question, m.response, m.column) for m in made]
    extra = [(c, e.tail, e.token) for q, r, c in texts + candidates if (e := T.end_of(r, q))]
    ends = checkpointed(T.ended(rows, row_id, question, fields))
    scores = T.end_scores(rows, ends, question, fields, extra)
    odds = _odds_of(scores, texts + candidates, counted=False)
    mined = [Example(q, r, o) for (q, r, _), o in zip(candidates, odds[len(texts) :], strict=True) if o > T.DEFAULT_THRESHOLD]
    own = [Example(q, r, o) for (q, r, _), o in zip(pairs, _odds_of(scores, pairs, counted=True), strict=True)]
    model = fit(made, odds[: len(texts)], mined, own)
    sent = spark.sparkContext.broadcast(model)
    names = [f"_s{k}" for k in range(len(LABELS))]

    def judge(frames):
        m = sent.value
        for f in frames:
            asked = [q or "" for q in f["_q"]]
            for column, name in enumerate(fields):
                places: dict[tuple[str, str], int] = {}  # equal pairs of a batch are read once
                at = np.array([places.setdefault((q, v or ""), len(places)) for q, v in zip(asked, f[name], strict=True)])
                questions, values = [q for q, _ in places], [v for _, v in places]
                facts = pair_facts(questions, values)
                slots, owner = gram_slots(values)
                scores = _scores(slots, owner, facts.features, m.grams, m.dense)
                none = T.End("", "", False, False, False)
                e = [T.end_of(v, q, bool(c)) or none for v, q, c in zip(values, questions, facts.copy, strict=True)]
                own = pd.DataFrame({
                    "field": name, "language": T.languages(values), "_tail_id": [T.tail_id(x.tail, column) for x in e], "_token_id": [T.token_id(x.token) for x in e], "_case": [x.case for x in e], "_forced": [x.forced for x in e],
                    "_marked": [x.marked for x in e], "_is_empty": facts.empty, "_is_copy": facts.copy, "_strange": facts.strange, **{n: scores[:, k] for k, n in enumerate(names)},
                }).iloc[at]
                yield pd.concat([f[["_id", "_e"]].reset_index(drop=True), own.reset_index(drop=True)], axis=1)

    schema = f"_id {kind}, _e boolean, field string, language string, _tail_id long, _token_id long, _case boolean, _forced boolean, _marked boolean, _is_empty boolean, _is_copy boolean, _strange double, " + ", ".join(f"{n} double" for n in names)
    judged = T.with_odds(src.mapInPandas(judge, schema), scores)
    part = F.least(F.greatest(F.coalesce("log_odds", F.lit(0.0)), F.lit(-10.0)), F.lit(4.0)) / 2  # the features were read without the end's odds
    judged = judged.withColumns({n: F.col(n) + part * F.lit(float(model.dense[ODDS, k])) for k, n in enumerate(names)})
    empty, copy, _, cut, foreign_ = (F.col(n) >= F.lit(float(t)) for n, t in zip(names, model.thresholds, strict=True))
    flagged = {"_empty": empty & F.col("_is_empty"), "_copy": copy & F.col("_is_copy"), "_cut": cut, "_foreign": foreign_ & (F.col("_strange") >= 2), "_refusal": F.floor(F.col(names[2]) * FINE) / FINE}
    out = checkpointed(judged.select("_id", "_e", "field", "language", "log_odds", "_is_empty", *(v.alias(k) for k, v in flagged.items())))
    bins = out.where("not _is_empty").groupBy("_refusal").agg(F.count("*").alias("n")).collect()
    refused_from = _valley(np.array([r["_refusal"] for r in bins]), model.refused, np.array([float(r.n) for r in bins])) if bins and len(model.refused) else float(model.thresholds[2])
    defect = (
        F.when(F.col("_empty"), "empty").when(F.col("_copy"), "copy").when((F.col("_refusal") >= refused_from) & ~F.col("_e"), "refusal")
        .when(F.col("_cut") & (F.col("log_odds") < T.limits(out)), "truncated").when(F.col("_foreign"), "other_language")
    )
    return out.select(F.col("_id").alias(row_id), "field", defect.alias("defect"))
