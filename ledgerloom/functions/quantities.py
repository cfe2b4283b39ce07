"""Reading quantities out of text: number, scale and unit, by the rules of the text's language."""

from __future__ import annotations

import re
from typing import NamedTuple

# Spellings of units, by the unit_name they stand for.
UNIT_SPELLINGS = {
    "dollar": r"u\.s\. dollars?|us dollars?|us-dollars?|dollars?|usd|dólares|dolares|dólar|us\$",
    "percent": r"percent|per cent|pct\b\.?|%|out of every 100|out of 100|prozent|pour cent|por ciento",
    "basis point": r"basis points?|bps|bp|basispunkte?n?|points de base|puntos básicos",
    "decimal fraction": r"decimal fraction",
    "share": r"shares?|aktien?|actions?|acciones",
    "square foot": r"square f(?:ee|oo)t|sq\.? ?f(?:ee|oo)?t\b\.?|sqft|ft2|ft²",
    "square meter": r"square met(?:er|re)s?|sq\.? ?m\b\.?|sqm|m2|m²|quadratmeter|mètres carrés|metros cuadrados",
    "acre": r"acres?",
    "kilowatt hour": r"kilowatt[- ]?hours?|kwh",
    "megawatt hour": r"megawatt[- ]?hours?|mwh",
    "gigawatt hour": r"gigawatt[- ]?hours?|gwh",
    "terawatt hour": r"terawatt[- ]?hours?|twh",
    "gigajoule": r"gigajoules?|gj",
    "metric ton": r"metric tons?|metric tonnes?|tonnes?|tonnen",
    "kiloton": r"kilotons?|kilotonnes?|kt",
    "pound": r"pounds?|lbs?\b\.?",
    "short ton": r"short tons?",
}
# Scale words and letters.
SCALE_WORDS = {
    "mil millones": 1e9, "miles de millones": 1e9,
    "thousand": 1e3, "thousands": 1e3, "tausend": 1e3, "mille": 1e3, "milliers": 1e3, "mil": 1e3, "miles": 1e3, "k": 1e3, "tsd": 1e3,
    "million": 1e6, "millions": 1e6, "mm": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6, "mio": 1e6, "millionen": 1e6, "millones": 1e6, "millón": 1e6,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "b": 1e9, "mrd": 1e9, "milliarde": 1e9, "milliarden": 1e9, "milliard": 1e9, "milliards": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
}
# Measures a question can ask for, by the dimension they have; anything else is money.
DIMENSION_WORDS = [
    ("stock", r"number of shares|share count|shares outstanding|shares repurchased"),
    ("share", r"percentage|\brate\b|share of|proportion|margin percent|\bpercent\b"),
    ("area", r"floor area|land area|\barea\b|square f(?:ee|oo)t|acreage"),
    ("energy", r"electricity|purchased power|generation|energy|\bpower\b"),
    ("mass", r"weight|emissions|tonnage|\bmass\b"),
]
# Frequent words that tell the four languages apart.
LANGUAGE_WORDS = {
    "en": "the of and to in was by for with its may which that is as not from on at",
    "de": "der die das und von im bei lag den nach mit für ist wegen auf dass laut ein eine des",
    "fr": "le la les de des du et pour dans une à a été était avec par qui en l'exercice part atteint",
    "es": "el la los las de del y en por con una que fue para según ejercicio se alcanzó proporción a",
}

_LANG = {k: frozenset(v.split()) for k, v in LANGUAGE_WORDS.items()}
_LANGS_OF = {w: tuple(k for k in _LANG if w in _LANG[k]) for v in _LANG.values() for w in v}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_EN_NUM = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+"
_EU_NUM = r"\d{1,3}(?:[.   ]\d{3})+(?:,\d+)?|\d+(?:,\d+)?"
_HEAD = r"(?P<neg>[-−(]\s?)?(?P<cur>us\s?\$|usd|u\.s\.\s?\$|\$)?\s?(?P<num>%s)(?P<exp>e[+-]?\d+)?"
_EN, _EU = (re.compile(r"(?<![\w.,])" + _HEAD % n, re.I) for n in (_EN_NUM, _EU_NUM))
_UNIT = re.compile("|".join(f"(?P<u{i}>(?:{s})(?![^\\W\\d_]))" for i, s in enumerate(UNIT_SPELLINGS.values())), re.I)
_UNIT_NAMES = list(UNIT_SPELLINGS)
_SCALE = re.compile("(" + "|".join(sorted(map(re.escape, SCALE_WORDS), key=len, reverse=True)) + r")(?![\w])\.?", re.I)
_PAREN = re.compile(r"\((?:[a-z]+ )?in (thousands|millions|billions|trillions)(?: of [a-z .]+)?\)", re.I)
_GAP = re.compile(r"[\s  -]*(?:of |de |d')?")
_DIMS = [(d, re.compile(p, re.I)) for d, p in DIMENSION_WORDS]
_YEAR = re.compile(r"(?:19|20)\d\d")


class Mention(NamedTuple):
    """A number in a text, with the scale and unit stated beside it (None where none is)."""

    value: float
    scale: float | None
    unit: str | None
    start: int


def language_hits(text: str) -> dict[str, int]:
    """How many words of a text are frequent ones of each language."""
    hits = dict.fromkeys(_LANG, 0)
    for w in _WORD.findall(text.lower()):
        for k in _LANGS_OF.get(w, ()):
            hits[k] += 1
    return hits


def language(text: str | None, default: str = "en") -> str:
    """The language with most of its frequent words in the text; ``default`` where none occurs or on a tie with it."""
    if not text:
        return default
    hits = language_hits(text)
    best = max(hits.values())
    return default if not best or hits.get(default) == best else max(hits, key=hits.get)


def _tail(rest: str) -> tuple[float | None, str | None]:
    scale = unit = None
    while rest:
        gap = _GAP.match(rest).end()
        at = rest[gap:]
        if unit is None and (m := _UNIT.match(at)):
            unit = _UNIT_NAMES[next(i for i in range(len(_UNIT_NAMES)) if m.group(f"u{i}"))]
        elif scale is None and (m := _PAREN.match(at)):
            scale = SCALE_WORDS[m.group(1).lower()]
        elif scale is None and unit is None and (m := _SCALE.match(at)):
            scale = SCALE_WORDS[m.group(1).lower()]
        else:
            break
        rest = at[m.end() :]
    return scale, unit


def mentions(text: str | None, lang: str | None = None) -> list[Mention]:
    """Quantities of a text in order. Four-digit years without a scale or unit are none, unless they are the whole text."""
    if not text:
        return []
    lang = lang or language(text)
    found, end = [], 0
    for m in (_EN if lang == "en" else _EU).finditer(text):
        if m.start() < end:
            continue
        scale, unit = _tail(text[m.end() : m.end() + 48])
        num = m.group("num")
        if scale is None and unit is None and not m.group("cur") and not m.group("exp") and _YEAR.fullmatch(num) and text.strip(" .\n") != num:
            continue
        if lang != "en":
            num = re.sub(r"[.   ]", "", num).replace(",", ".")
        try:
            value = float(num.replace(",", "") + (m.group("exp") or ""))
        except ValueError:
            continue
        neg = (m.group("neg") or "").strip()
        if (neg in ("-", "−") or neg == "(" and text[m.end() : m.end() + 2].lstrip().startswith(")")) and value:
            value = -value
        found.append(Mention(value, scale, unit, m.start("num")))
        if unit == "percent" and re.match(r"\s*out of", text[m.end() :], re.I):
            end = m.end() + 18
    return found


def asked(question: str | None) -> tuple[str, float | None, str | None]:
    """(dimension, scale, unit) that a question asks for; scale and unit are None where it names none."""
    q = question or ""
    dim = next((d for d, p in _DIMS if p.search(q)), "money")
    years = list(_YEAR.finditer(q))
    tail = q[years[-1].end() :] if years else q
    scale = next((SCALE_WORDS[w.lower()] for w in re.findall(r"\b(thousands|millions|billions|trillions)\b", tail, re.I)), None)
    m = _UNIT.search(tail) if years else None
    unit = _UNIT_NAMES[next(i for i in range(len(_UNIT_NAMES)) if m.group(f"u{i}"))] if m else None
    return dim, scale, unit
