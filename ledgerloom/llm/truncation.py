"""Texts cut off before their end, found by how rarely what stands at their end is an end.

Two backward character n-gram models compare, for the last characters of a text, the likelihood that it ends
there with the likelihood that it goes on. The *sentence* model reads a skeleton (names and figures as one
symbol each, the start marked); the *word* model reads the characters of names and figures. Both back off from long
contexts to short ones, and leave out the count that a text itself gave its own end. A text's log-odds are the
sentence's, less what the word's lack; the threshold lies in the valley of the log-odds of its language and column.

Only contexts that stand at the end of some text are ever asked for. They are rows of a table: one for each
distinct tail and order. All characters of all texts are then counted; a bit filter of at most 2^``FILTER_BITS``
bits, the only thing that goes through the driver, turns away most contexts that nothing asks for, and an
aggregate and a join by context settle the rest exactly, however many there are. The filter's size changes the rows
shuffled, never the counts. Every text counts, once for each question however often it is repeated.

What follows a cut without being text is left out first: white space, special tokens, dots that mark a cut,
rules and context marks. Defined results: null and blank texts, texts without a letter or digit, and copies of
the question are no cases and have null log-odds; repeated rows are judged each; an empty table
gives an empty result; extra columns are ignored; a value of millions of characters is read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.quantities import language
from ledgerloom.session import checkpointed

FILTER_BITS = 28  # most bits of the filter: 32 MB a task, a row of at most 64 of them to the driver
TAIL, KEEP = 320, 64  # characters first masked for a tail, and characters of a tail's skeleton that hold the longest context
FLUSH = 2_000_000  # counts a task holds before it hands them on
SENTENCE_ORDERS = ((2,), (4, 2), (8,), (8, 4), (16,), (16, 8), (32,), (32, 16))
WORD_ORDERS = (1, 2, 3, 4, 5, 6)
BACKOFF, WORD_BACKOFF = 10.0, 6.0
DEFAULT_THRESHOLD, LOW, HIGH, PRIOR = -3.75, -4.75, -3.5, 12.0
BATCH_CHARS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3
# What may follow the text proper.
_MARKS = re.compile(r"(?:\s|<\|[a-z_]+\|>|\[(?:end of [a-z]+|\.\.\.|…|truncated|cut)\]|(?<=\s)\(?(?:\.\.\.|…)\)?$|(?:\.{3,}|…)|-{3,}|�|&#?x?[0-9a-zA-Z]{0,5}$|\\u[0-9a-f]{0,3}$)+$")
# Abbreviations whose full stop is followed by more of the sentence.
_OPEN_ENDS = frozenset("dr. no. nos. mr. mrs. ms. prof. e.g. i.e. fig. figs. cf. vs. approx. sec. z.b. bzw. d.h. nr. vgl. p.ej. núm. ca. incl. ex. st. resp. al.".split())
_GOES_ON = ",;:(-–/&[“$€£"
_CUT_MARK = re.compile(r"\s*(?:\.\.|…|\[\.|\[…|\[tr|\[cu|&#?x?[0-9a-zA-Z]{0,5}$|\\u[0-9a-f]{0,3}$|�)")
SLACK = 1.0  # log-odds by which a name or figure may be unlikely to end and count for nothing
MARKED = 3.0  # what a mark of the cut adds to the odds
_MASKED = re.compile(r"(\b[A-ZÀ-Ý][a-zà-ÿ]*\b|\d+(?:[.,]\d+)*)")  # names and figures
_ALNUM = re.compile(r"[^\W_]")
_SPECIAL = re.compile(r"<\|[a-z_]+\|>")
_GAP = re.compile(r"\s")
_CLOSERS = "\"'”’»)]"


def proper(text: str) -> str:
    """The text without what follows it; a NUL, which parts texts here, counts as a blank."""
    text = text.replace("\0", " ")
    while text:
        tail = text[-80:]
        m = _MARKS.search(tail)
        if not m or m.start() == len(tail):
            return text
        text = text[: len(text) - len(tail) + m.start()]
    return text


def masked(text: str) -> tuple[str, list[str]]:
    """The text with every name and figure as one symbol and its start marked, and those names and figures."""
    parts = _MASKED.split(text)
    own = parts[1::2]
    parts[1::2] = ["9" if w[0] <= "9" else "N" for w in own]
    return "^" + "".join(parts), own


def skeleton(text: str) -> str:
    """The masked text alone."""
    return masked(text)[0]


# What may stand beside a copied question.
_LABELS = frozenset(("", "q", "question", "answer", "a", "frage", "antwort", "pregunta", "respuesta", "réponse", "qa", "questionanswer", "prompt"))


def _same(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


@lru_cache(maxsize=50_000)
def _same_question(question: str) -> str:
    return _same(question)


def is_copy(text: str, question: str | None) -> bool:
    """Nothing but the question, perhaps with a label, quoted or repeated however often."""
    if not question:
        return False
    q = _same_question(question)
    if not q or len(text) < len(q):
        return False
    head = _same(text[:400])
    if len(head) > 60 and q[:12] not in head[:60]:  # more than a label stands before it
        return False
    t = _same(text)
    rest = t.replace(q, "")
    return len(rest) < len(t) and rest in _LABELS


def _powers() -> dict[int, np.uint64]:
    return {n: np.uint64(pow(_PRIME, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32)}


_POWER = _powers()


class _Contexts:
    """Numbers of a column's contexts that end at some byte of texts, by order."""

    def __init__(self, a: np.ndarray, column: int):
        self.column = column
        self.h = {1: (a.astype(np.uint64) + np.uint64(1)) * _MIX}
        with np.errstate(over="ignore"):
            for n in (1, 2, 4, 8, 16):
                out = np.zeros_like(self.h[n])
                out[n:] = self.h[n][:-n]
                out *= _POWER[n]
                out += self.h[n]
                self.h[2 * n] = out

    def at(self, k: int, at: np.ndarray) -> np.ndarray:
        """Numbers of order k at the positions, each at least the order's size from the first byte."""
        long, *short = SENTENCE_ORDERS[k]
        with np.errstate(over="ignore"):
            v = self.h[long][at - short[0]] * _POWER[short[0]] + self.h[short[0]][at] if short else self.h[long][at]
            return ((v + np.uint64(k + 1 + 1000 * self.column)) * _MIX).view(np.int64)


_SIZES = [sum(parts) for parts in SENTENCE_ORDERS]


def _pair_numbers(column: int) -> np.ndarray:
    """Numbers of a column's contexts of two bytes, for all pairs of bytes."""
    with np.errstate(over="ignore"):
        one = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX
        both = (one[:, None] * _POWER[1] + one[None, :]).ravel()
        return ((both + np.uint64(1 + 1000 * column)) * _MIX).view(np.int64)


def _join(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bytes from the text's start to each, whether the text ends there) of texts, each followed by NUL."""
    a = np.frombuffer(("\0".join(texts) + "\0").encode(), dtype=np.uint8)
    nul = np.flatnonzero(a == 0)
    starts = np.r_[0, nul[:-1] + 1]
    room = np.arange(1, len(a) + 1) - np.repeat(starts, nul - starts + 1)
    return a, room, np.r_[a[1:] == 0, False] & (a != 0)


def _word_slots(words: list[str]):
    """Per order, (numbers, owner, whether the word ends there) of every character of words and figures."""
    joined = "\0".join(["", *words, ""]).encode()
    a = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    at = np.flatnonzero(a)
    owner = np.cumsum(a == 0)[at] - 1
    following = np.r_[a[1:], np.uint64(0)][at]
    ok = (following < 128) | (following >= 192)  # within a character of several bytes there is no position
    at, owner, ends = at[ok], owner[ok], following[ok] == 0
    with np.errstate(over="ignore"):
        for k, n in enumerate(WORD_ORDERS):
            v = np.zeros(len(at), dtype=np.uint64)
            alive = np.ones(len(at), dtype=bool)
            for j in range(n):
                c = np.where(alive, a[np.maximum(at - j, 0)], np.uint64(0))
                v = v * np.uint64(_PRIME) + c + np.uint64(1)
                alive &= c != 0
            yield ((v + np.uint64(101 + k)) * _MIX).view(np.int64), owner, ends


def _digits(word: str) -> str:
    return re.sub(r"\d", "9", word)


class End(NamedTuple):
    """The end of a value: its skeleton's tail, the name or figure it ends in, whether it can be a case, and what fixed rules say."""

    tail: str
    token: str
    case: bool
    forced: bool
    marked: bool


def tail_of(text: str) -> str:
    """The last characters of a proper text's skeleton, masked from white space as far back as they reach."""
    n = TAIL
    while n < len(text):
        if gap := _GAP.search(text, len(text) - n):  # no name or figure spans white space
            part = skeleton(text[gap.start() :])[1:]
            if len(part) >= KEEP:
                return part[-KEEP:]
        n *= 2
    return skeleton(text)[-KEEP:]


def _last_token(text: str) -> str:
    """The name or figure that the text ends in, if it ends in one."""
    n = 48
    while n < len(text) and not _GAP.search(text, len(text) - n):
        n *= 2
    bits = _MASKED.split(text[-n:].split()[-1])
    return bits[-2] if len(bits) > 1 and not bits[-1] else ""


def end_of(value: str | None, question: str | None, copy: bool | None = None) -> End | None:
    """The end of a value; None for one that has no text. Whether it is a copy of its question may be known."""
    t = proper(value) if value else ""
    if not t:
        return None
    case = bool(_ALNUM.search(_SPECIAL.sub("", t) if "<|" in t else t)) and not (is_copy(t, question) if copy is None else copy)
    forced = t[-1] in _GOES_ON or t[-40:].split()[-1].lower().lstrip("([\"'“") in _OPEN_ENDS
    return End(tail_of(t), _digits(_last_token(t)), case, forced, bool(_CUT_MARK.match(value, len(t))))


def tail_id(tail: str, column: int) -> int:
    return xxhash.xxh64_intdigest(tail, seed=column + 1) - (1 << 63)


def token_id(token: str) -> int:
    return xxhash.xxh64_intdigest(token, seed=0) - (1 << 63)


def tail_numbers(tails: list[str], column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the tail, order, number) of every context at the ends of a column's tails."""
    a, room, stops = _join(tails)
    last, c = np.flatnonzero(stops), _Contexts(a, column)
    own = [np.flatnonzero(room[last] >= size) for size in _SIZES]
    return np.concatenate(own), np.repeat(np.arange(len(own)), list(map(len, own))), np.concatenate([c.at(k, last[x]) for k, x in enumerate(own)])


def token_numbers(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the token, order, number) of the contexts that end names and figures."""
    got = [(owner[ends], np.full(int(ends.sum()), k), slot[ends]) for k, (slot, owner, ends) in enumerate(_word_slots(tokens))]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


class Filter:
    """Bits of the numbers sought: turns away nearly all others."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.shift, self.packed = np.uint64(64 - bits), packed

    def __call__(self, v: np.ndarray) -> np.ndarray:
        """Indices of the numbers that may be sought."""
        at = (v.view(np.uint64) >> self.shift).astype(np.int64)
        return np.flatnonzero(self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1)


class _Tally:
    """Sums by number, merged when many are held."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, ends: np.ndarray, more: np.ndarray) -> None:
        if len(keys):
            self.held.append((keys, ends, more))
            self.size += len(keys)

    def merged(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"key": np.empty(0, np.int64), "e": np.empty(0, np.int64), "m": np.empty(0, np.int64)})
        keys, ends, more = (np.concatenate(x) for x in zip(*self.held, strict=True))
        keys, place = np.unique(keys, return_inverse=True)
        e, m = (np.bincount(place, x, minlength=len(keys)).astype(np.int64) for x in (ends, more))
        self.held, self.size = [(keys, e, m)], len(keys)
        return pd.DataFrame({"key": keys, "e": e, "m": m})

    def compact(self) -> bool:
        """Whether so many numbers are held, even merged, that they should be handed on."""
        if self.size > FLUSH:
            self.merged()
        return self.size > FLUSH // 2


def count_texts(texts: list[str], column: int, sought: Filter, tally: _Tally) -> None:
    """Add how often each context that may be sought goes on in a column's proper texts, and both counts of those of names and figures."""
    words: Counter[str] = Counter()

    def flush(held: list[str]):
        a, room, stops = _join(held)
        c, alive = _Contexts(a, column), np.flatnonzero((a != 0) & ~stops & (room >= 2))
        pairs = np.bincount(a[alive - 1].astype(np.int64) * 256 + a[alive], minlength=1 << 16)
        numbers = _pair_numbers(column)  # nearly all pairs occur: counted without a look-up each
        at = sought(numbers)
        at = at[pairs[at] > 0]
        tally.add(numbers[at], np.zeros(len(at)), pairs[at])
        for k, size in list(enumerate(_SIZES))[1:]:  # a context is sought only if its shorter ones are
            alive = alive[room[alive] >= size]
            v = c.at(k, alive)
            at = sought(v)
            alive = alive[at]
            keys, n = np.unique(v[at], return_counts=True)
            tally.add(keys, np.zeros(len(keys)), n)

    held, size = [], 0
    for t in texts:
        mask, own = masked(t)
        held.append(mask)
        words.update(own)
        size += len(t)
        if size > BATCH_CHARS:
            flush(held)
            held, size = [], 0
    if held:
        flush(held)
    merged: Counter[str] = Counter()
    for w, n in words.items():
        merged[_digits(w)] += n
    if merged:
        weight = np.array(list(merged.values()), dtype=float)
        for slot, owner, stops in _word_slots(list(merged)):
            at = sought(slot)
            w = weight[owner[at]]
            tally.add(slot[at], w * stops[at], w * ~stops[at])


def ended(rows: DataFrame, row_id: str, question: str, text_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per value: row_id, kept columns, field, language, its end, numbers of tail and token, and two numbers of (question, field, text)."""
    keep = keep or []
    kinds = [rows.schema[c].dataType.simpleString() for c in (row_id, *keep)]
    schema = ", ".join(f"{c} {k}" for c, k in zip(("_id", *keep), kinds, strict=True)) + ", field string, _column int, language string, _d1 long, _d2 long, _tail string, _token string, _tail_id long, _token_id long, _case boolean, _forced boolean, _marked boolean"

    def read(frames):
        none = End("", "", False, False, False)
        for f in frames:
            for column, name in enumerate(text_cols):
                places: dict[tuple, int] = {}  # equal values of a batch are read once
                at = np.array([places.setdefault(x, len(places)) for x in zip(f[f"_v{column}"], f["_q"], strict=True)])
                e = [end_of(v, q) or none for v, q in places]
                own = pd.DataFrame({
                    "field": name, "_column": np.int32(column), "language": languages([v for v, _ in places]), "_tail": [x.tail or None for x in e], "_token": [x.token for x in e], "_tail_id": [tail_id(x.tail, column) for x in e],
                    "_token_id": [token_id(x.token) for x in e], "_case": [x.case for x in e], "_forced": [x.forced for x in e], "_marked": [x.marked for x in e],
                }).iloc[at].reset_index(drop=True)
                yield pd.concat([f[["_id", *keep]].reset_index(drop=True), own.assign(_d1=f[f"_a{column}"].to_numpy(), _d2=f[f"_b{column}"].to_numpy())], axis=1)

    each = [x for k, c in enumerate(text_cols) for x in (F.col(c).alias(f"_v{k}"), F.xxhash64(question, F.lit(k), c).alias(f"_a{k}"), F.xxhash64(F.lit("salt"), c, F.lit(k), question).alias(f"_b{k}"))]
    return rows.select(F.col(row_id).alias("_id"), *keep, F.col(question).alias("_q"), *each).mapInPandas(read, schema)


def _sought(ends: DataFrame, extra: list[tuple[int, str, str]]) -> DataFrame:
    """(kind, id, k, key, n): contexts of distinct tails (kind 0) and tokens (1), n texts having the tail; those of further tails (2) and tokens (3) that no text counts for."""
    spark = ends.sparkSession
    each = ends.where("_tail is not null").groupBy("_d1", "_d2").agg(F.first("_column").alias("_column"), F.first("_tail").alias("_tail"), F.first("_token").alias("_token"))
    tails = each.groupBy("_column", "_tail").agg(F.count("*").alias("n")).select(F.lit(0).alias("kind"), F.col("_column").alias("c"), F.col("_tail").alias("s"), "n")
    tokens = each.where("_token <> ''").select(F.lit(1).alias("kind"), F.lit(0).alias("c"), F.col("_token").alias("s"), F.lit(0).cast("long").alias("n")).distinct()
    rows = tails.unionByName(tokens)
    if extra:
        more = sorted({(2, c, t, 0) for c, t, _ in extra} | {(3, 0, w, 0) for _, _, w in extra if w})
        rows = rows.unionByName(spark.createDataFrame(more, "kind int, c int, s string, n long"))

    def numbers(frames):
        for f in frames:
            for (kind, c), g in f.groupby(["kind", "c"], sort=False):
                texts = list(g["s"])
                of, k, key = tail_numbers(texts, int(c)) if kind in (0, 2) else token_numbers(texts)
                ids = np.array([tail_id(t, int(c)) if kind in (0, 2) else token_id(t) for t in texts], dtype=np.int64)
                yield pd.DataFrame({"kind": np.full(len(of), kind, np.int32), "id": ids[of], "k": k.astype(np.int32), "key": key, "n": g["n"].to_numpy()[of]})

    return checkpointed(rows.mapInPandas(numbers, "kind int, id long, k int, key long, n long"))


def _filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of the numbers sought, gathered as at most 2^(FILTER_BITS - 6) words."""
    n = keys.select(F.approx_count_distinct("key")).first()[0]
    bits = max(min(max(int(n * 16).bit_length(), 16), FILTER_BITS), 7)
    at = F.shiftrightunsigned("key", 64 - bits)
    got = keys.groupBy(F.shiftrightunsigned(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((shiftrightunsigned(key, {64 - bits}) & 63) as int))")).alias("b")).toArrow()
    words = np.zeros(1 << bits - 6, dtype=np.int64)
    words[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits, words.view(np.uint8)


def end_scores(rows: DataFrame, ends: DataFrame, question: str, text_cols: list[str], extra: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """(kind, id, logit): log-odds of an end of every distinct tail and token; of the extra (column, tail, token) too, which count for nothing.

    Tails are kind 0, tokens 1, extra ones 2 and 3. Counted are all characters of all texts of the columns, once a question.
    """
    keys = _sought(ends, extra or [])
    bits, packed = _filter(keys)
    sent = rows.sparkSession.sparkContext.broadcast(packed)
    each = [F.struct(F.lit(k).alias("column"), F.col(c).alias("text")) for k, c in enumerate(text_cols)]
    texts = rows.select(F.xxhash64(question).alias("asked"), F.explode(F.array(*each)).alias("t")).select("asked", "t.*").where("text is not null").distinct()

    def tally(frames):
        sought, held = Filter(bits, sent.value), _Tally()
        for f in frames:
            column = f["column"].to_numpy()
            for c in range(len(text_cols)):
                if texts := [p for t in f["text"][column == c] if (p := proper(t))]:
                    count_texts(texts, c, sought, held)
            if held.compact():
                yield held.merged()
                held = _Tally()
        yield held.merged()

    counted = texts.select("column", "text").mapInPandas(tally, "key long, e long, m long").groupBy("key").agg(F.sum("e").alias("e"), F.sum("m").alias("m"))
    own = keys.groupBy("key").agg(F.sum("n").alias("n"))
    counts = own.join(counted, "key", "left").select("key", (F.col("n") + F.coalesce("e", F.lit(0))).alias("e"), F.coalesce("m", F.lit(0)).alias("m"))
    told = keys.select("kind", "id", "k", "key").join(counts, "key").groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("k", "e", "m"))).alias("c"))
    prior, back = F.when(F.col("kind") % 2 == 0, 0.02).otherwise(0.3), F.when(F.col("kind") % 2 == 0, BACKOFF).otherwise(WORD_BACKOFF)
    mine = F.when(F.col("kind") < 2, 1).otherwise(0)

    def step(p: Column, x: Column) -> Column:
        e = F.greatest(x["e"] - F.col("_own"), F.lit(0))
        return (e + F.col("_back") * p) / (e + x["m"] + F.col("_back"))

    told = told.withColumns({"_own": mine, "_back": back, "_prior": prior})
    p = F.least(F.greatest(F.aggregate("c", F.col("_prior"), step), F.lit(1e-9)), F.lit(1 - 1e-9))
    return checkpointed(told.select("kind", "id", F.log(p / (1 - p)).alias("logit")))


def combined(sentence: Column, word: Column, forced: Column, marked: Column) -> Column:
    """Log-odds of a value from those of its tail and token and from the fixed rules."""
    s = F.when(forced, F.least(sentence, F.lit(-9.0))).otherwise(sentence)
    return s + F.least(F.coalesce(word, F.lit(9.0)) + SLACK, F.lit(0.0)) - F.when(marked, MARKED).otherwise(0.0)


def with_odds(ends: DataFrame, scores: DataFrame) -> DataFrame:
    """Values, which have the numbers of tail and token, with ``log_odds``; null where the value is no case."""
    s = scores.where("kind = 0").select(F.col("id").alias("_tail_id"), F.col("logit").alias("_s"))
    w = scores.where("kind = 1").select(F.col("id").alias("_token_id"), F.col("logit").alias("_w"))
    odds = F.when(F.col("_case"), combined(F.col("_s"), F.col("_w"), F.col("_forced"), F.col("_marked")))
    return ends.join(s, "_tail_id", "left").join(w, "_token_id", "left").withColumn("log_odds", odds).drop("_s", "_w")


def languages(values: list[str | None]) -> list[str]:
    """Language of each value."""
    return [language(v) if v else "en" for v in values]


def valley(histogram: dict[float, int]) -> float:
    """The emptiest place between LOW and HIGH, the highest of about equal ones; a few values' worth of doubt keeps it near the default."""
    at = np.arange(LOW, HIGH + 1e-9, 0.25)
    n = np.array([histogram.get(float(x), 0) for x in at], dtype=float) + PRIOR * np.minimum(np.abs(at - DEFAULT_THRESHOLD), 1.0)
    return float(at[np.flatnonzero(n <= 1.5 * n.min() + 1)[-1]])


def limits(out: DataFrame) -> Column:
    """Log-odds below which a value is cut, by its language and field: the valley over all judged values."""
    bins = out.where("log_odds is not null").groupBy("language", "field", (F.floor(F.col("log_odds") * 4) / 4).alias("at")).agg(F.count("*").alias("n")).collect()
    groups: dict[tuple[str, str], dict[float, int]] = {}
    for r in bins:
        groups.setdefault((r.language, r.field), {})[float(r["at"])] = r.n
    cuts = {k: valley(v) for k, v in groups.items()}
    limit = F.lit(DEFAULT_THRESHOLD)
    for (lang, field), v in sorted(cuts.items()):
        limit = F.when((F.col("language") == lang) & (F.col("field") == field), v).otherwise(limit)
    return limit


def truncated(rows: DataFrame, row_id: str, question: str, text_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Every value with its log-odds and whether it is cut: row_id, kept columns, field, language, log_odds, truncated."""
    ends = checkpointed(ended(rows, row_id, question, text_cols, keep))
    out = with_odds(ends, end_scores(rows, ends, question, text_cols))
    out = checkpointed(out.select(F.col("_id").alias(row_id), *(keep or []), "field", "language", "log_odds"))
    return out.withColumn("truncated", F.coalesce(F.col("log_odds") < limits(out), F.lit(False)))
