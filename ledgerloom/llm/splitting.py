"""Cutting oversized items into pieces under a word limit, at natural boundaries, with overlap.

Between any two words lies a boundary with a strength: a section heading follows, a blank line, a sentence
end, a line break, a clause end, or nothing. A sparse table over the strengths answers the range maximum in
constant time: each cut is the strongest boundary in the window of permissible lengths, ties going right,
and the next piece steps back by the overlap. A section heading is a boundary no piece crosses.

Defined results: null and blank texts and texts within the limit give no pieces; an item without a limit
(no row, null or below 1) is never too long; a negative or null overlap counts as 0 and an overlap of the
limit or more as limit - 1; a text without any boundary is cut at the limit; repeated rows are split each;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, CLAUSE, LINE, SENTENCE, PARAGRAPH, SECTION = range(6)
_WORDS = re.compile(r"[^ \t\n]+")
_HEADING = re.compile(r"Item\s+\d+[A-Z]?\b[.:]?(?=\s|$)", re.I)
_CLOSERS = "\"'”’»)]"
# Abbreviations whose full stop ends no sentence.
_ABBREVIATIONS = frozenset("approx. inc. no. dr. mr. mrs. ms. fig. e.g. i.e. vs. corp. co. ltd. st. u.s. cf. ca. bzw. z.b. art.".split())


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the boundary after each word but the last."""
    out = np.zeros(max(len(spans) - 1, 0), dtype=np.int8)
    for i in range(len(spans) - 1):
        word, gap = text[spans[i][0] : spans[i][1]], text[spans[i][1] : spans[i + 1][0]]
        if "\n" in gap and _HEADING.match(text, spans[i + 1][0]):
            out[i] = SECTION
        elif gap.count("\n") > 1:
            out[i] = PARAGRAPH
        else:
            bare = word.rstrip(_CLOSERS)
            if bare[-1:] in (".", "!", "?") and bare.lower() not in _ABBREVIATIONS:
                out[i] = SENTENCE
            elif "\n" in gap:
                out[i] = LINE
            elif bare[-1:] in (";", ":", ","):
                out[i] = CLAUSE
    return out


class RangeMax:
    """Sparse table of range maxima; the rightmost position of the maximum of any range in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        key = values.astype(np.int64) * (n + 1) + np.arange(n)  # a tie goes to the right
        self.n, self.rows = n + 1, [key]
        width = 1
        while 2 * width <= n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def query(self, a: int, b: int) -> tuple[int, int]:
        """(strength, position) of the maximum over positions a..b, both included."""
        k = (b - a + 1).bit_length() - 1
        row = self.rows[k]
        best = int(max(row[a], row[b - (1 << k) + 1]))
        return divmod(best, self.n)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first word, end word, first character, end character, strength of the cut) of each piece of a text."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    n = len(spans)
    if not n or limit < 1:
        return []
    overlap = min(max(overlap, 0), limit - 1)
    strong = strengths(text, spans)
    heads = [0, *(int(i) + 1 for i in np.flatnonzero(strong == SECTION)), n]
    table = RangeMax(strong) if n > 1 else None
    out: list[tuple[int, int, int, int, int]] = []
    for lo, hi in zip(heads, heads[1:], strict=False):
        start, cut = lo, lo
        while True:
            if hi - start <= limit:
                out.append((start, hi, spans[start][0], spans[hi - 1][1], SECTION if hi < n else PARAGRAPH))
                break
            # a cut after word e ends a piece of e + 1 - start words; it must pass the last cut
            least, most = max(cut, start + overlap), start + limit - 1
            strength, e = table.query(max(least, start + limit // 2), most)
            if strength < SENTENCE:
                wider, at = table.query(min(least, most), most)
                if wider >= SENTENCE:
                    strength, e = wider, at
            cut = e + 1
            out.append((start, cut, spans[start][0], spans[cut - 1][1], strength))
            start = max(cut - overlap, start + 1)
            if overlap and start < cut:
                # step back by the overlap, but begin at the first sentence start within it, if any
                for s in range(start, cut):
                    if strong[s - 1] >= SENTENCE:
                        start = s
                        break
    return out


def split_oversized(items: DataFrame, limits: DataFrame, key: str, text: str, config: Column, limit_config: str, max_words: str, overlap_words: str) -> DataFrame:
    """Ordered pieces of every item longer than its limit: key, piece_no, text, first_word, end_word, n_words, cut.

    The limits table meets the items in a join; whether it is small enough to broadcast is Spark's finding, from
    its size. Only oversized texts leave the JVM. Any number of words fits: memory grows with one item's length.
    """
    lim = limits.where(F.col(limit_config).isNotNull()).groupBy(F.col(limit_config).alias("_c")).agg(F.min(max_words).cast("int").alias("_max"), F.min(overlap_words).cast("int").alias("_over"))
    rows = items.select(F.col(key).alias("_k"), F.col(text).alias("_t"), config.alias("_cfg")).where(F.col("_t").isNotNull())
    rows = rows.withColumn("_n", F.regexp_count("_t", F.lit(r"[^ \t\n]+")))
    rows = rows.join(lim, F.col("_cfg") == F.col("_c")).where((F.col("_max") >= 1) & (F.col("_n") > F.col("_max"))).select("_k", "_t", "_max", F.coalesce("_over", F.lit(0)).alias("_over"))

    def cut(frames):
        names = ("word", "clause", "line", "sentence", "paragraph", "section")
        for f in frames:
            out = []
            for k, t, most, over in zip(f["_k"], f["_t"], f["_max"], f["_over"], strict=True):
                for i, (a, b, x, y, s) in enumerate(pieces(t, int(most), int(over))):
                    out.append((k, i, t[x:y], a, b, b - a, names[s]))
            yield pd.DataFrame(out, columns=["k", "piece_no", "text", "first_word", "end_word", "n_words", "cut"])

    kind = items.schema[key].dataType.simpleString()
    return rows.mapInPandas(cut, f"k {kind}, piece_no int, text string, first_word int, end_word int, n_words int, cut string").withColumnRenamed("k", key)
