"""Passages of held-out items inside corpus documents, found by q-gram lemma filtering.

Texts become runs of letters or digits in lower case, joined by single spaces. A window of w characters with
at most e edits shares at least w + 1 - q - q e q-grams with its origin, all on diagonals (document position
less item position) within e of each other. The lemma holds for any fixed subset of the item's q-grams: those at every
``STEP``-th position are indexed, of which a window holds at least (w + 1 - q) / STEP and an edit destroys at most q / STEP.
Shared q-grams are counted in overlapping diagonal bands; bands that reach the bound are kept and verified by a
banded alignment, which also gives the longest run of equal consecutive words.

The bound is set per item from its shortest run of ``least_words`` words, so no such run is missed. Items go
in blocks of bounded size, each sent to all tasks against all documents; documents are never shuffled,
so copies and hot sources do no harm. Shared q-grams are listed in slices of at most about ``MAX_HITS``; a document with
more is read in stretches that overlap by more than a run of ``least_words`` words.

Defined results: null and blank texts and passages hold nothing; a passage of fewer than ``least_words`` words
cannot leak; repeated document rows are each reported once by id; repeated items count by id; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, EDITS, STEP = 8, 2, 4
MAX_HITS = 3_000_000  # shared q-grams listed at once
BLOCK_CHARS = 4_000_000  # characters of items per block: bounds the index a task holds
BATCH_CHARS = 2_000_000  # characters of documents looked up at once
_WORD = re.compile(r"[^\W_]+")
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters or digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


def qgrams(data: bytes) -> np.ndarray:
    """The q-gram at each byte, as a number: eight bytes are one, so equal numbers are equal q-grams."""
    a = np.frombuffer(data, dtype=np.uint8)
    if len(a) < Q:
        return np.empty(0, dtype=np.uint64)
    padded = np.concatenate([a, np.zeros(8 - len(a) % 8 + 8, dtype=np.uint8)])
    n = len(a) - Q + 1
    out = np.empty(n, dtype=np.uint64)
    for s in range(8):
        part = padded[s : s + (len(padded) - s) // 8 * 8].view(np.uint64)
        m = len(out[s::8])
        out[s::8] = part[:m]
    return out


class ItemIndex:
    """q-grams of a block of items, with where they occur."""

    def __init__(self, items: list[tuple[int, str]], least_words: int, edits: int = EDITS):
        self.ids, self.texts, self.words, bounds, scores, widths, grams, owner, at = [], [], [], [], [], [], [], [], []
        self.reach = Q
        for item, passage in items:
            w = words(passage)
            if len(w) < least_words:
                continue
            text = " ".join(w).encode()
            g = qgrams(text)[::STEP]
            sizes = [len(" ".join(w[i : i + least_words]).encode()) for i in range(len(w) - least_words + 1)]
            width = min(sizes)
            self.reach = max(self.reach, max(sizes) + Q)
            sampled = (width + 1 - Q) // STEP
            e = max(0, min(edits, (sampled - 1) // (Q // STEP)))
            k = len(self.ids)
            self.ids.append(item)
            self.texts.append(text)
            self.words.append(w)
            widths.append(width)
            bounds.append(max(1, sampled - e * (Q // STEP)))
            scores.append(max(1, width + 1 - Q - Q * e))
            grams.append(g)
            owner.append(np.full(len(g), k, dtype=np.int32))
            at.append(np.arange(len(g), dtype=np.int32) * STEP)
        self.bound, self.score, self.width = (np.array(x, dtype=np.int64) for x in (bounds, scores, widths))
        g = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        order = np.argsort(g, kind="stable")
        self.owner, self.at = (np.concatenate(x)[order] if x else np.empty(0, dtype=np.int32) for x in (owner, at))
        self.keys, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def located(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, place among the keys) of every q-gram that some item has."""
        at = np.flatnonzero(self.seen[self._slot(g)])
        k = np.searchsorted(self.keys, g[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == g[at] if len(self.keys) else np.zeros(len(at), dtype=bool)
        return at[ok], k[ok]

    def hits(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, position in the item) of every shared q-gram at some places."""
        n = self.count[k]
        if not len(n):
            return at, at, at
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        src = np.repeat(self.first[k], n) + within
        return np.repeat(at, n), self.owner[src], self.at[src]


def bands(pos: np.ndarray, item: np.ndarray, ipos: np.ndarray, doc: np.ndarray, index: ItemIndex, edits: int = EDITS) -> list[tuple[int, int, int, int, int]]:
    """(document, item, lowest diagonal, first position, end position) of each band that reaches its item's bound within a window.

    Bands are twice as wide as the edits need and overlap by half, so every region lies whole in one.
    """
    half = edits + 1
    diag = pos - ipos
    base = int(diag.min())
    pair = doc.astype(np.int64) * len(index.ids) + item
    out = []
    for shift in (0, half):
        band = (diag - base + shift) // (2 * half)
        key = pair * (int(band.max()) + 1) + band
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        starts = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        counts = np.diff(np.r_[starts, len(sorted_key)])
        owner = item[order[starts]]
        for s, n, k in zip(*(x[counts >= index.bound[owner]].tolist() for x in (starts, counts, owner)), strict=True):
            rows = order[s : s + n]
            at = np.sort(ipos[rows])
            if (np.searchsorted(at, at + index.width[k] - Q + 1) - np.arange(n)).max() >= index.bound[k]:
                where = pos[rows]
                out.append((int(doc[rows[0]]), k, int(band[rows[0]]) * 2 * half - shift + base, int(where.min()), int(where.max()) + Q))
    return out


def stretches(at: np.ndarray, hits: np.ndarray, ends: np.ndarray, most: int, reach: int):
    """(from, to) among sorted positions, so that each has about ``most`` hits at most: whole documents, or stretches of one that overlap by ``reach``."""
    total = np.r_[0, np.cumsum(hits)]
    a = 0
    while a < len(at):
        b = int(np.searchsorted(total, total[a] + most, side="right")) - 1
        if b < len(at):
            last = ends[np.searchsorted(ends, at[max(b, a)], side="right") - 1] if len(ends) else 0  # end of the last whole document
            whole = int(np.searchsorted(at, last))
            if whole > a:
                b = whole
            else:  # one document alone has more: its next stretch begins before this one's end
                b = max(b, a + 1, int(np.searchsorted(at, at[a] + 2 * reach)))
                yield a, b
                a = max(int(np.searchsorted(at, at[b] - reach)), a + 1) if b < len(at) else b
                continue
        yield a, b
        a = b


def banded_alignments(text: np.ndarray, begin: np.ndarray, end: np.ndarray, items: list[bytes], low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its document, text[begin:end], on diagonals low .. low + width - 1.

    Scores 1 for an equal character and -2 for an edit. Returns the scores, the ends in the text and the edits.
    All pairs advance together, one item character at a time.
    """
    n, longest = len(items), max(map(len, items))
    chars = np.zeros((n, longest), dtype=np.uint8)
    for i, x in enumerate(items):
        chars[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
    size = np.array([len(x) for x in items])
    lanes = np.arange(width)
    prev, prev_e = np.zeros((n, width), dtype=np.int32), np.zeros((n, width), dtype=np.int32)
    best, where, edits = (np.zeros(n, dtype=np.int64) for _ in range(3))
    every = np.arange(n)
    for j in range(longest):
        at = low[:, None] + (j + lanes)
        inside = (at >= begin[:, None]) & (at < end[:, None]) & (j < size)[:, None]
        same = (text[np.clip(at, 0, len(text) - 1)] == chars[:, j][:, None]) & inside
        cur, cur_e = prev + np.where(same, 1, -2), prev_e + ~same
        for move, src in ((slice(None, -1), slice(1, None)),):  # a character of the item has no partner
            other = prev[:, src] - 2
            better = other > cur[:, move]
            cur[:, move][better] = other[better]
            cur_e[:, move][better] = prev_e[:, src][better] + 1
        for lane in range(1, width):  # a character of the document has none
            other = cur[:, lane - 1] - 2
            better = other > cur[:, lane]
            cur[better, lane] = other[better]
            cur_e[better, lane] = cur_e[better, lane - 1] + 1
        dead = (cur <= 0) | ~inside
        cur[dead], cur_e[dead] = 0, 0
        lane = cur.argmax(axis=1)
        top = cur[every, lane]
        rise = top > best
        best[rise], where[rise], edits[rise] = top[rise], at[every, lane][rise] + 1, cur_e[every, lane][rise]
        prev, prev_e = cur, cur_e
    return best, where, edits


def longest_run(doc_words: list[str], item_words: list[str]) -> int:
    """Longest run of consecutive words that both have."""
    where: dict[str, list[int]] = {}
    for i, w in enumerate(item_words):
        where.setdefault(w, []).append(i)
    best, prev = 0, {}
    for w in doc_words:
        cur = {}
        for i in where.get(w, ()):
            cur[i] = prev.get(i - 1, 0) + 1
            best = max(best, cur[i])
        prev = cur
    return best


def search(docs: list[tuple[object, bytes]], index: ItemIndex, edits: int = EDITS) -> list[tuple]:
    """(doc id, item id, run, score, edits, end in the document) of every region of a batch of normal texts that verifies."""
    joined = b"\n".join(t for _, t in docs)
    text = np.frombuffer(joined, dtype=np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for _, t in docs])
    at, place = index.located(qgrams(joined))
    found = []
    for x, y in stretches(at, index.count[place], starts[1:], MAX_HITS, index.reach):
        pos, item, ipos = index.hits(at[x:y], place[x:y])
        found += bands(pos, item, ipos, np.searchsorted(starts, pos, side="right") - 1, index, edits)
    if not found:
        return []
    found = list({(d, k, a, b): (d, k, low, a, b) for d, k, low, a, b in reversed(found)}.values())  # most regions lie whole in two bands
    doc, k, low, a, b = (np.array(x) for x in zip(*found, strict=True))
    score, end, wrong = banded_alignments(text, starts[doc], starts[doc + 1] - 1, [index.texts[i] for i in k.tolist()], low - edits, 4 * edits + 3)
    out = []
    for i in np.flatnonzero(score >= index.score[k]).tolist():
        d, begin, stop = int(doc[i]), int(starts[doc[i]]), int(starts[doc[i] + 1]) - 1
        # q-grams between the indexed ones may reach STEP further
        x, y = joined.rfind(b" ", begin, max(int(a[i]) - STEP, begin)) + 1 or begin, joined.find(b" ", min(int(b[i]) + STEP, stop) - 1, stop)
        run = longest_run(joined[max(x, begin) : y if y >= 0 else stop].decode(errors="ignore").split(" "), index.words[int(k[i])])
        out.append((docs[d][0], index.ids[int(k[i])], run, int(score[i]), int(wrong[i]), int(end[i]) - begin))
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, least_words: int = 13, edits: int = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, run_words, aligned_score, edits, doc_end): items found in documents, wholly or in part.

    ``run_words`` is the longest run of equal consecutive words in the region; ``aligned_score`` and ``edits`` are
    those of the best local alignment, which ends at ``doc_end`` of the normal text.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    source = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).alias("i"), F.col(passage).alias("p"))
    kind, ikind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, {item_id} {ikind}, run_words int, aligned_score int, edits int, doc_end int"
    total = source.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = None
    for b in range(blocks):
        part = source if blocks == 1 else source.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r.i, r.p) for r in part.toLocalIterator()])

        def scan(frames, sent=sent):
            index = ItemIndex(sorted(sent.value), least_words, edits)
            for f in frames:
                rows, held, size = [], [], 0
                for d, t in zip(f["d"], f["t"], strict=True):
                    norm = " ".join(words(t)).encode()
                    held.append((d, norm))
                    size += len(norm)
                    if size > BATCH_CHARS:
                        rows.extend(search(held, index, edits))
                        held, size = [], 0
                if held:
                    rows.extend(search(held, index, edits))
                yield pd.DataFrame(rows, columns=[doc_id, item_id, "run_words", "aligned_score", "edits", "doc_end"])

        found = docs.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    keys = [doc_id, item_id]
    best = F.max_by(F.struct("run_words", "aligned_score", "edits", "doc_end"), F.struct("run_words", "aligned_score"))
    return out.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
