"""Abusive, hateful or sexually explicit passages, scored by a support vector machine on a subsequence kernel.

The kernel of two windows of text counts the subsequences of three and four characters they share, each
within a short span and discounted by its gaps, so inserted characters ("s.t.u.p.i.d") and left-out ones still
match. Nyström landmarks, drawn from the labelled windows, span the feature space; a squared-hinge machine is
fitted in it. As kernel and machine are linear in the subsequences, landmarks fold into one weight per
subsequence, so a corpus is scored by table look-ups, with the work proportional to its characters.

Labels are given for documents, some wrongly, while the passage is a sentence. Training therefore
alternates: each labelled-abusive document gives its highest windows as positives; documents without any
window on the positive side drop out as mislabelled. Windows are looked for along the whole of a document. The
threshold is calibrated on held-out folds, the highest window of whole clean documents and the scores of all documents.

The machine is fitted by one task on a bounded sample of labelled documents (``MAX_POSITIVE``, ``MAX_NEGATIVE`` documents by the
hash of their id, whole ones up to ``MAX_CHARS`` characters together; of clean ones ``CLEAN`` windows by chance and the ``HARD`` that score
highest); every document is scored on its whole text.

Defined results: null and blank texts score null and are no cases; a text shorter than a window is one window;
without both kinds of labels there is no model and every score is null; labels other than 0 and 1 and null ids
are left out; a document with several labels has their majority, ties being abusive; repeated document rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed

WINDOW, STRIDE = 56, 14
LANDMARKS, DECAY, ROUNDS, FOLDS = 400, 0.7, 6, 5
CLEAN, HARD, CANDIDATES = 6000, 1500, 5  # clean windows in the machine; windows kept of a labelled-abusive document
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 2000, 4000, 40_000_000
RIDGE = 3.0
BINS, CLEAN_BELOW = 20, 0.99  # bins of scores a unit; share of clean labelled documents that the threshold lies above
BATCH_CHARS = 1_000_000
_TAGS = re.compile(r"<[^<>]{1,80}>|&(?:[a-z]{2,6}|#x?[0-9a-f]{1,6});", re.I)
_SPACE = re.compile(r"\s+")
_OFFSETS = [(3, (0, *c)) for c in combinations(range(1, 5), 2)] + [(4, (0, *c)) for c in combinations(range(1, 6), 3)]
_WEIGHTS = np.array([DECAY ** (o[-1] + 1 - p) * (1.0 if p == 3 else 1.4) for p, o in _OFFSETS], dtype=np.float32)
_THREES, _FOURS = 1 << 15, 1 << 16
FEATURES = _THREES + _FOURS
_REACH = 6


def _alphabet() -> np.ndarray:
    table = np.full(256, 31, dtype=np.uint8)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = i + 1
    for c in "0123456789":
        table[ord(c)] = 27
    for c in " \n\t":
        table[ord(c)] = 0
    for c in ".,;:!?-'\"()":
        table[ord(c)] = 28
    for c in "@*$#":
        table[ord(c)] = 29
    return table


_ALPHABET = _alphabet()


def codes(text: str) -> np.ndarray:
    """Symbols of a text: letters without case or accents, white space squeezed, markup dropped."""
    plain = _SPACE.sub(" ", _TAGS.sub(" ", text)).strip().lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return _ALPHABET[np.frombuffer(plain.encode("latin-1", "replace"), dtype=np.uint8)]


def features(c: np.ndarray) -> np.ndarray:
    """Subsequence numbers, one row per start and one column per pattern of offsets; the text is padded at its end."""
    n = len(c)
    c = np.concatenate([c, np.zeros(_REACH, dtype=c.dtype)]).astype(np.int64)
    out = np.empty((n, len(_OFFSETS)), dtype=np.int32)
    for k, (p, off) in enumerate(_OFFSETS):
        code = c[off[0] : n + off[0]]
        for o in off[1:]:
            code = code * 32 + c[o : n + o]
        out[:, k] = code if p == 3 else _THREES + ((code * 2654435761 >> 7) & (_FOURS - 1))
    return out


def window_starts(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of the windows of a text of n symbols; the last one ends at its end."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, stride), n - WINDOW]


def windows(c: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Windows of a text, as rows of WINDOW symbols."""
    padded = c if len(c) >= WINDOW else np.concatenate([c, np.zeros(WINDOW - len(c), dtype=c.dtype)])
    return np.stack([padded[s : s + WINDOW] for s in window_starts(len(c), stride)])


class Model(NamedTuple):
    """Weight of each subsequence, the machine's bias, and the scores between which the threshold of a case lies."""

    weights: np.ndarray
    bias: float
    low: float
    high: float


def _ids(w: np.ndarray) -> np.ndarray:
    """(windows, starts, patterns) feature numbers of rows of symbols."""
    return np.stack([features(x) for x in w]) if len(w) else np.empty((0, WINDOW, len(_OFFSETS)), dtype=np.int32)


def _landmark_table(ids: np.ndarray) -> np.ndarray:
    table = np.zeros((FEATURES, len(ids)), dtype=np.float32)
    for m, x in enumerate(ids):
        np.add.at(table[:, m], x.ravel(), np.broadcast_to(_WEIGHTS, x.shape).ravel())
    table /= np.sqrt(np.maximum(np.einsum("fm,fm->m", table, table), 1e-9))
    return table


def _kernel(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of windows with the landmarks; windows have one length, so theirs needs no norm but a constant."""
    out = np.zeros((len(ids), table.shape[1]), dtype=np.float32)
    for a in range(0, len(ids), 256):
        part = ids[a : a + 256]
        for k, w in enumerate(_WEIGHTS):
            out[a : a + 256] += w * table[part[:, :, k]].sum(axis=1)
    return out / np.float32(WINDOW**0.5)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Squared-hinge machine with an L2 penalty, by Newton steps; the last column of x is ones and the last figure the bias."""
    w, penalty = start, np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-3
    before = None
    for _ in range(25):
        active = y * (x @ w) < 1
        if before is not None and np.array_equal(active, before):
            break
        xa = x[active]
        weighed = xa * weight[active, None]
        w = np.linalg.solve((xa.T @ weighed).astype(np.float64) + np.diag(penalty), weighed.T @ y[active].astype(np.float64)).astype(np.float32)
        before = active
    return w


def _scores(ids: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return (weights[ids] * _WEIGHTS).sum(axis=(1, 2)) / WINDOW**0.5 + bias


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the texts with gaps between, start of each)."""
    gap = WINDOW + _REACH
    sizes = np.array([len(c) + gap for c in texts])
    out = np.zeros(int(sizes.sum()) + _REACH, dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    for a, c in zip(starts.tolist(), texts, strict=True):
        out[a : a + len(c)] = c
    return out, starts


def _columns(joined: np.ndarray):
    """(weight, subsequence numbers at every start) of each pattern of offsets."""
    c = joined.astype(np.int64)
    n = len(joined) - _REACH
    for k, (p, off) in enumerate(_OFFSETS):
        code = c[off[0] : n + off[0]]
        for o in off[1:]:
            code = code * 32 + c[o : n + o]
        yield _WEIGHTS[k], code if p == 3 else _THREES + ((code * 2654435761 >> 7) & (_FOURS - 1))


def _slices(texts: list[np.ndarray]):
    """Runs of texts of about BATCH_CHARS symbols, a longer one alone."""
    held, size = [], 0
    for i, c in enumerate(texts):
        if held and size + len(c) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(c)
    if held:
        yield held


def all_scores(texts: list[np.ndarray], weights: np.ndarray, bias: float):
    """(index, scores of the windows at every offset) of each text, in order."""
    for part in _slices(texts):
        joined, starts = _joined([texts[i] for i in part])
        own = np.zeros(len(joined) - _REACH, dtype=np.float32)
        for w, ids in _columns(joined):
            own += w * weights[ids]
        total = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
        for i, at in zip(part, starts.tolist(), strict=True):
            last = at + max(len(texts[i]) - WINDOW, 0)
            yield i, (total[at + WINDOW : last + WINDOW + 1] - total[at : last + 1]) / WINDOW**0.5 + bias


def _window(c: np.ndarray, at: int) -> np.ndarray:
    out = np.zeros(WINDOW, dtype=np.uint8)
    part = c[at : at + WINDOW]
    out[: len(part)] = part
    return out


def _candidates(bags: list[np.ndarray], clean: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The windows of each bag richest in subsequences that several bags share and clean documents lack, at most ``most``, half a window apart."""
    usual, shared = np.zeros(FEATURES, dtype=np.float32), np.zeros(FEATURES, dtype=np.float32)
    for part in _slices(clean):
        for _, ids in _columns(_joined([clean[i] for i in part])[0]):
            usual += np.bincount(ids, minlength=FEATURES)
    for bag in bags:
        own = np.zeros(FEATURES, dtype=bool)
        own[features(bag).ravel()] = True
        shared += own
    rich = np.log((shared + 0.5) / (len(bags) + 1)) - np.log((usual + 0.5) / (len(clean) + 1))
    rich[(shared < max(2.0, len(bags) / 170)) | (rich < 0)] = 0
    out = []
    for i, score in all_scores(bags, rich, 0.0):
        at, kept = np.array(window_starts(len(bags[i]))), []  # at a stride, so that like passages give like windows
        score = score[at]
        for _ in range(most):
            best = int(score.argmax())
            if score[best] == -np.inf:
                break
            kept.append(_window(bags[i], int(at[best])))
            score[np.abs(at - at[best]) < WINDOW // 2] = -np.inf
        out.append(np.stack(kept))
    return out


def _alternate(phi_p: np.ndarray, owner: np.ndarray, n_bags: int, phi_n: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positive windows, held-out score of each, the mean of the last machines and one of all the chosen) after alternating between machines and their choice of windows.

    A window is judged by a machine that has not seen its bag, so a strange but single window finds no support.
    """
    fold_p, fold_n = rng.permutation(n_bags)[owner] % FOLDS, rng.integers(0, FOLDS, len(phi_n))
    chosen = np.ones(len(phi_p), dtype=bool)
    held = np.zeros(len(phi_p))
    v = [np.zeros(phi_p.shape[1], dtype=np.float32) for _ in range(FOLDS)]
    for r in range(ROUNDS):
        for f in range(FOLDS):
            v[f] = _machine(phi_p[chosen & (fold_p != f)], phi_n[fold_n != f], v[f])
            held[fold_p == f] = phi_p[fold_p == f] @ v[f]
        best = np.full(n_bags, -np.inf)
        np.maximum.at(best, owner, held)
        floor = -0.9 + 0.8 * min(r / (ROUNDS - 2), 1.0)
        chosen = (held >= best[owner] - 0.4) & (held > floor)
        if not chosen.any():
            chosen = held >= held.max()
    return chosen, held, (np.sum(v, axis=0) + _machine(phi_p[chosen], phi_n, v[0])) / (FOLDS + 1)


def _machine(pos: np.ndarray, neg: np.ndarray, start: np.ndarray) -> np.ndarray:
    up = max(1.0, 0.2 * len(neg) / max(len(pos), 1))
    return _fit(np.vstack([pos, neg]), np.r_[np.ones(len(pos)), -np.ones(len(neg))].astype(np.float32), np.r_[np.full(len(pos), up), np.ones(len(neg))].astype(np.float32), start)


def fit(docs: list[tuple[int, np.ndarray]], seed: int = 5) -> Model | None:
    """Model from labelled documents, each (label, symbols); None without both labels."""
    rng = np.random.default_rng(seed)
    bags, clean = ([c for label, c in docs if label == y and len(c)] for y in (1, 0))
    if not bags or not clean:
        return None
    cands = _candidates(bags, clean, CANDIDATES)
    pos, owner = np.concatenate(cands), np.repeat(np.arange(len(cands)), [len(x) for x in cands])
    sizes = np.array([max(len(c) - WINDOW, 0) + 1 for c in clean])
    drawn = rng.integers(0, int(sizes.sum()), CLEAN)  # windows at random offsets of all clean documents
    of = np.searchsorted(np.cumsum(sizes), drawn, side="right")
    base = np.stack([_window(clean[i], at) for i, at in zip(of.tolist(), (drawn - (np.cumsum(sizes) - sizes)[of]).tolist(), strict=True)])
    pos_ids, base_ids = _ids(pos), _ids(base)
    neg, neg_ids = base, base_ids
    one = lambda x: np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    for round_ in range(2):
        if round_ == 0:
            marks = pos[np.r_[rng.permutation(np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])), rng.permutation(len(pos))][: LANDMARKS // 2]]
        else:  # the clean windows that the machine takes for abuse join, as windows and as landmarks
            tops = [(float(s.max()), i, int(s.argmax())) for i, s in all_scores(clean, w, b)]
            hard = np.stack([_window(clean[i], at) for _, i, at in sorted(tops, reverse=True)[:HARD]])
            neg, neg_ids, top = np.concatenate([base, hard]), np.concatenate([base_ids, _ids(hard)]), pos[chosen]
            marks = np.concatenate([top[rng.permutation(len(top))[: LANDMARKS // 2]], hard[:: max(1, len(hard) // (LANDMARKS // 4))][: LANDMARKS // 4]])
        sample = np.concatenate([marks, neg[rng.permutation(len(neg))[: LANDMARKS - len(marks)]]])
        table = _landmark_table(_ids(sample))
        vals, vecs = np.linalg.eigh(_kernel(_ids(sample), table).astype(np.float64) + 1e-4 * np.eye(len(sample)))
        root = (vecs / np.sqrt(np.maximum(vals, 1e-4))).astype(np.float32)
        phi_p, phi_n = (one(_kernel(x, table) @ root) for x in (pos_ids, neg_ids))
        chosen, held, v = _alternate(phi_p, owner, len(cands), phi_n, rng)
        w, b = (table @ (root @ v[:-1])).astype(np.float32), float(v[-1])
    best = np.full(len(cands), -np.inf)
    np.maximum.at(best, owner, held)
    low = float(np.quantile([s.max() for _, s in all_scores(clean, w, b)], CLEAN_BELOW))
    abusive = best[best > low]  # the others are labelled by mistake, or not to be told
    return Model(w, b, low, max(float(np.median(abusive)) if len(abusive) else low, low + 2 / BINS))


def score_texts(texts: list[str | None], model: Model) -> list[float | None]:
    """Highest window score of each text, over all of it; None for null and blank ones."""
    out: list[float | None] = [None] * len(texts)
    coded = [(i, c) for i, t in enumerate(texts) if t and t.strip() and len(c := codes(t))]
    for k, s in all_scores([c for _, c in coded], model.weights, model.bias):
        out[coded[k][0]] = float(s.max())
    return out


def train(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str) -> Model | None:
    """Model from the labelled documents, fitted by one task; the sample is bounded, drawn by the hash of the label's id.

    Ids are drawn from the labels first, so the documents are read once and only those drawn are kept.
    """
    votes = labels.where(F.col(label_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(label_id).alias("l")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    drawn = [votes.where(F.col("y") == y).orderBy(F.xxhash64("l"), "l").limit(most) for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    known = rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("d") == F.col("l")).select(F.xxhash64("d").alias("h"), "d", "t", "y")

    def learn(frames):
        got = pd.concat(list(frames), ignore_index=True)
        docs, size = [], {0: 0, 1: 0}
        for t, y in got.sort_values(["h", "d"])[["t", "y"]].itertuples(index=False):
            if size[y] + len(t) <= MAX_CHARS // 2:
                docs.append((y, codes(t)))
                size[y] += len(t)
        m = fit(docs)
        yield pd.DataFrame([] if m is None else [(m.weights.tobytes(), *m[1:])], columns=["w", "b", "low", "high"])

    got = known.repartition(1).mapInPandas(learn, "w binary, b double, low double, high double").collect()
    return Model(np.frombuffer(bytes(got[0].w), dtype=np.float32), got[0].b, got[0].low, got[0].high) if got else None


def emptiest(histogram: dict[int, int], low: float, high: float) -> float:
    """The lowest score between two others around which about as few documents lie as anywhere there; bins are a twentieth wide."""
    crowd = {x: sum(histogram.get(x + d, 0) for d in range(-2, 2)) for x in range(round(low * BINS), round(high * BINS) + 1)}
    few = 1.5 * min(crowd.values()) + 2
    return min(x for x, n in crowd.items() if n <= few) / BINS


def scored(documents: DataFrame, model: Model | None, doc_id: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """Every document's id, the columns to keep, ``score`` and ``abusive``.

    The threshold lies in the emptiest place of all documents' scores between what nearly all clean labelled documents stay
    below and what half of the abusive ones reach, judged by machines that have not seen them.
    """
    rows = documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t"), *(F.col(k) for k in keep or []))
    if model is None:
        return rows.select(F.col("_d").alias(doc_id), *(keep or []), F.lit(None).cast("double").alias("score"), F.lit(False).alias("abusive"))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(score_texts(list(t), Model(*sent.value)), dtype="float64")

    out = checkpointed(rows.select(F.col("_d").alias(doc_id), *(keep or []), score("_t").alias("score")))
    near = out.where(F.col("score").between(model.low - 1, model.high + 1)).groupBy(F.floor(F.col("score") * BINS).alias("at")).agg(F.count("*").alias("n")).collect()
    cut = emptiest({int(r["at"]): r.n for r in near}, model.low, model.high)
    return out.withColumn("abusive", F.coalesce(F.col("score") >= F.lit(cut), F.lit(False)))
