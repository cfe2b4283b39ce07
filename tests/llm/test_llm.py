"""Text operators: brute force on small fixtures, defined results on odd input, held-out accuracy."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import abuse, boilerplate, copies, leakage, mixing, pairs, splitting, tokens, truncation

CLASH = ["_k", "_t", "_n", "_id", "_q", "_row", "_doc", "key", "id", "d", "t", "i", "p", "doc", "text2", "line_no", "piece_no", "first_id", "copies", "score", "source2", "field", "run", "_part"]


def clashing(df):
    """The frame with extra columns that carry names used inside."""
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


# ---- splitting


def test_pieces_keep_the_rules():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(0, 120)
        text = ""
        for i in range(n):
            text += r.choice(["w", "longer", "Item", "x.", "end.", "go;"]) + r.choice([" ", " ", " ", "\n", "\n\n", "\t", "\nItem 7. "])
        limit, overlap = r.randint(1, 30), r.randint(0, 12)
        words = re.findall(r"[^ \t\n]+", text)
        got = splitting.pieces(text, limit, overlap)
        assert (not got) == (not words)
        at = 0
        for a, b, x, y, _ in got:
            assert 0 < b - a <= limit and a <= at < b and at - a <= min(overlap, limit - 1)
            assert re.findall(r"[^ \t\n]+", text[x:y]) == words[a:b]
            at = b
        assert at == len(words)


def test_cuts_at_sentences_and_sections():
    text = "One two three. Four five six seven. Eight nine ten eleven twelve."
    assert [text[x:y] for _, _, x, y, _ in splitting.pieces(text, 8, 0)] == ["One two three. Four five six seven.", "Eight nine ten eleven twelve."]
    text = "a b c\nItem 7. d e f"
    assert [text[x:y] for _, _, x, y, _ in splitting.pieces(text, 5, 2)] == ["a b c", "Item 7. d e f"]


def test_range_max_goes_right():
    v = np.array([1, 3, 2, 3, 0, 3, 1], dtype=np.int8)
    t = splitting.RangeMax(v)
    for a in range(7):
        for b in range(a, 7):
            best = max(v[a : b + 1])
            assert t.query(a, b) == (best, max(i for i in range(a, b + 1) if v[i] == best))


def test_split_table(spark):
    limits = spark.createDataFrame([("s", 3, 1), ("n", None, 1), (None, 1, 1)], "chunk_config string, max_words int, overlap_words int")
    rows = [(1, "a b c d e f", "s"), (2, "a b c", "s"), (3, None, "s"), (4, "", "s"), (5, "a b c d", "n"), (6, "a b c d", None), (7, "w " * 20_000, "s"), (1, "a b c d e f", "s")]
    items = clashing(spark.createDataFrame(rows, "chunk_key long, text string, cfg string"))
    got = splitting.split_oversized(items, limits, "chunk_key", "text", F.col("cfg"), "chunk_config", "max_words", "overlap_words")
    per = collections.Counter(r.chunk_key for r in got.collect())
    assert set(per) == {1, 7} and per[1] == 2 * len(splitting.pieces("a b c d e f", 3, 1))
    assert splitting.split_oversized(items.where("false"), limits, "chunk_key", "text", F.col("cfg"), "chunk_config", "max_words", "overlap_words").count() == 0
    assert splitting.split_oversized(items, limits.where("false"), "chunk_key", "text", F.col("cfg"), "chunk_config", "max_words", "overlap_words").count() == 0


# ---- copies


@pytest.mark.parametrize(("a", "b", "same"), [("25,490", "25 490", True), ("3,774.5", "3774.5", True), ("37.74", "3774", False), ("(996)", "996", False), ("-5", "5", False), ("a-5", "a5", True), ("A b", "ab.", True), ("—", None, True), ("*x*", "X", True), ("1. 5", "15", True)])
def test_cells(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(copies.canonical_text(F.col("a")).alias("x"), copies.canonical_text(F.col("b")).alias("y")).first()
    assert (r.x == r.y) is same


def test_copies_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, f"k{r.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}" if i % 50 else None) for i in range(600)] + [(5, "k0"), (None, "k1")]
    df = clashing(spark.createDataFrame(rows, "record_id long, title string"))
    got = collections.Counter((x.first_id, x.record_id) for x in copies.copy_groups(df, "record_id", F.coalesce("title", F.lit("")), 5).collect())
    first = {}
    for i, k in rows:
        if i is not None:
            first[k] = min(first.get(k, i), i)
    assert got == collections.Counter((first[k], i) for i, k in rows if i is not None)
    assert {x.first_id: x.copies for x in copies.collapse_copies(df, "record_id", F.coalesce("title", F.lit("")), 5).collect()} == dict(collections.Counter(first[k] for i, k in rows if i is not None))
    assert copies.copy_groups(df.where("false"), "record_id", F.col("title")).count() == 0


def test_table_content(spark):
    df = spark.createDataFrame([(1, "T a", [["x", "1"], ["y", None]]), (2, "t-A", [["Y"], ["", "1", "X"], None]), (3, None, None), (4, "", [[]]), (5, "t a", [["x"], ["1", "y"]])], "record_id long, table_title string, rows array<array<string>>")
    got = {(r.first_id, r.record_id) for r in copies.copy_groups(df, "record_id", copies.canonical_table(F.col("table_title"), F.col("rows"))).collect()}
    assert got == {(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)}


# ---- repeated lines


def test_repeated_lines(spark):
    rows = [(i, f"c{i % 9}", "A" if i < 20 else None, f"Page {i} of 9\n\nbody {chr(97 + i)}\n page  {i}\tOF 9 ") for i in range(26)] + [(90, None, "A", "page 1 of 9"), (91, "c1", "A", None), (92, "c1", "A", ""), (93, "c1", "A", "x" * 100_000)]
    df = clashing(spark.createDataFrame(rows, "chunk_key long, chunk_id string, ticker string, text string"))
    lines = boilerplate.repeated_lines(df, "chunk_key", "chunk_id", "ticker", "text", 8)
    assert {(r.chunk_key, r.line_no) for r in lines.collect()} == {(i, n) for i in range(20) for n in (0, 3)} | {(90, 0)}
    out = {r.chunk_key: (r.text, r.n_removed) for r in boilerplate.without_lines(df, lines, "chunk_key", "text").collect()}
    assert out[0] == ("\nbody a", 2) and out[21] == (rows[21][3], 0) and out[91] == (None, 0) and out[92] == ("", 0) and out[90] == ("", 1)
    assert boilerplate.repeated_lines(df, "chunk_key", "chunk_id", "ticker", "text", 10).count() == 0
    assert boilerplate.repeated_lines(df.where("false"), "chunk_key", "chunk_id", "ticker", "text").count() == 0
    assert boilerplate.repeated_lines(df, "chunk_key", "chunk_id", "ticker", "text", 8, 2.0).count() == 0


# ---- leakage


def brute_runs(doc, item, n=13):
    w, v = leakage.words(doc), leakage.words(item)
    grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
    return any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1))


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["a", "of", "net", "sales", "rose", "über", "2024", "covenant", "lenders", "x1", "the", "registry", "shows"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.randint(10, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for i in range(150):
        w = say(r.randint(0, 60))
        if i % 2:
            p = leakage.words(items[r.randrange(25)][1])
            a = r.randrange(len(p))
            b = min(len(p), a + r.randint(8, 30))
            cut = p[a:b]
            if r.random() < 0.3 and cut:
                cut[r.randrange(len(cut))] = "changed"
            w = w[:20] + cut + w[20:]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    docs += [(900, None), (901, ""), (902, "word " * 30_000)]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    it = clashing(spark.createDataFrame(items, "item_id long, passage string"))
    want = {(i, j) for i, t in docs for j, p in items if t and p and brute_runs(t, p)}
    for block in (leakage.BLOCK_CHARS, 1000):
        got = {(x.doc_id, x.item_id) for x in leakage.leaks(d, it, "doc_id", "text", "item_id", "passage", block_chars=block).where("run_words >= 13").collect()}
        assert got == want and len(want) > 20
    assert leakage.leaks(d.where("false"), it, "doc_id", "text", "item_id", "passage").count() == 0
    assert leakage.leaks(d, it.where("false"), "doc_id", "text", "item_id", "passage").count() == 0


def test_leaks_in_slices(monkeypatch):
    """Whatever is listed at once, within documents and across them, the same runs are found."""
    r = random.Random(6)
    vocab = ["net", "sales", "rose", "covenant", "lenders", "registry", "shows", "2024"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(13, 30)))) for i in range(30)]
    docs = []
    for i in range(12):
        w = [r.choice(vocab) for _ in range(r.choice([5, 60, 900]))]
        for _ in range(len(w) // 60):
            a = r.randrange(len(w))
            w[a:a] = items[r.randrange(30)][1].split()
        docs.append((i, " ".join(w)))
    want = {(i, j) for i, t in docs for j, p in items if brute_runs(t, p)}
    index = leakage.ItemIndex(items, 13)
    for most in (leakage.MAX_HITS, 5000, 300, 20):
        monkeypatch.setattr(leakage, "MAX_HITS", most)
        assert {(d, k) for d, k, run, *_ in leakage.search([(i, t.encode()) for i, t in docs], index) if run >= 13} == want and len(want) > 10


def test_qgrams_are_the_bytes():
    b = bytes(range(1, 30))
    assert [int(x).to_bytes(8, "little") for x in leakage.qgrams(b)] == [b[i : i + 8] for i in range(len(b) - 7)]
    assert len(leakage.qgrams(b"short")) == 0


# ---- mixing


def test_allotment():
    a = mixing.allot(100, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 10, "b": 1000, "c": 1000, "d": 50})
    assert a["a"] == 10 and abs(sum(a.values()) - 100) < 1e-9 and abs(a["b"] / a["c"] - 1.5) < 1e-9 and a["d"] == 0
    assert mixing.allot(0, {"a": 1.0}, {"a": 5}) == {"a": 0.0} and mixing.allot(10, {"a": 1.0}, {"a": 3}) == {"a": 3}


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.randint(1, 200)) for i in range(6000)] + [(7000, "a", 0), (7001, "a", 0)]
    sizes = spark.createDataFrame(rows, "doc long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.5, 4), ("c", 0.3, 1), ("none", 0.1, 3), (None, 0.5, 1), ("b", None, None)], "source string, share double, repeats int")
    plan = mixing.mix_plan(sizes, targets, "source", "share", "repeats")
    drawn = mixing.sample(sizes, plan)
    most = {"a": 2, "b": 4, "c": 1}
    got = drawn.collect()
    assert all(1 <= x.copies <= most[x.source] for x in got) and all(x.doc < 7000 for x in got)
    tokens_of = collections.Counter()
    for x in got:
        tokens_of[x.source] += x.copies * x.n_tokens
    for p in plan.collect():
        assert abs(tokens_of[p.source] - p.allotted) <= 0.01 * p.allotted + 400
    assert sorted(got) == sorted(mixing.sample(sizes, plan).collect())  # the same again
    mixing_shares = {x.source: x.share_reached for x in mixing.shares(drawn, plan).collect()}
    assert abs(sum(mixing_shares.values()) - 1) < 1e-9 and mixing_shares["none"] == 0
    assert mixing.sample(sizes.where("false"), mixing.mix_plan(sizes.where("false"), targets, "source", "share", "repeats")).count() == 0


def test_ranks_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    sizes = spark.createDataFrame([(i, "a", 100) for i in range(1000)], "doc long, source string, n_tokens long")
    plan = mixing.mix_plan(sizes, spark.createDataFrame([("a", 1.0, 1)], "source string, share double, repeats int"), "source", "share", "repeats")
    half = plan.withColumn("copies_each", F.lit(0.25))
    assert mixing.sample(sizes, half).count() in (249, 250, 251) and mixing.sample(sizes, plan).count() == 1000


def test_tokens(spark):
    got = spark.createDataFrame([("net sales rose",), ("",), (None,)], "t string").select(tokens.token_count(F.col("t")).alias("n")).collect()
    assert [g.n for g in got] == [3, 0, 0]


# ---- truncation and pairs

SUBJECTS = ["net sales", "gross profit", "lease cost", "free cash flow", "royalty income", "interest expense", "operating income"]
CAUSES = ["higher volumes", "lower prices", "supply shortages", "a richer mix", "contract renewals", "weaker orders"]
PLACES = ["in the export business", "in the dealer network", "in the northern segment", "in the retail channel"]


def sentences(n, seed=0):
    r = random.Random(seed)
    names = ["".join(r.choice(["Kor", "Vel", "Zem", "Bri", "Hal", "Jun"]) + r.choice(["da", "mo", "ti", "ve"]) + r.choice(["dex", "tis", "vis", "mora"])) for _ in range(200)]
    made = lambda: f"{r.choice(names)} {r.choice(SUBJECTS)} {r.choice(['rose', 'fell', 'grew'])} mainly because of {r.choice(CAUSES)} and {r.choice(CAUSES)} {r.choice(PLACES)}."
    return [" ".join(made() for _ in range(r.randint(1, 3))) for _ in range(n)], r


def test_truncation_held_out(spark):
    texts, r = sentences(3000)
    cut = {i for i in range(len(texts)) if i % 10 == 0}
    rows = []
    for i, t in enumerate(texts):
        if i in cut:
            at = r.randint(20, len(t) - 12)
            t = t[:at] + r.choice(["", "...", " ", "<|endoftext|>"])
        else:
            t += r.choice(["", "", " ", "\n", "<|endoftext|>"])
        rows.append((i, f"Why did it change in {i}?", t))
    odd = [(90000, "q", None), (90001, "q", ""), (90002, "What is it?", "What is it?"), (90003, "q", "<|endoftext|>"), (90004, None, "-"), (90006, "q", "a\0b \0 c\0"), (90007, "q", "\0"), (90005, "q", " ".join(x for i, x in enumerate(texts) if i % 10))]
    df = clashing(spark.createDataFrame(rows + odd, "detail_id long, question string, prediction string"))
    got = {x.detail_id: x for x in truncation.truncated(df, "detail_id", "question", ["prediction"]).collect()}
    assert len(got) == len(rows) + len(odd)
    # cuts that happen to fall on the end of a sentence are none
    real = {i for i in cut if not re.search(r"[.]$", truncation.proper(rows[i][2]))}
    found = {i for i, x in got.items() if x.truncated and i < 90000}
    assert len(found & real) / len(real) > 0.93 and len(found - cut) / len(rows) < 0.01
    assert all(got[i].log_odds is None and not got[i].truncated for i in (90000, 90001, 90002, 90003, 90004)) and not got[90005].truncated


def test_truncation_empty(spark):
    df = spark.createDataFrame([], "detail_id long, question string, prediction string")
    assert truncation.truncated(df, "detail_id", "question", ["prediction"]).count() == 0


def test_tails_are_those_of_the_whole_text():
    """A tail masked from as far back as it needs is that of the whole text's skeleton, whatever stands there."""
    r = random.Random(8)
    for _ in range(300):
        words = [r.choice(["a", "the", "Kordadex", "9" * r.randint(1, 400), "Z" + "e" * r.randint(1, 700), "in", "12,345.6", "rose."]) for _ in range(r.randint(1, 120))]
        t = " ".join(words)
        assert truncation.tail_of(t) == truncation.skeleton(t)[-truncation.KEEP :]
        own = truncation.masked(t)[1]
        assert truncation._last_token(t) == (own[-1] if own and t.endswith(own[-1]) else "")


def test_filter_changes_no_count(spark, monkeypatch):
    texts, r = sentences(300, 12)
    df = spark.createDataFrame([(i, f"q{i}", t[: r.randint(9, len(t))] if i % 5 == 0 else t) for i, t in enumerate(texts)], "detail_id long, question string, prediction string")
    odds = lambda: {x.detail_id: x.log_odds for x in truncation.truncated(df, "detail_id", "question", ["prediction"]).collect()}
    want = odds()
    monkeypatch.setattr(truncation, "FILTER_BITS", 8)
    monkeypatch.setattr(truncation, "FLUSH", 50)
    got = odds()
    assert want.keys() == got.keys() and all(abs((want[i] or 0) - (got[i] or 0)) < 1e-9 for i in want)


def test_proper():
    for t in ("a b", "a b ", "a b...", "a b…", "a b<|endoftext|>", "a b\n\n[end of context]", "a b\n---", "a b&#x2", "a b\\u20"):
        assert truncation.proper(t) == "a b", t
    assert truncation.proper("") == "" and truncation.proper("...") == ""


@pytest.mark.parametrize(("text", "copy"), [("What is it?", True), ("  what  is it??", True), ("Question: What is it?", True), ('"What is it?" What is it?', True), ("What is it? " * 200, True), ("What is it? " * 200 + "It is 5.", False), ("What is it? It is 5.", False), ("It is 5.", False)])
def test_copies_of_questions(text, copy):
    assert truncation.is_copy(text, "What is it?") is copy


GERMAN = ["Der Umsatz von Kordadex ist wegen der schwachen Nachfrage im Exportgeschäft gesunken.", "Die Verträge mit Velmotis laufen aus, und der Rohertrag hängt nun von Zemvedex ab."]


# Short sentences by language, labelled by hand.
LABELLED = {
    "en": ["Kordadex sold a richer mix, see Item 1A.", "Net sales: 28.53 billion U.S. dollars.", "Main reason: a la carte orders.", "Rio de Janeiro and El Paso grew.", "Flooring grew 4.5 percent at Saint-Étienne.", "Volumes up, prices down."],
    "de": ["Flilimra erreichte im Geschaeftsjahr 2024 28,53 Milliarden US-Dollar.", "Flilimra erreichte im Geschäftsjahr 2024 28,53 Milliarden US-Dollar.", "Der Gewinn stieg um 4 Prozent.", "Umsatz: 3,2 Millionen Euro gegenüber Vorjahr.", "Höhere Preise trugen zum Wachstum bei."],
    "fr": ["Flilimra a atteint 28,53 milliards de dollars.", "Le bénéfice net a augmenté.", "Chiffre d'affaires en hausse.", "Les ventes ont baissé depuis janvier."],
    "es": ["Flilimra alcanzó 28,53 mil millones de dólares.", "Los ingresos aumentaron en el ejercicio.", "Ventas mayores en febrero.", "El beneficio subió."],
}


def test_foreign_sentences():
    asked = {"en": "What was the revenue of Flilimra in fiscal 2024?", "de": "Wie hoch war der Umsatz von Flilimra im Jahr 2024?", "fr": "Quel était le chiffre d'affaires de Flilimra pour l'exercice 2024?", "es": "¿Cuáles fueron los ingresos de Flilimra en el ejercicio 2024?"}
    for own, q in asked.items():
        for lang, texts in LABELLED.items():
            for t in texts:
                if own == lang or own == "en":  # every text to an English question, and to a question in its own language
                    assert (pairs.foreign(q, t) >= 2) is (own != lang), (own, t)
    assert pairs.foreign(asked["de"], "The revenue of Flilimra was higher than in 2023.") >= 2


def test_pairs_held_out(spark):
    texts, r = sentences(2400, 4)
    rows, want = [], {}
    for i, t in enumerate(texts):
        q = f"What drove the result of {r.choice(['Kordadex', 'Velmotis', 'Zemvedex'])} in fiscal 20{i % 20 + 10}?"
        kind = i % 12
        figure = r.random() < 0.6
        if figure:
            q = f"How much revenue did {r.choice(['Kordadex', 'Velmotis', 'Zemvedex'])} report in fiscal 20{i % 20 + 10}?"
            if kind not in (3, 4):
                t = r.choice(["{} billion dollars", "It was {} million.", "Revenue came to {} million dollars in that year.", "{}"]).format(r.randint(20, 9999))
        if kind == 0:
            t, want[i] = r.choice(["", None, "...", "<|endoftext|>", "[ ]"]), "empty"
        elif kind == 1:
            t, want[i] = r.choice([q, q.upper(), f"Q: {q}"]), "copy"
        elif kind == 2 and not figure and r.random() < 0.7:
            pass  # refusals are rare among answers in prose, against those that lack an asked figure: what mining goes by
        elif kind == 2:
            who = r.choice(["Kordadex", "Velmotis", "Zemvedex", "Haldatis", "Junmovis"])
            t = r.choice(["There is no information on {} in the text, so I cannot answer.", "I do not know the answer to this.", "The passages shown say nothing on {}.", "Sorry, I can't say what {} did.", "Not enough information on {}.", "No answer can be given for {} from this excerpt.", "Unfortunately, the filing does not mention {}.", "I am unable to answer that."]).format(who)
            t, want[i] = r.choice(["", "Unfortunately: "]) + t + r.choice(["", " Please consult the full filing."]), "refusal"
        elif kind == 3:
            t = t[: r.randint(25, len(t) - 20)]
            if not t.endswith("."):
                want[i] = "truncated"
        elif kind == 4:
            t, want[i] = r.choice(GERMAN), "other_language"
        rows.append((i, q, t, False))
    rows.append((80000, "What is it?", "I do not know the answer to this.", True))
    rows.append((80001, None, None, None))
    df = clashing(spark.createDataFrame(rows, "detail_id long, question string, prediction string, expected_refusal boolean"))
    got = {x.detail_id: x.defect for x in pairs.defects(df, "detail_id", "question", ["prediction"], "expected_refusal").collect()}
    assert len(got) == len(rows) and got[80000] is None and got[80001] == "empty"
    for name in pairs.LABELS:
        true, found = {i for i, w in want.items() if w == name}, {i for i, g in got.items() if g == name and i < 80000}
        assert len(true & found) / len(true) > (0.8 if name == "refusal" else 0.9), name  # wordings are mined, none of them is given
        assert len(found - true) <= 0.03 * len(rows), name
    empty = pairs.defects(df.where("false"), "detail_id", "question", ["prediction"], "expected_refusal")
    assert empty.columns == ["detail_id", "field", "defect"] and empty.count() == 0


def test_pairs_cuts_from_all_rows(spark, monkeypatch):
    texts, r = sentences(600, 6)
    rows = [(i, f"What drove the result in fiscal 20{i % 20 + 10}?", t[: r.randint(25, len(t) - 12)] if i % 6 == 0 else t, False) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "detail_id long, question string, prediction string, expected_refusal boolean")
    monkeypatch.setattr(pairs, "SAMPLE", 200)
    seen, valley = [], pairs._valley
    monkeypatch.setattr(pairs, "_valley", lambda real, made, rows=None: seen.append(len(real) if rows is None else rows.sum()) or valley(real, made, rows))
    found = lambda: {x.detail_id for x in pairs.defects(df, "detail_id", "question", ["prediction"], "expected_refusal").where("defect = 'truncated'").collect()}
    for cut in (-6.0, -1e9):
        monkeypatch.setattr(truncation, "valley", lambda histogram, cut=cut: cut)
        cut_off = {x.detail_id for x in truncation.truncated(df, "detail_id", "question", ["prediction"]).where("truncated").collect()}
        flagged = found()
        assert flagged <= cut_off and len(flagged) >= 0.9 * len(cut_off) and bool(cut_off) is (cut == -6.0)
    assert seen[-1] == len(rows)
    scores = np.round(np.random.default_rng(1).normal(-4, 1, 500), 1)
    at, n = np.unique(scores, return_counts=True)
    made = np.random.default_rng(2).normal(4, 1, 100)
    assert pairs._valley(at, made, n) == pairs._valley(scores, made)


# ---- abuse


def test_abuse_held_out(spark):
    texts, r = sentences(1500, 9)
    bad = ["You people at {} are filthy idiots, every one of you.", "Shut up about {}, nobody asked you, you disgusting pigs.", "Only worthless scum would buy {} shares, choke on them."]
    fine = ["{} sells pest control against rats, and trash bags for pigs."]
    docs, labels, true = [], [], set()
    for i, t in enumerate(texts):
        if i % 8 == 0:
            s = r.choice(bad).format("Kordadex")
            if r.random() < 0.3:
                s = s.upper()
            if r.random() < 0.3:
                s = s.replace("idiots", "id.iots").replace("pigs", "p1gs").replace("scum", "s c u m")
            t, _ = t + "\n" + s, true.add(i)
        elif i % 9 == 0:
            t = t + "\n" + fine[0].format("Velmotis")
        docs.append((i, t, "s"))
        if i < 800:
            labels.append((i, int(i in true) ^ int(r.random() < 0.02)))
    docs += [(9000, None, None), (9001, "", "s"), (9002, "short", "s"), (9003, texts[0] * 500, "s")]
    labels += [(None, 1), (9000, 1), (3, None), (4, 7), (5, 0), (5, 0), (77777, 1)]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    lab = clashing(spark.createDataFrame(labels, "doc_id long, toxic int"))
    model = abuse.train(d, lab, "doc_id", "text", "doc_id", "toxic")
    got = {x.doc_id: x for x in abuse.scored(d, model, "doc_id", "text", ["source"]).collect()}
    assert len(got) == len(docs) and got[9000].score is None and got[9001].score is None and got[9002].score is not None and not got[9003].abusive
    test = {i for i in true if i >= 800}
    found = {i for i, x in got.items() if x.abusive and 800 <= i < 9000}
    assert len(found & test) / len(test) > 0.9 and len(found - test) <= 0.1 * len(test)


def test_abuse_without_labels(spark):
    d = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for x in (lab, lab.where("false")):
        assert abuse.train(d, x, "doc_id", "text", "doc_id", "toxic") is None
    row = abuse.scored(d, None, "doc_id", "text").first()
    assert row.score is None and row.abusive is False
    assert abuse.train(d.where("false"), lab, "doc_id", "text", "doc_id", "toxic") is None


def test_scores_by_table_equal_scores_by_window():
    r = np.random.default_rng(0)
    model = abuse.Model(r.normal(size=abuse.FEATURES).astype(np.float32), 0.3, 0.0, 1.0)
    text = "Some words, and then a few more of them to fill two windows and a bit; 1234 times over and over again."
    w = abuse.windows(abuse.codes(text), 1)
    own = [abuse._scores(abuse._ids(x[None]), model.weights, model.bias)[0] for x in w[:-1]]
    # within a longer text, a window's last characters pair with what follows it: equal but for its edge
    assert abs(abuse.score_texts([text], model)[0] - max(own)) < 6
