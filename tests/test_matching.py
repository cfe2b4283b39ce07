"""Best matches against a plain loop, whatever is frequent and however rows and queries are cut."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching, retrieval

WORDS = [f"w{i}" for i in range(30)] + ["net", "sales"]


def _plain(queries, rows, k, fill, kinds):
    terms = lambda t: (w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    out = {}
    for corpus in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == corpus]
        df = Counter(t for r in own for t in set(terms(r[2])))
        idf = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, n in df.items()}

        def unit(text, idf=idf):
            v = {t: n * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
            size = math.sqrt(sum(x * x for x in v.values()))
            return {t: x / size for t, x in v.items()}

        vectors = {r[0]: unit(r[2]) for r in own}
        for key, c, text, ticker, year, kind, labels in queries:
            if c != corpus:
                continue
            u, got = unit(text), []
            fits = [r for r in own if (not ticker or ticker.upper() == (r[3] or "").upper()) and (not year or year.upper() == (r[4] or "").upper())]
            for variant, wanted in kinds.items():
                got = []
                for d, _, low, _, _, section, source in fits:
                    s = sum(x * vectors[d].get(t, 0.0) for t, x in u.items())
                    if s and (wanted is None or source in wanted):
                        b = 1.0
                        if kind == "numeric_fact" and source == "table_row":
                            b = 1.75 * (1.35 if section == "Item 7" else 1.0) * (2.5 if labels and all(t in low for t in labels) else 1.0)
                        got.append((-round(s * b, 6), d))
                got = sorted(got)[:k]
                rest = sorted(r[0] for r in fits if r[0] not in {d for _, d in got}) if fill else []
                for i, (s, d) in enumerate([*got, *((0.0, d) for d in rest)][:k]):
                    out[key, variant, i + 1] = (d, -s)
    return out


@pytest.mark.parametrize("frequent, part, block, fill", [(None, None, None, True), (20, 40, 15, True), (0, 40, 15, False)])
def test_best_matches_against_a_loop(spark, frequent, part, block, fill):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, r.choice("xy"), text(r.randint(0, 9)), r.choice(["A", "a", "B", None]), r.choice(["2024", "2023"]), r.choice(["Item 7", None]), r.choice(["table_row", "narrative", None])) for i in range(120)]
    rows += [(200 + i, "x", rows[i][2], *rows[i][3:]) for i in range(40)]  # equal scores
    queries = [(f"q{i}", r.choice("xy"), text(r.randint(0, 6)) + (" unknown" if i % 3 else ""), r.choice(["a", "B", "C", ""]), r.choice(["2024", None]), r.choice(["numeric_fact", "negative"]), r.choice([[], ["w1"], ["sales"]])) for i in range(40)]
    kinds = {"": None} if fill else {"all": None, "table": ("table_row",)}
    d = spark.createDataFrame(rows, "d long, corpus string, text string, ticker string, year string, section_id string, source_type string").withColumns({"words": matching.word_hashes(F.col("text")), "low": F.col("text")})
    q = spark.createDataFrame(queries, "q string, corpus string, text string, ticker string, year string, question_type string, row_terms array<string>").withColumn("words", matching.word_hashes(F.col("text")))
    got = matching.best_matches(q, d, "q", "d", 3, ["ticker", "year"], "corpus", True, fill, kinds, frequent, part, block).collect()
    want = _plain(queries, rows, 3, fill, kinds)
    assert len(got) == len(want) and {(x.q, x.variant, x["rank"]): x.d for x in got} == {k: d for k, (d, _) in want.items()}
    assert all(abs(want[x.q, x.variant, x["rank"]][1] - x.score) < 2e-6 for x in got)


def test_no_rows_or_queries(spark):
    d = spark.createDataFrame([], "d long, ticker string, section_id string, source_type string, low string, words array<bigint>")
    q = spark.createDataFrame([(1, "A", "negative", [], [7])], "q int, ticker string, question_type string, row_terms array<string>, words array<bigint>")
    assert matching.best_matches(q, d, "q", "d", 3, ["ticker"]).count() == 0
    d = spark.createDataFrame([(1, "A", None, None, None, None)], d.schema)
    assert matching.best_matches(q.where("false"), d, "q", "d", 3, ["ticker"]).count() == 0
    assert [tuple(r) for r in matching.best_matches(q, d, "q", "d", 3, ["ticker"]).collect()] == [(1, 1, "", 0.0, 1)]


def test_questions_with_many_terms_go_in_halves(spark):
    d = spark.createDataFrame([(i, [i, i + 1]) for i in range(50)], "d long, words array<bigint>").selectExpr("*", "'A' ticker", "'' section_id", "'' source_type", "'' low")
    q = spark.createDataFrame([(i, [i]) for i in range(50)], "q int, words array<bigint>").selectExpr("*", "'A' ticker", "'' question_type", "array('') row_terms")
    whole, halves = (matching.best_matches(q, d, "q", "d", 2, ["ticker"], fill=False, frequent=n) for n in (None, 40))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect())) and whole.count() > 50


def test_joined_coverage_reads_as_the_whole(spark):
    texts = [["Sales of the", "unit rose, $3"], ["", "the", " a "], ["x.", ".y"], ["an", "unit"], []]
    df = spark.createDataFrame([(t, w) for t in texts for w in ("of unit", "unit rose 3", "x. .y", "unit", "the", "")], "t array<string>, w string")
    none = F.lit(None).cast("string")
    whole = retrieval.T.answer_coverage(F.array_join("t", "\n"), F.col("w"), none, F.lit(None).cast("array<string>"))
    parts = retrieval.covers(F.transform("t", retrieval.T.normalize_answer), retrieval.wanted(F.col("w"), none, F.lit(None).cast("array<string>")))
    assert df.where(~whole.eqNullSafe(parts)).count() == 0


def test_terms_that_are_not_known_are_joined(spark):
    """Several cells and blocks, and terms of several rows that no task is told."""
    test_best_matches_against_a_loop(spark, 200, 40, 15, True)


def test_known_terms_pass_the_driver_in_slices(spark, monkeypatch):
    """However many terms every task is told, the driver's memory holds few at once; results are those of the loop."""
    kind, held = type(spark.range(1)), []
    whole = kind.toArrow

    def counted(df):
        t = whole(df)
        held.append(t.num_rows)
        return t

    monkeypatch.setattr(kind, "toArrow", counted)
    monkeypatch.setattr(matching, "SLICE", 100, raising=False)
    test_best_matches_against_a_loop(spark, None, 40, 15, True)
    assert sum(held) > 400 and max(held) < 200


@pytest.mark.parametrize("small", [True, False])
def test_slices_of_known_terms_are_the_whole(spark, monkeypatch, small):
    ends = [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    r = random.Random(3)
    df = {h: i + 2 for i, h in enumerate({*ends, *(r.randrange(-(1 << 63), 1 << 63) for _ in range(200))})}
    t = spark.createDataFrame(list(df.items()), "h long, df long")
    monkeypatch.setattr(matching, "SLICE", 30)
    h, n, told = matching._known(t.where("df % 3 = 0"), t.where("df > 50"), 200, small)
    want = sorted(h for h, n in df.items() if n % 3 == 0 or n > 50)
    assert h.tolist() == want and n.tolist() == [df[x] for x in want] and told.tolist() == [df[x] % 3 == 0 for x in want]
    assert n.dtype == ("int32" if small else "int64")
    assert [len(x) for x in matching._known(t.where("false"), t.where("false"), 0, small)] == [0, 0, 0]
