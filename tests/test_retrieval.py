"""Retrieval, evidence and evaluation on small cases."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerloom.operators import curation, evaluation, retrieval
from ledgerloom.operators.sorted_runs import numbered

ASKED = "pos int, question_type string, ticker string, year string, source_section string, gold_evidence_text string, answer string, answer_aliases array<string>"
FOUND = "pos int, rank int, score double, chunk_id string, text string, ticker string, year string, section_id string, source_type string"


def test_diagnoses_keep_every_question(spark):
    q = [
        (1, "text_fact", "A", "2024", "Item 7", "sales rose", "rose", []), (2, "text_fact", "A", "2024", "Item 7", "sales rose", "rose", None), (3, "numeric_fact", "A", None, None, "12 million", "12", []), (4, "text_fact", None, None, None, "sales rose", "rose", []),
        (5, "text_fact", "B", None, None, "sales rose", "rose", []), (6, "text_fact", "A", None, "Item 8", "costs", "costs", []), (7, "text_fact", "A", None, None, "costs", "costs", []), (8, None, None, None, None, None, None, None),
    ]
    r = [(1, 1, 0.5, "x", "Sales rose.", "a", "2024", "Item 7", "narrative"), (3, 1, 0.5, "y", "nothing", "A", None, None, "narrative"), (4, 1, 0.1, "z", "A forward-looking word", "A", None, None, None), (5, 1, 0.2, "x", "none", "A", None, None, None), (6, 1, 0.2, "x", "none", "A", None, "Item 7", None), (7, 1, 0.2, "x", None, "A", None, "Item 7", None)]
    got = {d.pos: d for d in retrieval.diagnostics(spark.createDataFrame(r, FOUND), spark.createDataFrame(q, ASKED), "pos").collect()}
    assert {k: d.noise_reason for k, d in got.items()} == {1: "none", 2: "retrieval_miss", 3: "table_label_missing", 4: "boilerplate", 5: "wrong_company", 6: "wrong_section", 7: "answer_split_across_chunks", 8: "retrieval_miss"}
    assert got[2].coverage_at_3 is False and got[2].source_accuracy_at_3 is False and got[2].section_accuracy_at_3 is False and got[4].source_accuracy_at_3 is None and got[1].matched_chunk_id == "x" and got[2].results == 0
    assert retrieval.diagnostics(spark.createDataFrame([], FOUND), spark.createDataFrame(q, ASKED), "pos").where("noise_reason = 'retrieval_miss'").count() == 8


def test_random_context(spark):
    docs = spark.createDataFrame([(i * 7,) for i in range(40)], "k long")
    q = spark.createDataFrame([(i,) for i in range(400)], "pos int")
    got = retrieval.random_context(q, docs, "pos", "k", 3).collect()
    by = Counter(r.pos for r in got)
    assert len(by) == 400 and set(by.values()) == {3} and len({(r.pos, r.k) for r in got}) == 1200
    drawn = Counter(r.k for r in got)
    assert len(drawn) == 40 and 10 <= min(drawn.values()) and max(drawn.values()) <= 60
    assert {r.k for r in retrieval.random_context(q.limit(1), docs.limit(2), "pos", "k", 3).collect()} == {r.k for r in docs.limit(2).collect()}
    assert retrieval.random_context(q, docs.where("false"), "pos", "k", 3).count() == 0 and retrieval.random_context(q.where("false"), docs, "pos", "k", 3).count() == 0


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(i * i % 1009,) for i in range(300)], "k long").distinct()
    got = sorted((r.number, r.k) for r in numbered(df, "k", 7).collect())
    assert [n for n, _ in got] == list(range(len(got))) and [k for _, k in got] == sorted(k for _, k in got)


def test_search_and_saved_index(spark, tmp_path):
    rows = [(1, "a", "net sales rose", "A", "2024", "Alpha Corp"), (2, "b", "net income fell", "B", "2024", "Beta Inc"), (3, "c", "the weather", "A", "2023", None), (4, "d", "net sales", None, None, "alphabet")]
    chunks = spark.createDataFrame(rows, "chunk_key long, chunk_id string, text string, ticker string, year string, company string")
    counts = retrieval.term_counts(chunks, "chunk_key", "text")
    weights = retrieval.idf(counts, 4)
    find = lambda q, **f: [r.chunk_id for r in retrieval.search(chunks, counts, weights, q, 2, f).collect()]
    assert find("net sales") == ["d", "a"] and find("net sales", company="ALPHA") == ["d", "a"] and find("net sales", ticker="a", year="2024") == ["a"] and find("zebra") == ["a", "b"] and find("", ticker="nobody") == []
    assert retrieval.filters_of({"ticker": "A", "year": None}) == {"ticker": "A"} and retrieval.filters_of({"ticker": "A"}, open_corpus=True) == {}
    posted = retrieval.postings(counts, weights, chunks, "chunk_key", ["ticker"])
    retrieval.save_index(posted, str(tmp_path / "i"), 4)
    back = retrieval.load_index(spark, str(tmp_path / "i"))
    key = lambda df: sorted((r.chunk_key, r.term, round(r.w, 9), r["_ticker"] or "") for r in df.collect())
    assert key(back) == key(posted) and key(retrieval.load_index(spark, str(tmp_path / "i"), ["net sales"], 4)) == [x for x in key(posted) if x[1] == "net sales"]
    assert retrieval.timed(chunks)[1] > 0


def test_dense_against_all_pairs(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (32_768, 3):
        got = {(x.q, x["rank"]): x.d for x in retrieval.dense_top_k(df.where("id % 20 = 0"), df, "id", "v", 4, block).collect()}
        assert len(got) == 60 and all(got[q, k + 1] == np.lexsort((np.arange(300), -np.round(u @ u[q], 6)))[k] for q in range(0, 300, 20) for k in range(4))
    assert retrieval.dense_top_k(df.where("false"), df, "id", "v", 4).count() == 0


def _plain_fuzzy(text, evidence):
    if not evidence:
        return False
    if evidence in text:
        return True
    w = len(evidence)
    return any(SequenceMatcher(None, text[a : a + w], evidence).ratio() >= 0.82 for a in range(0, max(1, len(text) - w + 1), max(1, w // 4)))


def test_fuzzy_evidence_against_a_loop(spark):
    texts = ["net sales rose 4 percent on higher volumes in every region", "net sale rose 4 percents on higher volume in some region", "cash fell", "", "sales rose"]
    for t in texts:
        for e in [*texts, "rose 4 percent on higher volumes", "rose 5 percent on highest volumes", "x" * 40]:
            assert curation.fuzzy_contains(t, e) is _plain_fuzzy(t, e), (t, e)
    assert curation.fuzzy_contains(None, "a") is False and curation.fuzzy_contains("a", None) is False
    chunks = spark.createDataFrame([(1, "c1", "Net sale rose 4 percents on higher volume in some region", None), (2, "c2", "Cash fell.", None)], "chunk_key long, chunk_id string, text string, ingested_at timestamp")
    q = spark.createDataFrame([(1, "net sales rose 4 percent on higher volumes in every region", "zz", [], ["c1"]), (2, "something else was said", "zz", None, ["c2", "gone"]), (3, None, None, None, None), (4, "cash fell", "zz", [], ["c2"])], "pos long, gold_evidence_text string, answer string, answer_aliases array<string>, relevant_chunk_ids array<string>")
    got = {r.pos: (r.ids, r.missing, r.covered, r.supported) for r in curation.evidence_state(q, chunks).collect()}
    assert got == {1: (1, 0, False, True), 2: (2, 1, False, False), 3: (0, 0, False, False), 4: (1, 0, True, True)}


def test_gates_and_sanity(spark):
    rows = [("r", f"q{i}", s, "text_fact", 1.0 if s == "oracle_gpt" else 0.5, 2.0, 0.4, 1.0) for i in range(60) for s in evaluation.SYSTEMS] + [("s", "q1", "baseline_gpt", "negative", None, 1.0, 0.5, 9.0)]
    scored = spark.createDataFrame(rows, "run_id string, question_id string, system string, question_type string, answer_coverage_at_3 double, gold_answer_perplexity double, token_f1 double, total_latency_seconds double")
    q = spark.createDataFrame([(i, f"q{i}", "e", ["c"] if i % 2 else None, False, None) for i in range(60)], "pos int, question_id string, gold_evidence_text string, relevant_chunk_ids array<string>, expected_refusal boolean, evidence_valid boolean")
    got = {r.run_id: r for r in evaluation.run_gates(scored, q).collect()}
    assert got["r"].reasons == "" and got["r"].valid and got["r"].missing_evidence_rate == 0.5 and got["r"].retrieval_quality == "weak"
    assert got["s"].reasons == "questions<50;negative<5;oracle_coverage<0.95;missing_predictions:rag_gpt_tfidf_top3;missing_predictions:oracle_gpt;missing_predictions:random_context_gpt"
    assert "question_source_not_verified" in evaluation.run_gates(scored, q, source="custom").first().reasons
    one = evaluation.oracle_sanity(scored.where("run_id = 'r'")).first()
    assert one.passed and one.reasons == "" and not one.warning_only
    lost = evaluation.oracle_sanity(scored.where("run_id = 's'")).first()
    assert not lost.passed and lost.reasons == "oracle_system_missing;oracle_answer_coverage<0.95;oracle_question_count_below_minimum"
    slow = evaluation.oracle_sanity(scored.where("run_id = 'r'").withColumn("total_latency_seconds", F.lit(9.0))).first()
    assert slow.passed and slow.warning_only


def test_failures_know_the_noise(spark):
    df = spark.createDataFrame([("rag_gpt_tfidf_top3", False, "wrong_section"), ("baseline_gpt", None, "boilerplate"), ("rag_gpt_tfidf_top3", False, "retrieval_miss"), ("oracle_gpt", None, None)], "system string, answer_coverage_at_3 boolean, noise_reason string")
    no = F.lit(None).cast("boolean")
    df = df.withColumns({"exact_match": F.lit(False), "numeric_accuracy": no, "token_f1": F.lit(0.1), "expected_refusal": F.lit(False), "refusal_correct": no, "numeric_available": F.lit(False), "generation_error": F.lit(False)})
    assert [r.f for r in df.select(evaluation.failure(F.col("noise_reason")).alias("f")).collect()] == ["wrong_section", "boilerplate", "retrieval_miss", "retrieval_noise"]


def test_standardized(spark):
    q = spark.createDataFrame([(1, "aapl", "unknown", None, "5", None, None, "numeric_fact"), (2, "ZZZ", None, "2020", "5", "5", ["x"], "numeric_fact"), (3, None, None, "", "5", "", [], "negative")], "pos int, ticker string, company string, year string, answer string, normalized_answer string, answer_aliases array<string>, question_type string").withColumn("fiscal_year", F.lit("2019"))
    got = [(r.company, r.year, r.normalized_answer, r.answer_aliases) for r in curation.standardized(q).orderBy("pos").collect()]
    assert got == [("Apple", "2019", "5", ["5"]), (None, "2020", "5", ["x"]), (None, "2019", "5", [])]
