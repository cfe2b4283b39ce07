"""Queries over the evaluation operators: all predictions against the questions they answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.operators.chunking import DEFAULT_CONFIG
from ledgerloom.plans import query
from ledgerloom.plans import sqltext as S
from ledgerloom.plans.retrieval_queries import CONFIG_SQL, config_diagnostics
from ledgerloom.session import table


def _scored(spark, d):
    return E.details(table(spark, d, "evaluation_details"), table(spark, d, "questions_verified"))


_TOK = "list_filter(string_split({0}, ' '), lambda t: t <> '')"


def _f1(pred: str, answers: str) -> str:
    p, g = _TOK.format(S.norm(pred)), _TOK.format(S.norm("a"))
    shared = f"list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t)))))"
    one = f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN coalesce({shared}, 0) = 0 THEN 0.0 ELSE 2 * ({shared} / len({p})) * ({shared} / len({g})) / ({shared} / len({p}) + {shared} / len({g})) END"
    return f"round(coalesce(list_max(list_transform({answers}, lambda a: {one})), 0.0), 6)"


_MEAS = [c for c in E.MEANS if c.endswith(("seconds", "tokens", "loss", "perplexity"))]
_COV = lambda x: S.covered(x, "q.gold_evidence_text", "q.answer", "q.answer_aliases")
_FIT = """((coalesce(q.ticker, '') = '' OR upper(coalesce(m.ticker, '')) = upper(q.ticker)) AND (coalesce(q."year", '') = '' OR coalesce(m."year", '') = q."year"))"""
_SOME = lambda f: f"len(list_filter(coalesce(e.retrieved_metadata, []), lambda m: {f})) > 0"
DETAILS = f"""
WITH q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos DESC) AS rn FROM questions_verified) WHERE rn = 1),
j AS (SELECT e.*, q.question_type, coalesce(q.expected_refusal, FALSE) AS due, list_distinct(list_filter(list_concat([coalesce(q.answer, e.gold_answer)], coalesce(q.answer_aliases, [])), lambda x: x IS NOT NULL)) AS answers, coalesce(e.prediction, '') AS pred,
 CASE WHEN len(coalesce(e.retrieved_texts, [])) > 0 THEN {_COV("array_to_string(list_slice(e.retrieved_texts, 1, 1), chr(10))")} END AS c1, CASE WHEN coalesce(e.retrieved_context, '') <> '' THEN {_COV('e.retrieved_context')} END AS c3,
 CASE WHEN len(coalesce(e.retrieved_texts, [])) > 0 THEN {_COV("array_to_string(list_slice(e.retrieved_texts, 1, 5), chr(10))")} END AS c5, CASE WHEN coalesce(q.ticker, '') <> '' OR coalesce(q."year", '') <> '' THEN {_SOME(_FIT)} END AS src,
 CASE WHEN coalesce(q.source_section, '') <> '' THEN {_SOME("coalesce(m.section_id, '') = q.source_section")} END AS sec, CASE WHEN q.question_type = 'numeric_fact' THEN {_SOME("coalesce(m.source_type, '') = 'table_row'")} END AS trow
 FROM evaluation_details e LEFT JOIN q ON q.question_id = e.question_id),
k AS (SELECT *, flatten(list_transform(answers, lambda a: {S.nums('a')})) AS gold FROM j),
l AS (SELECT *, len(gold) > 0 AS num, {S.near(S.nums('pred'), 'gold')} AS gen, CASE WHEN len(gold) > 0 AND coalesce(extracted_numeric_answer, '') <> '' THEN {S.near(S.nums('extracted_numeric_answer'), 'gold')} END AS ext, {S.refusal('pred')} AS ref FROM k),
det AS (SELECT detail_id, question_id, system, chunk_config, run_id, question_type, {', '.join(_MEAS)}, list_contains(list_transform(answers, lambda a: {S.norm('a')}), {S.norm('pred')}) AS exact_match, {_f1('pred', 'answers')} AS token_f1,
 num AS numeric_available, CASE WHEN num THEN gen END AS numeric_generation_accuracy, ext AS numeric_extraction_accuracy, CASE WHEN num THEN gen OR coalesce(ext, FALSE) END AS numeric_accuracy, due AS expected_refusal, CASE WHEN due THEN ref END AS refusal_correct,
 CASE WHEN due THEN NOT ref END AS hallucinated_on_negative, c1 AS answer_coverage_at_1, c3 AS answer_coverage_at_3, c5 AS answer_coverage_at_5, src AS source_accuracy_at_3, sec AS section_accuracy_at_3, trow AS table_row_recall_at_3, starts_with(pred, '[generation error') AS generation_error FROM l)
"""
_M = ", ".join(f"round(avg(CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END), 8) AS {c}" for c in E.MEANS)
_OK = "coalesce(exact_match, FALSE) OR coalesce(numeric_accuracy, FALSE) OR coalesce(token_f1, 0) >= 0.8"
_FAILURE = f"""CASE WHEN {_OK} THEN 'correct' WHEN noise_reason IN ('wrong_section', 'wrong_company', 'boilerplate', 'answer_split_across_chunks') THEN noise_reason WHEN system = 'rag_gpt_tfidf_top3' AND NOT answer_coverage_at_3 THEN 'retrieval_miss'
 WHEN system = 'rag_gpt_tfidf_top3' AND answer_coverage_at_3 THEN 'generator_hallucination' WHEN expected_refusal AND NOT refusal_correct THEN 'generator_refusal_error' WHEN numeric_available AND NOT numeric_accuracy THEN 'numeric_unit_error'
 WHEN generation_error THEN 'tokenizer_or_generation_issue' ELSE 'retrieval_noise' END"""


_NOISY = "WITH dc AS (" + CONFIG_SQL + " SELECT qc, noise_reason FROM diag)," + DETAILS.strip().removeprefix("WITH") + f", fd AS (SELECT det.*, dc.noise_reason FROM det LEFT JOIN dc ON dc.qc = det.question_id || '|' || coalesce(det.chunk_config, '{DEFAULT_CONFIG}'))"


def _noisy(spark, d):
    """Scored predictions with why their configuration's retrieval failed their question."""
    noise = config_diagnostics(spark, d).select(F.col("question_id").alias("_q"), F.col("chunk_config").alias("_c"), "noise_reason")
    s = _scored(spark, d)
    return s.join(noise, (F.col("question_id") == F.col("_q")) & (F.coalesce("chunk_config", F.lit(DEFAULT_CONFIG)) == F.col("_c")), "left").drop("_q", "_c").withColumn("failure", E.failure(F.col("noise_reason")))


@query("e_details", DETAILS + "SELECT * FROM det")
def e_details(spark, d):
    """Every prediction with its metrics recomputed: exact match, token F1, numbers, refusals, coverage and sources."""
    return _scored(spark, d)


@query("a3_system_summary", DETAILS + f"SELECT system, count(*) AS predictions, {_M} FROM det GROUP BY system")
def a3(spark, d):
    return E.by_system(_scored(spark, d)).drop("perplexity_delta")


@query("a4_baseline_delta", DETAILS + ", s AS (SELECT run_id, system, round(avg(gold_answer_perplexity), 8) AS p FROM det GROUP BY ALL) SELECT run_id, system, p AS gold_answer_perplexity, round(p - max(CASE WHEN system = 'baseline_gpt' THEN p END) OVER (PARTITION BY run_id), 6) AS perplexity_delta FROM s")
def a4(spark, d):
    return E.by_system(_scored(spark, d), "run_id", "system").select("run_id", "system", "gold_answer_perplexity", "perplexity_delta")


_KINDS = list(E.KINDS)
_FEW = ", ".join(f"CASE WHEN {k} > 0 AND {k} < 5 THEN '{k}<5' END" for k in _KINDS)
_LOST = ", ".join(f"CASE WHEN n_{s} <> questions THEN 'missing_predictions:{s}' END" for s in E.SYSTEMS)
_GATES = DETAILS + f""", rq AS (SELECT run_id, question_id, max(question_type) AS t FROM det GROUP BY ALL),
ev AS (SELECT question_id, CASE WHEN NOT coalesce(expected_refusal, FALSE) THEN CAST((evidence_valid IS NOT DISTINCT FROM FALSE) OR coalesce(gold_evidence_text, '') = '' OR coalesce(len(relevant_chunk_ids), 0) < 1 AS DOUBLE) END AS missing FROM q),
rc AS (SELECT run_id, count(*) AS questions, {', '.join(f"count(*) FILTER (t = '{k}') AS {k}" for k in _KINDS)}, coalesce(avg(missing), 0.0) AS missing FROM rq LEFT JOIN ev USING (question_id) GROUP BY run_id),
o AS (SELECT run_id, avg(CAST(answer_coverage_at_3 AS INT)) FILTER (system = 'oracle_gpt') AS oracle, avg(CAST(answer_coverage_at_3 AS INT)) FILTER (system = 'rag_gpt_tfidf_top3') AS rag, {', '.join(f"count(*) FILTER (system = '{s}') AS n_{s}" for s in E.SYSTEMS)} FROM det GROUP BY run_id),
gates AS (SELECT run_id, questions, array_to_string(list_filter([CASE WHEN questions < 50 THEN 'questions<50' END, {_FEW}, CASE WHEN oracle IS NULL OR oracle < 0.95 THEN 'oracle_coverage<0.95' END, {_LOST}], lambda x: x IS NOT NULL), ';') AS reasons, questions < 50 AS is_smoke_test,
 round(oracle, 6) AS oracle_coverage, round(rag, 6) AS rag_coverage, CASE WHEN rag IS NULL OR rag < 0.7 THEN 'weak' ELSE 'acceptable' END AS retrieval_quality, round(missing, 6) AS missing_evidence_rate FROM rc JOIN o USING (run_id))
"""


@query("a5_run_gates", _GATES + "SELECT *, reasons = '' AS valid FROM gates")
def a5(spark, d):
    return E.run_gates(_scored(spark, d), table(spark, d, "questions_verified"))


@query("a6_missing_evidence", """SELECT coalesce(avg(CASE WHEN NOT coalesce(expected_refusal, FALSE) THEN CAST((evidence_valid IS NOT DISTINCT FROM FALSE) OR coalesce(gold_evidence_text, '') = '' OR coalesce(len(relevant_chunk_ids), 0) < 1 AS DOUBLE) END), 0.0) AS missing_evidence_rate FROM questions_verified""")
def a6(spark, d):
    return E.missing_evidence_rate(table(spark, d, "questions_verified"))


@query("a8_run_metadata", _GATES + """SELECT gates.*, reasons = '' AS valid, r.* EXCLUDE (run_id) FROM gates JOIN (SELECT run_id, max(checkpoint_path) AS checkpoint_path, max(tokenizer_dir) AS tokenizer_dir, max(tokenizer_vocab_size) AS tokenizer_vocab_size, string_agg(DISTINCT system, ',' ORDER BY system) AS systems FROM evaluation_details GROUP BY run_id) r USING (run_id)""")
def a8(spark, d):
    e = table(spark, d, "evaluation_details")
    return E.run_metadata(E.run_gates(_scored(spark, d), table(spark, d, "questions_verified")), e)


@query("a9_config_rollup", DETAILS + f"SELECT chunk_config, system, question_type, count(*) AS predictions, {_M} FROM det GROUP BY chunk_config, system, question_type")
def a9(spark, d):
    return E.by_system(_scored(spark, d), "chunk_config", "question_type", "system").drop("perplexity_delta")


_KINDS_OF_FAILURE = ["correct", "wrong_section", "wrong_company", "boilerplate", "answer_split_across_chunks", "retrieval_miss", "generator_hallucination", "generator_refusal_error", "numeric_unit_error", "tokenizer_or_generation_issue", "retrieval_noise"]


@query("a9_failure_pivot", _NOISY + f", f AS (SELECT chunk_config, {_FAILURE} AS failure FROM fd) SELECT chunk_config, {', '.join(f'''count(*) FILTER (failure = '{k}') AS {k}''' for k in _KINDS_OF_FAILURE)} FROM f GROUP BY chunk_config")
def a9_failures(spark, d):
    return _noisy(spark, d).groupBy("chunk_config").pivot("failure", _KINDS_OF_FAILURE).agg(F.count(F.lit(1))).na.fill(0, _KINDS_OF_FAILURE)


@query(
    "a10_best_config",
    "WITH dc AS (" + CONFIG_SQL + " SELECT q.cfg AS chunk_config, count(*) FILTER (noise_reason = 'wrong_section') AS wrong_section, count(*) FILTER (noise_reason = 'answer_split_across_chunks') AS split FROM diag JOIN q USING (qc) GROUP BY q.cfg)," + DETAILS.strip().removeprefix("WITH")
    + f""", r AS (SELECT coalesce(chunk_config, '{DEFAULT_CONFIG}') AS chunk_config, round(avg(CAST(answer_coverage_at_3 AS INT)), 6) AS coverage, round(avg(gold_answer_perplexity), 6) AS perplexity, round(avg(total_latency_seconds), 6) AS latency FROM det WHERE system = 'rag_gpt_tfidf_top3' GROUP BY 1)
SELECT chunk_config, coverage, wrong_section, split, perplexity, latency FROM r JOIN dc USING (chunk_config) ORDER BY coverage DESC NULLS LAST, wrong_section, split, perplexity NULLS LAST, latency NULLS LAST, chunk_config LIMIT 1""",
)
def a10(spark, d):
    """The best configuration: a report of one row."""
    noise = config_diagnostics(spark, d).groupBy("chunk_config").agg(*(F.count(F.when(F.col("noise_reason") == n, 1)).alias(a) for n, a in (("wrong_section", "wrong_section"), ("answer_split_across_chunks", "split"))))
    rag = _scored(spark, d).where(F.col("system") == E.RAG).withColumn("chunk_config", F.coalesce("chunk_config", F.lit(DEFAULT_CONFIG)))
    mean = rag.groupBy("chunk_config").agg(F.round(F.avg(F.col("answer_coverage_at_3").cast("double")), 6).alias("coverage"), F.round(F.avg("gold_answer_perplexity"), 6).alias("perplexity"), F.round(F.avg("total_latency_seconds"), 6).alias("latency"))
    return E.best_config(mean.join(noise, "chunk_config").select("chunk_config", "coverage", "wrong_section", "split", "perplexity", "latency"))


@query("a13_failures", _NOISY + f" SELECT system, {_FAILURE} AS failure, count(*) AS predictions FROM fd GROUP BY ALL")
def a13(spark, d):
    return _noisy(spark, d).groupBy("system", "failure").agg(F.count("*").alias("predictions"))


@query("a12_failure_matrix", _NOISY + f", f AS (SELECT question_id, system, {_FAILURE} AS failure FROM fd) SELECT question_id, {', '.join(f'''min(failure) FILTER (system = '{s}') AS {s}''' for s in E.SYSTEMS)} FROM f GROUP BY question_id")
def a12(spark, d):
    return _noisy(spark, d).groupBy("question_id").pivot("system", list(E.SYSTEMS)).agg(F.min("failure"))


_LAST = lambda s, c: f"max({c}) FILTER (system = '{s}')"


@query(
    "a14_exemplars",
    DETAILS + f""", lp AS (SELECT question_id, system, arg_max({_OK}, detail_id) AS ok, max_by(struct_pack(c := answer_coverage_at_3), detail_id).c AS cov, min(detail_id) AS first FROM det WHERE question_id IS NOT NULL GROUP BY ALL),
w AS (SELECT question_id, min(first) AS first, {', '.join(f"bool_or(ok) FILTER (system = '{s}') AS {a}_ok, count(*) FILTER (system = '{s}') > 0 AS {a}_has" for a, s in zip('brox', E.SYSTEMS, strict=True))}, bool_or(cov) FILTER (system = 'rag_gpt_tfidf_top3') AS cov FROM lp GROUP BY question_id),
z AS (SELECT question_id, first, unnest(list_filter([CASE WHEN coalesce(r_ok, FALSE) AND NOT coalesce(b_ok, FALSE) THEN 'rag_succeeds_baseline_fails' END, CASE WHEN coalesce(b_ok, FALSE) AND NOT coalesce(r_ok, FALSE) THEN 'baseline_succeeds_rag_fails' END, CASE WHEN NOT cov THEN 'retrieval_miss' END,
 CASE WHEN cov AND NOT coalesce(r_ok, FALSE) THEN 'retrieval_finds_evidence_generator_fails' END, CASE WHEN x_has AND NOT x_ok THEN 'random_context_fails' END, CASE WHEN coalesce(o_ok, FALSE) THEN 'oracle_succeeds' END, CASE WHEN o_has AND NOT o_ok THEN 'oracle_fails' END], lambda x: x IS NOT NULL)) AS category FROM w WHERE b_has OR r_has)
SELECT category, arg_min(question_id, first) AS question_id FROM z GROUP BY category""",
)
def a14(spark, d):
    """The first question of each way in which the systems differ: a report."""
    return E.exemplars(_scored(spark, d))


_MEAN = lambda s, c: f"avg({c}) FILTER (system = '{s}')"


@query(
    "a7_oracle_sanity",
    DETAILS + f""", s AS (SELECT count(DISTINCT question_id) AS questions, count(*) FILTER (system = 'oracle_gpt') > 0 AS o, count(*) FILTER (system = 'baseline_gpt') > 0 AS b, {_MEAN('oracle_gpt', 'CAST(answer_coverage_at_3 AS INT)')} AS c, {_MEAN('baseline_gpt', 'gold_answer_perplexity')} AS bp, {_MEAN('oracle_gpt', 'gold_answer_perplexity')} AS op,
 {_MEAN('baseline_gpt', 'token_f1')} AS bf, {_MEAN('oracle_gpt', 'token_f1')} AS of_, {_MEAN('oracle_gpt', 'total_latency_seconds')} AS lat FROM det),
x AS (SELECT *, list_filter([CASE WHEN NOT o THEN 'oracle_system_missing' END, CASE WHEN NOT b THEN 'baseline_system_missing' END, CASE WHEN c IS NULL OR c < 0.95 THEN 'oracle_answer_coverage<0.95' END, CASE WHEN o AND b AND op > bp THEN 'oracle_perplexity_not_better_than_baseline' END,
 CASE WHEN o AND b AND of_ < bf THEN 'oracle_token_f1_below_baseline' END, CASE WHEN o AND b AND lat > 5 THEN 'oracle_latency_warning' END, CASE WHEN questions < 50 THEN 'oracle_question_count_below_minimum' END], lambda r: r IS NOT NULL) AS r FROM s)
SELECT len(list_filter(r, lambda z: z <> 'oracle_latency_warning')) = 0 AS passed, array_to_string(r, ';') = 'oracle_latency_warning' AS warning_only, array_to_string(r, ';') AS reasons, round(c, 6) AS oracle_coverage, round(bp, 6) AS baseline_perplexity, round(op, 6) AS oracle_perplexity,
 round(op - bp, 6) AS perplexity_delta, round(of_ - bf, 6) AS token_f1_delta FROM x""",
)
def a7(spark, d):
    """How the system with the right context does against the baseline, and what speaks against it: one row."""
    return E.oracle_sanity(_scored(spark, d))


@query(
    "a11_question_types",
    DETAILS + """SELECT coalesce(chunk_config, 'unknown') AS chunk_config, coalesce(question_type, 'unknown') AS question_type, count(*) AS predictions, round(avg(token_f1), 8) AS token_f1, round(avg(CAST(numeric_accuracy AS INT)), 8) AS numeric_accuracy, round(avg(CAST(answer_coverage_at_3 AS INT)), 8) AS coverage_at_3,
 round(avg(gold_answer_perplexity), 8) AS gold_answer_perplexity FROM det WHERE system = 'rag_gpt_tfidf_top3' GROUP BY ALL""",
)
def a11(spark, d):
    """The retrieving system by kind of question and configuration."""
    rag = _scored(spark, d).where(F.col("system") == E.RAG)
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 8)
    return rag.groupBy(F.coalesce("chunk_config", F.lit("unknown")).alias("chunk_config"), F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(
        F.count("*").alias("predictions"), mean("token_f1").alias("token_f1"), mean("numeric_accuracy").alias("numeric_accuracy"), mean("answer_coverage_at_3").alias("coverage_at_3"), mean("gold_answer_perplexity").alias("gold_answer_perplexity"))
