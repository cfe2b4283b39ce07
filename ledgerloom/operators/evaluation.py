"""Scoring predictions and rolling scores up: details, systems, gates, failures and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

BASELINE, RAG, ORACLE = "baseline_gpt", "rag_gpt_tfidf_top3", "oracle_gpt"
MEANS = [
    "exact_match", "token_f1", "numeric_accuracy", "numeric_generation_accuracy", "numeric_extraction_accuracy", "refusal_correct", "hallucinated_on_negative", "generation_latency_seconds", "retrieval_latency_seconds", "total_latency_seconds",
    "prompt_tokens", "completion_tokens", "gold_answer_loss", "gold_answer_perplexity", "answer_coverage_at_1", "answer_coverage_at_3", "answer_coverage_at_5", "source_accuracy_at_3", "section_accuracy_at_3", "table_row_recall_at_3",
]


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key, the last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_r")).select("_r.*")


def details(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """Predictions with their metrics; null where a metric doesn't apply. A question given twice counts as given last."""
    cols = ["question_id", "answer", "answer_aliases", "ticker", "year", "question_type", "source_section", "gold_evidence_text", F.col("expected_refusal").alias("refusal_due")]
    q = last_by(questions, "question_id", "pos").select(*cols)
    keep = ["detail_id", "question_id", "system", "chunk_config", "run_id", "prediction", "gold_answer", "extracted_numeric_answer", "retrieved_metadata", "retrieved_texts", "retrieved_context", *[c for c in MEANS if c.endswith(("seconds", "tokens", "loss", "perplexity"))]]
    j = predictions.select(*keep).join(q, "question_id", "left")
    none = F.array().cast("array<string>")
    answers = F.array_distinct(F.filter(F.concat(F.array(F.coalesce("answer", "gold_answer")), F.coalesce("answer_aliases", none)), lambda x: x.isNotNull()))
    j = j.withColumn("_answers", answers).withColumn("_gold", F.flatten(F.transform("_answers", T.numeric_values)))
    pred = F.coalesce("prediction", F.lit(""))
    j = j.withColumn("_numeric", F.size("_gold") > 0).withColumn("_gen", T.numeric_match(T.numeric_values(pred), F.col("_gold")))
    extracted = F.coalesce("extracted_numeric_answer", F.lit(""))
    j = j.withColumn("_ext", F.when(F.col("_numeric") & (extracted != ""), T.numeric_match(T.numeric_values(extracted), F.col("_gold"))))
    due = F.coalesce("refusal_due", F.lit(False))
    refused = T.is_refusal(pred)
    covers = lambda text: T.answer_coverage(text, F.col("gold_evidence_text"), F.col("answer"), F.col("answer_aliases"))
    texts = F.coalesce("retrieved_texts", none)
    at = lambda k: F.when(F.size(texts) > 0, covers(F.array_join(F.slice(texts, 1, k), "\n")))
    ticker, year, section = (F.coalesce(c, F.lit("")) for c in ("ticker", "year", "source_section"))
    metas = F.coalesce("retrieved_metadata", F.array().cast(predictions.schema["retrieved_metadata"].dataType))
    some = lambda f: F.when(F.size(metas) == 0, False).otherwise(F.exists(metas, f))
    source = F.when((ticker != "") | (year != ""), some(lambda m: ((ticker == "") | (F.upper(F.coalesce(m["ticker"], F.lit(""))) == F.upper(ticker))) & ((year == "") | (F.coalesce(m["year"], F.lit("")) == year))))
    return j.select(
        "detail_id", "question_id", "system", "chunk_config", "run_id", "question_type", *[c for c in MEANS if c.endswith(("seconds", "tokens", "loss", "perplexity"))],
        T.exact_match(pred, F.col("_answers")).alias("exact_match"), F.round(T.token_f1(pred, F.col("_answers")), 6).alias("token_f1"), F.col("_numeric").alias("numeric_available"),
        F.when(F.col("_numeric"), F.col("_gen")).alias("numeric_generation_accuracy"), F.col("_ext").alias("numeric_extraction_accuracy"), F.when(F.col("_numeric"), F.col("_gen") | F.coalesce("_ext", F.lit(False))).alias("numeric_accuracy"),
        due.alias("expected_refusal"), F.when(due, refused).alias("refusal_correct"), F.when(due, ~refused).alias("hallucinated_on_negative"),
        at(1).alias("answer_coverage_at_1"), F.when(F.coalesce("retrieved_context", F.lit("")) != "", covers(F.col("retrieved_context"))).alias("answer_coverage_at_3"), at(5).alias("answer_coverage_at_5"),
        source.alias("source_accuracy_at_3"), F.when(section != "", some(lambda m: F.coalesce(m["section_id"], F.lit("")) == section)).alias("section_accuracy_at_3"),
        F.when(F.col("question_type") == "numeric_fact", some(lambda m: F.coalesce(m["source_type"], F.lit("")) == "table_row")).alias("table_row_recall_at_3"), F.coalesce("prediction", F.lit("")).startswith("[generation error").alias("generation_error"),
    )


def _number(c: str) -> Column:
    """A metric as a number, no number where it is none."""
    return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))


def by_system(scored: DataFrame, *keys: str) -> DataFrame:
    """Means of every metric over the rows to which it applies, and the difference of perplexity to the baseline."""
    keys = keys or ("system",)
    out = scored.groupBy(*keys).agg(F.count("*").alias("predictions"), *(F.round(F.avg(_number(c)), 8).alias(c) for c in MEANS))
    rest = [k for k in keys if k != "system"]
    base = F.max(F.when(F.col("system") == BASELINE, F.col("gold_answer_perplexity"))).over(Window.partitionBy(*(rest or [F.lit(0)])))
    return out.withColumn("perplexity_delta", F.round(F.col("gold_answer_perplexity") - base, 6))


def failure(noise: Column | None = None) -> Column:
    """Kind of a prediction's failure: the first that applies."""
    out = F.when(F.coalesce("exact_match", F.lit(False)) | F.coalesce("numeric_accuracy", F.lit(False)) | (F.coalesce("token_f1", F.lit(0.0)) >= 0.8), "correct")
    if noise is not None:
        out = out.when(noise.isin("wrong_section", "wrong_company", "boilerplate", "answer_split_across_chunks"), noise)
    rag = F.col("system") == RAG
    cov = F.col("answer_coverage_at_3")
    return (
        out.when(rag & cov.isNotNull() & ~cov, "retrieval_miss").when(rag & cov.isNotNull() & cov, "generator_hallucination")
        .when(F.col("expected_refusal") & F.col("refusal_correct").isNotNull() & ~F.col("refusal_correct"), "generator_refusal_error")
        .when(F.col("numeric_available") & F.col("numeric_accuracy").isNotNull() & ~F.col("numeric_accuracy"), "numeric_unit_error").when(F.col("generation_error"), "tokenizer_or_generation_issue").otherwise("retrieval_noise")
    )


# Question sources fit to report on.
VERIFIED_SOURCES = ("verified", "verified_remapped", "research", "research_validated")
KINDS = ("numeric_fact", "text_fact", "risk_factor", "explanation", "negative")
SYSTEMS = (BASELINE, RAG, ORACLE, "random_context_gpt")


def evidence_missing() -> Column:
    """Whether an answerable question lacks evidence; null for one that expects a refusal."""
    none = (F.coalesce("gold_evidence_text", F.lit("")) == "") | (F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) < 1)
    return F.when(~F.coalesce("expected_refusal", F.lit(False)), F.when(F.col("evidence_valid").eqNullSafe(False), True).otherwise(none))


def missing_evidence_rate(questions: DataFrame) -> DataFrame:
    """One row: the share of answerable questions without evidence, 0 without any."""
    return questions.agg(F.coalesce(F.avg(evidence_missing().cast("double")), F.lit(0.0)).alias("missing_evidence_rate"))


def run_gates(scored: DataFrame, questions: DataFrame, source: str = "verified", min_questions: int = 50, per_type: int = 5, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """One row a run: its questions, what makes its figures unfit to report (``reasons``), coverage of the systems, evidence and quality of retrieval.

    A run without the oracle system, or whose oracle has no coverage, fails that gate too.
    """
    seen = scored.groupBy("run_id", "question_id").agg(F.max("question_type").alias("t"))
    q = last_by(questions.where("question_id is not null"), "question_id", "pos").select("question_id", evidence_missing().cast("double").alias("_missing"))
    counts = seen.join(q, "question_id", "left").groupBy("run_id").agg(F.count("*").alias("questions"), *(F.count(F.when(F.col("t") == k, 1)).alias(k) for k in KINDS), F.coalesce(F.avg("_missing"), F.lit(0.0)).alias("missing_evidence_rate"))
    cov = lambda s: F.avg(F.when(F.col("system") == s, _number("answer_coverage_at_3")))
    per = scored.groupBy("run_id").agg(cov(ORACLE).alias("oracle_coverage"), cov(RAG).alias("rag_coverage"), *(F.count(F.when(F.col("system") == s, 1)).alias(f"_n_{s}") for s in systems))
    few = lambda k: F.when((F.col(k) > 0) & (F.col(k) < per_type), F.lit(f"{k}<{per_type}"))
    reasons = F.array_compact(F.array(
        F.when(F.col("questions") < min_questions, F.lit(f"questions<{min_questions}")), F.when(F.lit(source not in VERIFIED_SOURCES), F.lit("question_source_not_verified")), F.when(F.lit(source == "sample"), F.lit("question_file_is_sample_questions")),
        *(few(k) for k in KINDS), F.when(F.col("oracle_coverage").isNull() | (F.col("oracle_coverage") < 0.95), F.lit("oracle_coverage<0.95")),
        *(F.when(F.col(f"_n_{s}") != F.col("questions"), F.lit(f"missing_predictions:{s}")) for s in systems),
    ))
    quality = F.when(F.col("rag_coverage").isNull() | (F.col("rag_coverage") < 0.70), "weak").otherwise("acceptable")
    return counts.join(per, "run_id").select(
        "run_id", "questions", F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) == 0).alias("valid"), (F.col("questions") < min_questions).alias("is_smoke_test"), F.round("oracle_coverage", 6).alias("oracle_coverage"),
        F.round("rag_coverage", 6).alias("rag_coverage"), quality.alias("retrieval_quality"), F.round("missing_evidence_rate", 6).alias("missing_evidence_rate"),
    )


def run_metadata(gates: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gates of every run with what it ran on: checkpoint, tokenizer, its vocabulary and systems."""
    ran = predictions.groupBy("run_id").agg(F.max("checkpoint_path").alias("checkpoint_path"), F.max("tokenizer_dir").alias("tokenizer_dir"), F.max("tokenizer_vocab_size").alias("tokenizer_vocab_size"), F.array_join(F.array_sort(F.collect_set("system")), ",").alias("systems"))
    return gates.join(ran, "run_id")


def oracle_sanity(scored: DataFrame, latency_limit: float = 5.0, min_questions: int = 50) -> DataFrame:
    """One row: whether the system with the right context beats the baseline, and the reasons where not; slowness alone only warns."""
    mean = lambda s, c: F.avg(F.when(F.col("system") == s, _number(c)))
    some = lambda s: F.count(F.when(F.col("system") == s, 1)) > 0
    one = scored.agg(
        F.count_distinct("question_id").alias("questions"), some(ORACLE).alias("_o"), some(BASELINE).alias("_b"), mean(ORACLE, "answer_coverage_at_3").alias("oracle_coverage"), mean(BASELINE, "gold_answer_perplexity").alias("baseline_perplexity"),
        mean(ORACLE, "gold_answer_perplexity").alias("oracle_perplexity"), mean(BASELINE, "token_f1").alias("_bf"), mean(ORACLE, "token_f1").alias("_of"), mean(ORACLE, "total_latency_seconds").alias("_latency"),
    )
    both = F.col("_o") & F.col("_b")
    reasons = F.array_compact(F.array(
        F.when(~F.col("_o"), "oracle_system_missing"), F.when(~F.col("_b"), "baseline_system_missing"), F.when(F.col("oracle_coverage").isNull() | (F.col("oracle_coverage") < 0.95), "oracle_answer_coverage<0.95"),
        F.when(both & (F.col("oracle_perplexity") > F.col("baseline_perplexity")), "oracle_perplexity_not_better_than_baseline"), F.when(both & (F.col("_of") < F.col("_bf")), "oracle_token_f1_below_baseline"),
        F.when(both & (F.col("_latency") > latency_limit), "oracle_latency_warning"), F.when(F.col("questions") < min_questions, "oracle_question_count_below_minimum"),
    ))
    hard = F.filter(reasons, lambda r: r != "oracle_latency_warning")
    return one.select(
        (F.size(hard) == 0).alias("passed"), (F.array_join(reasons, ";") == "oracle_latency_warning").alias("warning_only"), F.array_join(reasons, ";").alias("reasons"), *(F.round(c, 6).alias(c) for c in ("oracle_coverage", "baseline_perplexity", "oracle_perplexity")),
        F.round(F.col("oracle_perplexity") - F.col("baseline_perplexity"), 6).alias("perplexity_delta"), F.round(F.col("_of") - F.col("_bf"), 6).alias("token_f1_delta"),
    )


def best_config(summary: DataFrame) -> DataFrame:
    """The configuration of the best retrieval: coverage, then the fewest wrong sections, split answers, perplexity and latency."""
    return summary.orderBy(F.desc_nulls_last("coverage"), "wrong_section", "split", F.asc_nulls_last("perplexity"), F.asc_nulls_last("latency"), "chunk_config").limit(1)


def is_correct() -> Column:
    return F.coalesce("exact_match", F.lit(False)) | F.coalesce("numeric_accuracy", F.lit(False)) | (F.coalesce("token_f1", F.lit(0.0)) >= 0.8)


def exemplars(scored: DataFrame) -> DataFrame:
    """(category, question_id): for each of seven ways in which systems differ on a question, the question seen first.

    Of a question's predictions by one system, the last counts.
    """
    last = scored.where("question_id is not null").groupBy("question_id", "system").agg(F.max_by(F.struct(is_correct().alias("ok"), F.col("answer_coverage_at_3").alias("cov")), "detail_id").alias("p"), F.min("detail_id").alias("first"))
    of = lambda s: F.max(F.when(F.col("system") == s, F.col("p")))
    q = last.groupBy("question_id").agg(F.min("first").alias("first"), of(BASELINE).alias("b"), of(RAG).alias("r"), of(ORACLE).alias("o"), of("random_context_gpt").alias("x")).where("b is not null or r is not null")
    ok = lambda c: F.coalesce(F.col(f"{c}.ok"), F.lit(False))
    has = lambda c: F.col(c).isNotNull()
    categories = {
        "rag_succeeds_baseline_fails": ok("r") & ~ok("b"), "baseline_succeeds_rag_fails": ok("b") & ~ok("r"), "retrieval_miss": F.col("r.cov").eqNullSafe(False), "retrieval_finds_evidence_generator_fails": F.col("r.cov").eqNullSafe(True) & ~ok("r"),
        "random_context_fails": has("x") & ~ok("x"), "oracle_succeeds": ok("o"), "oracle_fails": has("o") & ~ok("o"),
    }
    each = q.select("question_id", "first", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in categories.items())))).alias("category"))
    return each.groupBy("category").agg(F.min_by("question_id", "first").alias("question_id"))
