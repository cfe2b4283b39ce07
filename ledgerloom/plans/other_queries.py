"""Queries over extraction, prompts and the extensions: as-of joins, sessions, windows, cubes and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom import streaming
from ledgerloom.functions import text as T
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import extraction, inference, reporting, tokenizing
from ledgerloom.operators import matching as M
from ledgerloom.plans import evaluation_queries as EV
from ledgerloom.plans import query
from ledgerloom.plans import retrieval_queries as R
from ledgerloom.plans import sqltext as S
from ledgerloom.plans.text_queries import _CAND
from ledgerloom.session import scratch, table
from ledgerloom.sources import files

_Q = "q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos DESC) AS rn FROM questions_verified) WHERE rn = 1)"
_ALIASES = "list_filter(list_concat([answer, normalized_answer], coalesce(answer_aliases, [])), lambda x: x IS NOT NULL AND x <> '')"
_CANDS = f"list_filter({_CAND}, lambda x, i: list_position(list_transform({_CAND}, lambda y: lower(y)), lower(x)) = i)"


@query(
    "n5_extraction",
    f"""WITH {_Q}, t AS (SELECT detail_id, question_id, unnest(retrieved_texts) AS text, generate_subscripts(retrieved_texts, 1) - 1 AS place FROM evaluation_details),
j AS (SELECT t.*, coalesce(q.row_label, '') AS label, {_ALIASES} AS aliases FROM t JOIN q ON q.question_id = t.question_id WHERE t.text IS NOT NULL AND q.question_type = 'numeric_fact'),
k AS (SELECT *, contains(lower(text), lower(label)) AS hit, list_filter(aliases, lambda a: contains({S.norm('text')}, {S.norm('a')}))[1] AS alias, {_CANDS} AS cands, flatten(list_transform(aliases, lambda a: {S.nums('a')})) AS gold FROM j),
l AS (SELECT *, list_filter(cands, lambda c: {S.near(S.nums('c'), 'gold')})[1] AS close, CASE WHEN alias IS NOT NULL THEN 1 WHEN (label = '' OR hit) AND len(cands) > 0 THEN 2 END AS turn FROM k),
m AS (SELECT *, row_number() OVER (PARTITION BY detail_id ORDER BY turn, CASE WHEN label <> '' AND hit THEN 0 ELSE 1 END, place) AS n FROM l WHERE turn IS NOT NULL)
SELECT detail_id, coalesce(alias, close, cands[1]) AS answer, place, CASE WHEN alias IS NOT NULL THEN 'alias_match' WHEN close IS NOT NULL THEN 'normalized_numeric_match' ELSE 'first_numeric_candidate' END AS method FROM m WHERE n = 1""",
)
def n5(spark, d):
    """The answer read from what each prediction retrieved."""
    texts = table(spark, d, "evaluation_details").select("detail_id", "question_id", F.posexplode("retrieved_texts").alias("place", "text")).withColumn("place", F.col("place").cast("long"))
    return extraction.extract_answers(texts, E.last_by(table(spark, d, "questions_verified"), "question_id", "pos"), "detail_id")


@query("n6_phrases", r"""WITH p AS (SELECT detail_id, trim(replace(replace(lower(gold_answer), ',', ''), '$', '')) AS t FROM evaluation_details WHERE gold_answer IS NOT NULL),
m AS (SELECT *, regexp_extract(t, '([-+]?\d+(?:\.\d+)?)\s*(%|percent)', 1) AS share, regexp_extract(t, '([-+]?\d+(?:\.\d+)?)\s*(billion|million|thousand|bn|mm|m|k)?', 1) AS n, regexp_extract(t, '([-+]?\d+(?:\.\d+)?)\s*(billion|million|thousand|bn|mm|m|k)?', 2) AS u FROM p)
SELECT detail_id, CASE WHEN share <> '' THEN printf('%g', CAST(share AS DOUBLE)) || ' percent' WHEN n <> '' THEN printf('%g', CAST(n AS DOUBLE) * CASE WHEN u IN ('billion', 'bn') THEN 1000.0 WHEN u IN ('thousand', 'k') THEN 0.001 ELSE 1.0 END) || ' million' ELSE t END AS phrase FROM m""")
def n6(spark, d):
    """Gold answers as shares or millions."""
    return table(spark, d, "evaluation_details").where("gold_answer is not null").select("detail_id", extraction.normalized_phrases(F.col("gold_answer")).alias("phrase"))


_FOUND = f"""xt AS (SELECT res.pos, res.rank AS place, c.text, coalesce(q.row_label, '') AS label, {_ALIASES} AS aliases FROM res JOIN c ON c.chunk_key = res.chunk_key JOIN (SELECT * FROM questions_verified) q ON q.pos = res.pos WHERE q.question_type = 'numeric_fact'),
xk AS (SELECT *, contains(lower(text), lower(label)) AS hit, list_filter(aliases, lambda a: contains({S.norm('text')}, {S.norm('a')}))[1] AS alias, {_CANDS} AS cands, flatten(list_transform(aliases, lambda a: {S.nums('a')})) AS gold FROM xt),
xl AS (SELECT *, list_filter(cands, lambda c: {S.near(S.nums('c'), 'gold')})[1] AS close, CASE WHEN alias IS NOT NULL THEN 1 WHEN (label = '' OR hit) AND len(cands) > 0 THEN 2 END AS turn FROM xk),
xm AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY turn, CASE WHEN label <> '' AND hit THEN 0 ELSE 1 END, place) AS n FROM xl WHERE turn IS NOT NULL), xc AS (SELECT pos, coalesce(alias, close, cands[1]) AS x FROM xm WHERE n = 1)"""
_I2 = (
    R.RANKED_SQL + "," + R.packed_sql("res", R.BUDGET, "pk") + "," + R.RANDOM_TAIL + "," + R.packed_sql("rnd", R.BUDGET, "rk") + "," + _FOUND
    + f""", p AS (SELECT q.pos, coalesce(q.question, '') AS q, coalesce(q.gold_evidence_text, '') AS g, pk.context AS c, rk.context AS r, coalesce(xc.x, '') AS x FROM questions_verified q JOIN pk ON pk.pos = q.pos JOIN rk ON rk.pos = q.pos LEFT JOIN xc ON xc.pos = q.pos)
SELECT pos, 'baseline_gpt' AS system, md5('Question: ' || q || chr(10) || 'Answer:') AS prompt FROM p UNION ALL SELECT pos, 'oracle_gpt', md5('Gold evidence:' || chr(10) || g || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:') FROM p
UNION ALL SELECT pos, 'random_context_gpt', md5('Context:' || chr(10) || r || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:') FROM p
UNION ALL SELECT pos, 'rag_gpt_tfidf_top3', md5('Context:' || chr(10) || c || chr(10) || chr(10) || CASE WHEN x <> '' THEN chr(10) || 'Candidate numeric answer from context: ' || x || chr(10) ELSE '' END || 'Question: ' || q || chr(10) || chr(10) || '{inference.INSTRUCTION}' || chr(10) || 'Answer:') FROM p"""
)


def _prompts(spark, d):
    """Prompts of every question for every system: with what was retrieved, the figure read from it, drawn chunks and the gold evidence."""
    results, q = R.results(spark, d, "text", "ticker", "year", "section_id", "source_type")
    results = M.saved(results, "results")
    rag = R.R.packed_context(results, q, "pos", R.BUDGET).select("pos", "context")
    drawn = R.R.packed_context(R.random_results(spark, d), q, "pos", R.BUDGET).select("pos", F.col("context").alias("random"))
    texts = results.select("pos", F.col("pos").cast("string").alias("question_id"), F.col("rank").cast("long").alias("place"), "text")
    found = extraction.extract_answers(texts, q.withColumn("question_id", F.col("pos").cast("string")), "pos").select("pos", F.col("answer").alias("candidate"))
    rows = table(spark, d, "questions_verified").join(rag, "pos").join(drawn, "pos").join(found, "pos", "left")
    return inference.prompts(rows, "pos", "context", "gold_evidence_text", "random", "candidate"), rows


@query("i2_prompts", _I2)
def i2(spark, d):
    """Every question's prompt for every system."""
    return _prompts(spark, d)[0].withColumn("prompt", F.md5("prompt"))


@query("i4_generation")
def i4(spark, d):
    """Answers of a small character model with fixed weights to every prompt, by sampling among the likeliest characters."""
    return inference.run_model(_prompts(spark, d)[0], inference.demo_model, "prompt").select("pos", "system", "generated")


@query("i8_extraction_answers")
def i8(spark, d):
    """Answers of the system that only extracts: the figure read from what was retrieved, with the tokens of prompt and answer."""
    prompts, rows = _prompts(spark, d)
    rag = prompts.where(F.col("system") == E.RAG).join(rows.select("pos", "candidate"), "pos")
    return inference.extraction_only(rag, "prompt", "candidate").select("pos", "generated", "prompt_tokens", "completion_tokens", "latency_seconds")


@query("i3_round_trip", "SELECT detail_id, md5(prediction) AS prediction, md5(retrieved_context) AS retrieved_context FROM evaluation_details")
def i3(spark, d):
    """Predictions and contexts to tokens of a public vocabulary, and back."""
    back = lambda c: F.md5(tokenizing.decoded(tokenizing.encoded(F.col(c)))).alias(c)
    return table(spark, d, "evaluation_details").select("detail_id", back("prediction"), back("retrieved_context"))


@query("i9_packing", "WITH s AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, n_chars AS n FROM documents WHERE n_chars IS NOT NULL) SELECT doc_id, CAST(floor(b / 257) AS BIGINT) AS first_block, CAST(floor((b + greatest(n - 1, 0)) / 257) AS BIGINT) AS last_block FROM s")
def i9(spark, d):
    """Blocks that documents fill when laid end to end, by their recorded sizes."""
    return inference.packed_sequences(table(spark, d, "documents").where("n_chars is not null"), "doc_id", "n_chars")


@query("e2_token_f1", f"SELECT system, round(avg({EV._f1(chr(99) + 'oalesce(prediction, ' + chr(39) * 2 + ')', '[coalesce(gold_answer, ' + chr(39) * 2 + ')]')}), 6) AS token_f1 FROM evaluation_details GROUP BY system")
def e2(spark, d):
    f1 = T.token_f1(F.coalesce("prediction", F.lit("")), F.array(F.coalesce("gold_answer", F.lit(""))))
    return table(spark, d, "evaluation_details").groupBy("system").agg(F.round(F.avg(f1), 6).alias("token_f1"))


@query("e3_refusals", f"SELECT system, count(*) AS predictions, count(*) FILTER ({S.refusal(chr(99) + 'oalesce(prediction, ' + chr(39) * 2 + ')')}) AS refusals FROM evaluation_details GROUP BY system")
def e3(spark, d):
    return table(spark, d, "evaluation_details").groupBy("system").agg(F.count("*").alias("predictions"), F.count(F.when(T.is_refusal(F.coalesce("prediction", F.lit(""))), 1)).alias("refusals"))


@query(
    "x_asof_join",
    """WITH d AS (SELECT chunk_id, ingested_at, chunk_key FROM chunks WHERE chunk_id IS NOT NULL AND ingested_at IS NOT NULL)
SELECT x.chunk_id, x.deleted_at, max_by(d.chunk_key, struct_pack(a := d.ingested_at, b := d.chunk_key)) AS chunk_key FROM (SELECT DISTINCT chunk_id, deleted_at FROM chunk_deletions) x LEFT JOIN d ON d.chunk_id = x.chunk_id AND d.ingested_at <= x.deleted_at GROUP BY ALL""",
)
def x_asof(spark, d):
    """The delivery of a chunk that stood when it was deleted."""
    dels = table(spark, d, "chunk_deletions").select("chunk_id", "deleted_at").distinct()
    c = table(spark, d, "chunks").where("chunk_id is not null AND ingested_at is not null").select(F.col("chunk_id").alias("c"), "ingested_at", "chunk_key")
    j = dels.join(c, (F.col("chunk_id") == F.col("c")) & (F.col("ingested_at") <= F.col("deleted_at")), "left")
    return j.groupBy("chunk_id", "deleted_at").agg(F.max_by("chunk_key", F.struct("ingested_at", "chunk_key")).alias("chunk_key"))


@query(
    "x_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, n""",
)
def x_sessions(spark, d):
    s = streaming.sessions(table(spark, d, "events").where("ts is not null"), "ts", "user_id")
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


_TUMBLE = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"


def _stamped(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("x_tumbling_window", _TUMBLE)
def x_tumbling(spark, d):
    return _stamped(streaming.windowed(table(spark, d, "events").where("ts is not null"), "ts", ["event_type"], "value", "1 hour"))


@query("x_tumbling_stream", _TUMBLE)
def x_stream(spark, d):
    """The same windows off a file stream that is drained."""
    like = table(spark, d, "events")
    stream = streaming.file_stream(spark, d, "events.parquet", like).where("ts is not null")
    return _stamped(streaming.drain(streaming.windowed(stream, "ts", ["event_type"], "value", "1 hour"), "tumbling", "complete"))


@query("x_rollup", "SELECT source, lang, count(*) AS documents, sum(length(text)) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def x_rollup(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@query("x_cube", "SELECT ticker, source_type, count(*) AS chunks FROM chunks GROUP BY CUBE (ticker, source_type)")
def x_cube(spark, d):
    return table(spark, d, "chunks").cube("ticker", "source_type").agg(F.count("*").alias("chunks"))


@query("x_set_ops", "SELECT chunk_id FROM chunks INTERSECT SELECT chunk_id FROM chunk_deletions EXCEPT SELECT gold_chunk_id FROM questions_verified")
def x_sets(spark, d):
    return table(spark, d, "chunks").select("chunk_id").intersect(table(spark, d, "chunk_deletions").select("chunk_id")).exceptAll(table(spark, d, "questions_verified").select("gold_chunk_id").distinct()).distinct()


@query("x_approx_distinct")
def x_approx(spark, d):
    return table(spark, d, "chunks").groupBy("ticker").agg(F.approx_count_distinct("chunk_id").alias("chunks"))


@query("x_latency_rank", "SELECT detail_id, rank FROM (SELECT detail_id, rank() OVER (PARTITION BY run_id, system ORDER BY total_latency_seconds DESC, detail_id) AS rank FROM evaluation_details) WHERE rank <= 3")
def x_rank(spark, d):
    """The three slowest predictions of each run and system: a report."""
    w = Window.partitionBy("run_id", "system").orderBy(F.desc("total_latency_seconds"), "detail_id")
    return table(spark, d, "evaluation_details").select("detail_id", F.rank().over(w).alias("rank")).where("rank <= 3")


# ---- sources, sinks and reports


@query("s4_json_lines", "SELECT pos, question_id, question, answer, \"year\", array_to_string(answer_aliases, '|') AS aliases FROM questions_verified")
def s4(spark, d):
    """Questions written as JSON lines and read back."""
    q = table(spark, d, "questions_verified").select("pos", "question_id", "question", "answer", "year", "answer_aliases")
    path = scratch(spark, "questions")
    files.write_jsonl(q, path)
    back = files.read_jsonl(spark, path, "pos long, question_id string, question string, answer string, year string, answer_aliases array<string>")
    return back.select("pos", "question_id", "question", "answer", "year", F.array_join("answer_aliases", "|").alias("aliases"))


@query("s8_csv_union", "SELECT region_key, name, nation_key, n_regionkey FROM (SELECT CAST(r_regionkey AS VARCHAR) AS region_key, r_name AS name, NULL AS nation_key, NULL AS n_regionkey FROM region UNION ALL SELECT NULL, n_name, CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation)")
def s8(spark, d):
    """Rows of two tables under all their columns, written as CSV and read back."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation_key"), "n_regionkey")
    path = scratch(spark, "union")
    files.write_csv(files.union_columns([r, n]), path)
    return files.read_csv(spark, path, "region_key string, name string, nation_key string, n_regionkey string")


@query("s10_count_lines", "SELECT count(*) AS lines FROM questions_verified")
def s10(spark, d):
    """Lines of a written question file, unparsed."""
    path = scratch(spark, "lines")
    files.write_jsonl(table(spark, d, "questions_verified").select("pos", "question"), path)
    return spark.read.text(path).where(F.trim("value") != "").agg(F.count("*").alias("lines"))


@query("s11_chunk_cache", "SELECT chunk_config, count(*) AS chunks FROM chunks WHERE chunk_config IS NOT NULL GROUP BY chunk_config")
def s11(spark, d):
    """Chunks by configuration, out of a cache that is filled the first time and read the second."""
    root = scratch(spark, "chunks")
    build = lambda: table(spark, d, "chunks").select("chunk_key", "chunk_config").where("chunk_config is not null")
    files.cached_chunks(spark, root, "all", build)
    return files.cached_chunks(spark, root, "all", build).groupBy("chunk_config").agg(F.count("*").alias("chunks"))


@query("s15_distribution", "SELECT 'question_type' AS field, coalesce(question_type, '') AS value, count(*) AS count FROM questions_verified GROUP BY 2 UNION ALL SELECT 'ticker', ticker, count(*) FROM questions_verified WHERE coalesce(ticker, '') <> '' GROUP BY 2 UNION ALL SELECT 'expected_refusal', CAST(coalesce(expected_refusal, FALSE) AS VARCHAR), count(*) FROM questions_verified GROUP BY 2")
def s15(spark, d):
    """Questions by kind, ticker and expected refusal."""
    return files.distribution(table(spark, d, "questions_verified"))


@query("s18_by_system", "SELECT system, count(*) AS predictions, sum(completion_tokens) AS tokens FROM evaluation_details GROUP BY system")
def s18(spark, d):
    """Predictions written in a folder for each system and read back."""
    path = scratch(spark, "systems")
    files.write_by_system(table(spark, d, "evaluation_details").select("detail_id", "system", "completion_tokens"), path)
    return spark.read.parquet(path).groupBy("system").agg(F.count("*").alias("predictions"), F.sum("completion_tokens").alias("tokens"))


@query("rep1_systems", EV.DETAILS + f", s AS (SELECT system, count(*) AS predictions, {EV._M} FROM det GROUP BY system) SELECT system, {', '.join(reporting.COMPARED)}, round(total_latency_seconds - max(CASE WHEN system = 'baseline_gpt' THEN total_latency_seconds END) OVER (), 6) AS latency_delta FROM s")
def rep1(spark, d):
    """The systems side by side, as the standard report compares them."""
    return reporting.comparison(E.by_system(EV._scored(spark, d)))


@query(
    "rep2_ablation",
    "WITH dc AS (" + R.CONFIG_SQL + " SELECT q.cfg AS chunk_config, count(*) AS questions, round(avg(CAST(coverage_at_1 AS INT)), 6) AS coverage_at_1, round(avg(CAST(coverage_at_3 AS INT)), 6) AS coverage_at_3, count(*) FILTER (noise_reason = 'wrong_section') AS wrong_section, count(*) FILTER (noise_reason = 'answer_split_across_chunks') AS split FROM diag JOIN q USING (qc) GROUP BY q.cfg)"
    + f", cs AS (SELECT coalesce(chunk_config, '{R.C.DEFAULT_CONFIG}') AS chunk_config, count(*) AS chunks, count(*) FILTER (retrievable IS NULL OR retrievable) AS retrievable_chunks, round(avg(token_count), 6) AS mean_tokens FROM chunks GROUP BY 1) SELECT * FROM cs JOIN dc USING (chunk_config)",
)
def rep2(spark, d):
    """The ablation report: each configuration's chunks and what retrieval makes of them."""
    chunks = table(spark, d, "chunks").withColumn("chunk_config", F.coalesce("chunk_config", F.lit(R.C.DEFAULT_CONFIG)))
    return reporting.ablation(chunks, R.config_diagnostics(spark, d))
