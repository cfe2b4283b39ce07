"""Queries over the retrieval operators: all questions against all retrievable chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import chunking as C
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import matching as M
from ledgerloom.operators import prefilter as P
from ledgerloom.operators import retrieval as R
from ledgerloom.plans import query
from ledgerloom.plans import sqltext as S
from ledgerloom.session import checkpointed, scratch, table

K = 3
FILTERS = ["ticker", "year"]
QUESTION_COLS = ["pos", "question_id", "question", "answer", "answer_aliases", "normalized_answer", "ticker", "company", "year", "question_type", "source_section", "source_type", "row_label", "gold_evidence_text"]


def _chunks(spark, d, cols=("chunk_key", "chunk_id", "text", *R.METADATA)):
    """Retrievable chunks, each id once: the last delivery."""
    c = table(spark, d, "chunks").where("text is not null AND (retrievable IS NULL OR retrievable)")
    return P.last_of(c, "chunk_id", list(cols), ["ingested_at", "chunk_key"])


def _questions(spark, d):
    return table(spark, d, "questions_verified").select(*QUESTION_COLS)


def _index(spark, d):
    chunks = _chunks(spark, d)
    counts = checkpointed(R.term_counts(chunks, "chunk_key", "text"))  # the texts are read once
    return chunks, counts, R.idf(counts, chunks.count())


def _corpus(spark, d, *more, low=True):
    """What matching reads of the retrievable chunks: hashes of their words, and the texts of tables; texts are read once, and not kept."""
    c = _chunks(spark, d, ("chunk_key", "text", *FILTERS, "section_id", "source_type", *more))
    told = F.when(F.col("source_type").isin("table_row", "table_summary"), F.lower("text")) if low else F.lit(None).cast("string")
    return M.saved(c.withColumns({"words": M.word_hashes(F.col("text")), "low": told}).drop("text"), "corpus")


def _asked(q):
    """Questions with what matching reads."""
    return q.withColumns({"words": M.word_hashes(R.rewritten(q)), "row_terms": R.row_label_terms(F.col("row_label"), F.col("question"))})


def _ranked(spark, d, k=K):
    q = _questions(spark, d)
    return M.best_matches(_asked(q), _corpus(spark, d), "pos", "chunk_key", k, FILTERS).drop("variant"), q


def _joined(spark, d, ranked, read=lambda chunks: chunks):
    """Results with what is read of their chunks; few others are shuffled."""
    ranked = M.saved(ranked, "ranked")
    return ranked.join(read(P.that_meet(table(spark, d, "chunks").select("chunk_key", "chunk_id", "text", *R.METADATA), ranked, "chunk_key")), "chunk_key")


def results(spark, d, *cols):
    """Ranked chunks of every question, with these columns of the chunks, or all."""
    ranked, q = _ranked(spark, d)
    return _joined(spark, d, ranked, lambda c: c.select("chunk_key", *cols) if cols else c), q


def random_results(spark, d):
    """Three chunks drawn for each question."""
    return _joined(spark, d, R.random_context(_questions(spark, d), _chunks(spark, d, ("chunk_key",)), "pos", "chunk_key", K))


MAX_CONFIGS = 1000


def config_diagnostics(spark, d):
    """(question_id, chunk_config, ...): retrieval for every question over the chunks of each configuration, an index of its own, and its diagnosis."""
    chunks = _corpus(spark, d, "chunk_config").withColumn("chunk_config", F.coalesce("chunk_config", F.lit(C.DEFAULT_CONFIG)))
    sizes = chunks.groupBy("chunk_config").agg(F.count("*").alias("n")).limit(MAX_CONFIGS + 1).collect()
    if len(sizes) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configurations")
    last = E.last_by(_questions(spark, d).where("question_id is not null"), "question_id", "pos")
    each = F.explode(F.array(*(F.lit(r.chunk_config) for r in sizes)) if sizes else F.array().cast("array<string>"))
    known = R.wanted(F.col("gold_evidence_text"), F.col("answer"), F.col("answer_aliases")).alias("wanted")
    q = M.saved(_asked(last).select("question_id", "ticker", "year", "question_type", "source_section", "row_terms", "words", known), "questions").withColumn("chunk_config", each).withColumn("qc", F.concat_ws("|", "question_id", "chunk_config"))
    ranked = M.best_matches(q, chunks, "qc", "chunk_key", K, FILTERS, "chunk_config")
    return R.diagnostics(_joined(spark, d, ranked, _told), q, "qc", "question_id", "chunk_config")


def _told(chunks):
    """Chunks with what a diagnosis reads: each text is normalised once, however many questions it answers."""
    low = F.coalesce("text", F.lit(""))
    return chunks.select("chunk_key", "chunk_id", "ticker", "year", "section_id", "source_type", T.normalize_answer(low).alias("norm"), F.contains(F.lower(low), F.lit("forward-looking")).alias("boiler"))


def _diagnosed(spark, d):
    ranked, q = _ranked(spark, d)
    return R.diagnostics(_joined(spark, d, ranked, _told), q, "pos"), q


_STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"


def _terms_sql(x: str) -> str:
    w = f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))"
    return f"list_concat({w}, CASE WHEN len({w}) > 1 THEN list_transform(list_zip({w}[:-2], {w}[2:]), lambda z: z[1] || ' ' || z[2]) ELSE [] END)"


_LABEL_PATTERN = r"(?i)([A-Za-z][A-Za-z &''/-]{2,80}?\s(?:net sales|revenue|gross margin|income|expenses|cash flow|sales))"
_LABEL_SRC = "CASE WHEN coalesce(row_label, '') <> '' THEN row_label ELSE coalesce(question, '') END"
_ROW_TERMS = f"list_filter(list_transform(regexp_split_to_array(trim(replace(CASE WHEN regexp_extract({_LABEL_SRC}, '{_LABEL_PATTERN}', 1) <> '' THEN regexp_extract({_LABEL_SRC}, '{_LABEL_PATTERN}', 1) ELSE coalesce(row_label, '') END, '''s', '')), '\\s+'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains(['what', 'were', 'was', 'fiscal', 'year', 'apple', 'microsoft', 'company'], w))"
_JOINED = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL AND x <> ''), ' ')"
_BASE = 'question, ticker, company, "year"'
_QUERY = f"""CASE question_type WHEN 'numeric_fact' THEN {_JOINED.format(_BASE + ", row_label, source_section, source_type, array_to_string(list_filter(list_slice(coalesce(answer_aliases, []), 1, 3), lambda x: x <> ''), ' '), array_to_string(" + _ROW_TERMS + ", ' '), 'net sales revenue table'")}
 WHEN 'risk_factor' THEN {_JOINED.format(_BASE + ", 'risk factors Item 1A'")} WHEN 'explanation' THEN {_JOINED.format(_BASE + ", 'MD&A Item 7 driven by increase decrease'")}
 WHEN 'text_fact' THEN {_JOINED.format(_BASE + ", 'business segment products services'")} ELSE {_JOINED.format(_BASE)} END"""
_WITH = f"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_key DESC) AS rn FROM chunks WHERE text IS NOT NULL AND (retrievable IS NULL OR retrievable)) WHERE rn = 1),
q AS (SELECT *, {_QUERY} AS query, {_ROW_TERMS} AS row_terms FROM questions_verified),
dt AS (SELECT chunk_key, term, count(*) AS tf FROM (SELECT chunk_key, unnest({_terms_sql('text')}) AS term FROM c) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM c)) / (1.0 + count(*))) + 1 AS idf FROM dt GROUP BY term),
dw AS (SELECT chunk_key, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk_key)) AS n FROM dt JOIN idf USING (term)),
qt AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest({_terms_sql('query')}) AS term FROM q) GROUP BY ALL),
qw AS (SELECT pos, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY pos)) AS n FROM qt JOIN idf USING (term)),
cand AS (SELECT q.pos, c.chunk_key FROM q JOIN c ON (coalesce(q.ticker, '') = '' OR upper(q.ticker) = upper(c.ticker)) AND (coalesce(q."year", '') = '' OR upper(q."year") = upper(c."year"))),
sc AS (SELECT qw.pos, dw.chunk_key, sum(qw.w / qw.n * dw.w / dw.n) AS score FROM qw JOIN dw USING (term) JOIN cand ON cand.pos = qw.pos AND cand.chunk_key = dw.chunk_key GROUP BY ALL),
"""
_BOOST = """CASE q.question_type WHEN 'numeric_fact' THEN CASE WHEN c.source_type IN ('table_row', 'table_summary') THEN 1.75 * CASE WHEN c.section_id IN ('Item 7', 'Item 8') THEN 1.35 ELSE 1.0 END
 * CASE WHEN len(q.row_terms) > 0 AND len(list_filter(q.row_terms, lambda t: NOT contains(lower(c.text), t))) = 0 THEN 2.5 ELSE 1.0 END ELSE 1.0 END WHEN 'risk_factor' THEN CASE WHEN c.section_id = 'Item 1A' AND c.source_type = 'narrative' THEN 1.75 ELSE 1.0 END
 WHEN 'explanation' THEN CASE WHEN c.section_id = 'Item 7' AND c.source_type IN ('narrative', 'local_context') THEN 1.5 ELSE 1.0 END ELSE 1.0 END"""
RANKED_SQL = (
    _WITH
    + f"""b AS (SELECT sc.pos, sc.chunk_key, round(sc.score * {_BOOST}, 6) AS score FROM sc JOIN q ON q.pos = sc.pos JOIN c ON c.chunk_key = sc.chunk_key),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, chunk_key) AS rank FROM b) WHERE rank <= {K}),
nt AS (SELECT q.pos, count(top.pos) AS n FROM q LEFT JOIN top ON top.pos = q.pos GROUP BY q.pos),
fill AS (SELECT nt.pos, cand.chunk_key, nt.n, row_number() OVER (PARTITION BY nt.pos ORDER BY cand.chunk_key) AS p FROM nt JOIN cand ON cand.pos = nt.pos LEFT JOIN top ON top.pos = nt.pos AND top.chunk_key = cand.chunk_key WHERE nt.n < {K} AND top.pos IS NULL),
res AS (SELECT pos, chunk_key, score, rank FROM top UNION ALL SELECT pos, chunk_key, 0.0, n + p FROM fill WHERE p <= {K} - n)
"""
)


@query("r1_idf", _WITH + "x AS (SELECT 1) SELECT term, df, round(idf, 6) AS idf FROM idf")
def r1(spark, d):
    return _index(spark, d)[2].select("term", "df", F.round("idf", 6).alias("idf"))


@query("r2_tfidf_top3", _WITH + f"s AS (SELECT pos, chunk_key, round(score, 6) AS score FROM sc) SELECT pos, chunk_key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, chunk_key) AS rank FROM s) WHERE rank <= {K}")
def r2(spark, d):
    found = M.best_matches(_asked(_questions(spark, d)), _corpus(spark, d, low=False), "pos", "chunk_key", K, FILTERS, boosted=False, fill=False)
    return found.select("pos", "chunk_key", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "r3_dense_top5",
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS l FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.l * b.l), 6) AS score FROM n a JOIN n b ON a.vec_id % 100 = 0)
SELECT q, d, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM s) WHERE rank <= 5""",
)
def r3(spark, d):
    v = table(spark, d, "embeddings")
    return R.dense_top_k(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 5).withColumn("rank", F.col("rank").cast("long"))


@query("r5_boosted_top3", RANKED_SQL + "SELECT pos, chunk_key, score, rank FROM res")
def r5(spark, d):
    """Boosted top 3 of every question, short ones filled up at score 0."""
    return _ranked(spark, d)[0].select("pos", "chunk_key", "score", F.col("rank").cast("long").alias("rank"))


@query("r9_query_rewrite", f"SELECT pos, {_QUERY} AS query FROM questions_verified")
def r9(spark, d):
    q = _questions(spark, d)
    return q.select("pos", R.rewritten(q).alias("query"))


@query("r10_row_terms", f"SELECT pos, array_to_string({_ROW_TERMS}, ' ') AS row_terms FROM questions_verified")
def r10(spark, d):
    return _questions(spark, d).select("pos", F.array_join(R.row_label_terms(F.col("row_label"), F.col("question")), " ").alias("row_terms"))


@query("r11_filters", """SELECT pos, array_to_string(list_filter(['ticker=' || nullif(ticker, ''), 'year=' || nullif("year", '')], lambda x: x IS NOT NULL), ';') AS filters FROM questions_verified""")
def r11(spark, d):
    """Which filters a question sets, as one text."""
    parts = F.filter(F.array(*(F.concat(F.lit(f"{c}="), F.nullif(F.col(c), F.lit(""))) for c in FILTERS)), lambda x: x.isNotNull())
    return _questions(spark, d).select("pos", F.array_join(parts, ";").alias("filters"))


def packed_sql(results: str, budget: int, name: str) -> str:
    """CTEs ending in ``name``(pos, context, pieces) from a CTE of (pos, rank, chunk_key)."""
    return f"""{name}_c AS (SELECT r.pos, r.rank, '[' || r.rank || ': ' || array_to_string(list_filter([c.ticker, c."year", c.section_id, c.source_type], lambda x: x IS NOT NULL AND x <> ''), ' ') || '] ' || replace(c.text, chr(10), ' ') AS p FROM {results} r JOIN c ON c.chunk_key = r.chunk_key),
{name}_n AS (SELECT *, {S.wc('p')} AS n FROM {name}_c), {name}_b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pos ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_n),
{name}_k AS (SELECT pos, rank, CASE WHEN n <= {budget} - before THEN p WHEN {budget} - before > 8 THEN array_to_string(list_slice({S.words('p')}, 1, CAST({budget} - before AS BIGINT)), ' ') END AS k FROM {name}_b),
{name} AS (SELECT q.pos, coalesce(string_agg(k, chr(10) || chr(10) ORDER BY rank), '') AS context, count(k) AS pieces FROM questions_verified q LEFT JOIN {name}_k ON {name}_k.pos = q.pos GROUP BY q.pos)
"""


BUDGET = 700


@query("r12_context_pack", RANKED_SQL + "," + packed_sql("res", BUDGET, "pk") + "SELECT pos, md5(context) AS context, pieces FROM pk")
def r12(spark, d):
    """Every question's context, under the budget of production."""
    return R.packed_context(*results(spark, d), "pos", BUDGET).select("pos", F.md5("context").alias("context"), F.col("pieces").cast("long").alias("pieces"))


def diag_sql(key: str = "pos", questions: str = "q") -> str:
    """CTE diag of one row per question of a CTE ``questions``, from res(key, rank, score, chunk_key) and c."""
    cov = {k: S.covered(f"coalesce(t{k}, '')", "gold_evidence_text", "answer", "answer_aliases") for k in (1, 3, 5)}
    fits = """((coalesce(q.ticker, '') = '' OR upper(coalesce(c.ticker, '')) = upper(q.ticker)) AND (coalesce(q."year", '') = '' OR coalesce(c."year", '') = q."year"))"""
    own = S.covered("c.text", "q.gold_evidence_text", "q.answer", "q.answer_aliases")
    return f""", j AS (SELECT res.{key} AS k_, res.rank, c.text, c.chunk_id, coalesce(c.section_id, '') AS sec_, coalesce(c.source_type, '') AS type_, {fits} AS fits, {own} AS own FROM res JOIN {questions} q ON q.{key} = res.{key} JOIN c ON c.chunk_key = res.chunk_key),
g AS (SELECT q.{key}, q.question_type, q.source_section, q.gold_evidence_text, q.answer, q.answer_aliases, (coalesce(q.ticker, '') <> '' OR coalesce(q."year", '') <> '') AS expected, count(j.rank) AS results,
 {', '.join(f"string_agg(j.text, chr(10) ORDER BY j.rank) FILTER (j.rank <= {k}) AS t{k}" for k in (1, 3, 5))}, coalesce(bool_or(j.rank <= 3 AND j.fits), FALSE) AS src, coalesce(bool_or(j.rank <= 3 AND j.sec_ = q.source_section), FALSE) AS sec, coalesce(bool_or(j.sec_ = q.source_section), FALSE) AS anysec,
 coalesce(bool_or(j.rank <= 3 AND j.type_ = 'table_row'), FALSE) AS row3, coalesce(bool_or(j.type_ = 'table_row'), FALSE) AS row_, coalesce(bool_or(contains(lower(j.text), 'forward-looking')), FALSE) AS boiler, arg_min(j.chunk_id, j.rank) FILTER (j.own AND j.rank <= 5) AS matched_chunk_id,
 coalesce(string_agg(j.chunk_id, ';' ORDER BY j.rank), '') AS retrieved_chunk_ids, coalesce(string_agg(j.sec_, ';' ORDER BY j.rank), '') AS retrieved_sections, coalesce(string_agg(j.type_, ';' ORDER BY j.rank), '') AS retrieved_source_types FROM {questions} q LEFT JOIN j ON j.k_ = q.{key} GROUP BY ALL),
h AS (SELECT *, {', '.join(f"{cov[k]} AS coverage_at_{k}" for k in (1, 3, 5))}, CASE WHEN expected THEN src END AS source_accuracy_at_3, CASE WHEN coalesce(source_section, '') <> '' THEN sec END AS section_accuracy_at_3, CASE WHEN question_type = 'numeric_fact' THEN row3 END AS table_row_recall_at_3 FROM g),
diag AS (SELECT {key}, retrieved_chunk_ids, retrieved_sections, retrieved_source_types, CAST(results AS INT) AS results, coverage_at_1, coverage_at_3, coverage_at_5, source_accuracy_at_3, section_accuracy_at_3, table_row_recall_at_3, matched_chunk_id, CASE WHEN coverage_at_3 AND (source_accuracy_at_3 IS NULL OR source_accuracy_at_3) THEN 'none'
 WHEN results = 0 AND NOT coverage_at_3 THEN 'retrieval_miss' WHEN boiler THEN 'boilerplate' WHEN NOT source_accuracy_at_3 THEN 'wrong_company' WHEN results > 0 AND coalesce(source_section, '') <> '' AND NOT anysec THEN 'wrong_section' WHEN question_type = 'numeric_fact' AND NOT row_ THEN 'table_label_missing'
 WHEN results > 0 AND NOT coverage_at_3 THEN 'answer_split_across_chunks' ELSE 'none' END AS noise_reason FROM h)
"""


DIAG_SQL = RANKED_SQL + diag_sql()
CONFIG_SQL = f"""WITH c AS (SELECT *, coalesce(chunk_config, '{C.DEFAULT_CONFIG}') AS cfg FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_key DESC) AS rn FROM chunks WHERE text IS NOT NULL AND (retrievable IS NULL OR retrievable)) WHERE rn = 1),
nc AS (SELECT cfg, count(*) AS n FROM c GROUP BY cfg), q0 AS (SELECT *, {_QUERY} AS query, {_ROW_TERMS} AS row_terms FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos DESC) AS rn FROM questions_verified WHERE question_id IS NOT NULL) WHERE rn = 1),
q AS (SELECT q0.*, nc.cfg, question_id || '|' || cfg AS qc FROM q0, nc), dt AS (SELECT chunk_key, cfg, term, count(*) AS tf FROM (SELECT chunk_key, cfg, unnest({_terms_sql('text')}) AS term FROM c) GROUP BY ALL),
idf AS (SELECT dt.cfg, term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM dt JOIN nc USING (cfg) GROUP BY dt.cfg, term),
dw AS (SELECT chunk_key, dt.cfg, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk_key)) AS n FROM dt JOIN idf USING (cfg, term)),
qt AS (SELECT question_id, term, count(*) AS tf FROM (SELECT question_id, unnest({_terms_sql('query')}) AS term FROM q0) GROUP BY ALL),
qw AS (SELECT question_id || '|' || cfg AS qc, cfg, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY question_id, cfg)) AS n FROM qt JOIN idf USING (term)),
cand AS (SELECT q.qc, c.chunk_key FROM q JOIN c ON c.cfg = q.cfg AND (coalesce(q.ticker, '') = '' OR upper(q.ticker) = upper(c.ticker)) AND (coalesce(q."year", '') = '' OR upper(q."year") = upper(c."year"))),
sc AS (SELECT qw.qc, dw.chunk_key, sum(qw.w / qw.n * dw.w / dw.n) AS score FROM qw JOIN dw ON dw.term = qw.term AND dw.cfg = qw.cfg JOIN cand ON cand.qc = qw.qc AND cand.chunk_key = dw.chunk_key GROUP BY ALL),
b AS (SELECT sc.qc, sc.chunk_key, round(sc.score * {_BOOST}, 6) AS score FROM sc JOIN q ON q.qc = sc.qc JOIN c ON c.chunk_key = sc.chunk_key),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qc ORDER BY score DESC, chunk_key) AS rank FROM b) WHERE rank <= {K}), nt AS (SELECT q.qc, count(top.qc) AS n FROM q LEFT JOIN top ON top.qc = q.qc GROUP BY q.qc),
fill AS (SELECT nt.qc, cand.chunk_key, nt.n, row_number() OVER (PARTITION BY nt.qc ORDER BY cand.chunk_key) AS p FROM nt JOIN cand ON cand.qc = nt.qc LEFT JOIN top ON top.qc = nt.qc AND top.chunk_key = cand.chunk_key WHERE nt.n < {K} AND top.qc IS NULL),
res AS (SELECT qc, chunk_key, score, rank FROM top UNION ALL SELECT qc, chunk_key, 0.0, n + p FROM fill WHERE p <= {K} - n)
""" + diag_sql("qc")
NOISE = ["none", "retrieval_miss", "boilerplate", "wrong_company", "wrong_section", "table_label_missing", "answer_split_across_chunks"]


@query("a9_noise_by_config", CONFIG_SQL + f"SELECT q.cfg AS chunk_config, count(*) AS questions, round(avg(CAST(coverage_at_3 AS INT)), 6) AS coverage_at_3, {', '.join(f'''count(*) FILTER (noise_reason = '{n}') AS noise_{n}''' for n in NOISE)} FROM diag JOIN q USING (qc) GROUP BY q.cfg")
def a9_noise(spark, d):
    """Every configuration's retrieval, in an index of its own: coverage, and why questions fail."""
    g = config_diagnostics(spark, d).groupBy("chunk_config")
    return g.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("coverage_at_3").cast("int")), 6).alias("coverage_at_3"), *(F.count(F.when(F.col("noise_reason") == n, 1)).alias(f"noise_{n}") for n in NOISE))


@query("r7_results", RANKED_SQL + "SELECT res.pos, res.rank, res.score, c.chunk_id, " + ", ".join(f'c."{m}"' for m in R.METADATA) + " FROM res JOIN c ON c.chunk_key = res.chunk_key")
def r7(spark, d):
    """Every result with its chunk's metadata."""
    return results(spark, d, "chunk_id", *R.METADATA)[0].select("pos", F.col("rank").cast("long").alias("rank"), "score", "chunk_id", *R.METADATA)


@query("r13_diagnostics", DIAG_SQL + "SELECT * FROM diag")
def r13(spark, d):
    return _diagnosed(spark, d)[0]


@query("r16_first_metadata", RANKED_SQL + "SELECT res.pos, arg_min(c.chunk_config, res.rank) AS chunk_config FROM res JOIN c ON c.chunk_key = res.chunk_key WHERE coalesce(c.chunk_config, '') <> '' GROUP BY res.pos")
def r16(spark, d):
    """The first result's configuration that is not empty."""
    return R.first_metadata(results(spark, d, "chunk_config")[0], "pos", "chunk_config")


@query("r17_noise_reasons", DIAG_SQL + "SELECT noise_reason, count(*) AS questions FROM diag GROUP BY noise_reason")
def r17(spark, d):
    return _diagnosed(spark, d)[0].groupBy("noise_reason").agg(F.count("*").alias("questions"))


_HASH = lambda slot: f"CAST(('0x' || substr(md5('100:{slot}:' || q.pos), 1, 8)) AS BIGINT) % (n - 2 + {slot})"
RANDOM_TAIL = f"""num AS (SELECT chunk_key, row_number() OVER (ORDER BY chunk_key) - 1 AS number FROM c), n AS (SELECT count(*) AS n FROM c),
d0 AS (SELECT q.pos, {_HASH(0)} AS a, {_HASH(1)} AS b, {_HASH(2)} AS e, n FROM questions_verified q, n), d1 AS (SELECT pos, n, a, CASE WHEN b = a THEN n - 2 ELSE b END AS b, e FROM d0), d2 AS (SELECT pos, a, b, CASE WHEN e = a OR e = b THEN n - 1 ELSE e END AS e FROM d1),
drawn AS (SELECT pos, 1 AS rank, a AS number FROM d2 UNION ALL SELECT pos, 2, b FROM d2 UNION ALL SELECT pos, 3, e FROM d2), rnd AS (SELECT pos, rank, chunk_key FROM drawn JOIN num USING (number))
"""
RANDOM_SQL = "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_key DESC) AS rn FROM chunks WHERE text IS NOT NULL AND (retrievable IS NULL OR retrievable)) WHERE rn = 1)," + RANDOM_TAIL


@query("r18_random_context", RANDOM_SQL + "SELECT * FROM rnd")
def r18(spark, d):
    return R.random_context(_questions(spark, d), _chunks(spark, d), "pos", "chunk_key", K)


_TYPED = "net sales and free cash flow of the unit"
_TYPED_SQL = _WITH.replace("qt AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(" + _terms_sql("query") + ") AS term FROM q) GROUP BY ALL)", f"qt AS (SELECT pos, term, count(*) AS tf FROM (SELECT 0 AS pos, unnest({_terms_sql(chr(39) + _TYPED + chr(39))}) AS term) GROUP BY ALL)")


@query(
    "r19_inspect",
    _TYPED_SQL + f"""found AS (SELECT dw.chunk_key, sum(qw.w / qw.n * dw.w / dw.n) AS score FROM qw JOIN dw USING (term) GROUP BY dw.chunk_key),
kept AS (SELECT c.*, round(coalesce(found.score, 0), 6) AS score FROM c LEFT JOIN found USING (chunk_key) WHERE contains(lower(coalesce(company, '')), 'orb')), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_key) AS rank FROM kept)
SELECT rank, score, chunk_id, text, {', '.join(f'"{m}"' for m in R.METADATA)} FROM r WHERE rank <= 5""",
)
def r19(spark, d):
    """A query typed in, over the chunks of companies whose name holds a text: the five best."""
    chunks, counts, weights = _index(spark, d)
    return R.search(chunks, counts, weights, _TYPED, 5, {"company": "orb"}).withColumn("rank", F.col("rank").cast("long"))


@query("rag_top3_coverage", DIAG_SQL + "SELECT question_type, count(*) AS questions, avg(CAST(coverage_at_1 AS INT)) AS coverage_at_1, avg(CAST(coverage_at_3 AS INT)) AS coverage_at_3 FROM diag JOIN q USING (pos) GROUP BY question_type")
def rag_top3_coverage(spark, d):
    """The flagship: retrieval for every question, and how often its answer is among the results, by kind of question."""
    diag, q = _diagnosed(spark, d)
    diag = diag.join(q.select("pos", "question_type"), "pos")
    return diag.groupBy("question_type").agg(F.count("*").alias("questions"), F.avg(F.col("coverage_at_1").cast("int")).alias("coverage_at_1"), F.avg(F.col("coverage_at_3").cast("int")).alias("coverage_at_3"))


@query(
    "a15_ablation",
    _WITH + f"""b AS (SELECT sc.pos, sc.chunk_key, c.source_type, round(sc.score * {_BOOST}, 6) AS score FROM sc JOIN q ON q.pos = sc.pos JOIN c ON c.chunk_key = sc.chunk_key),
v AS (SELECT * FROM (VALUES ('all_retrievable'), ('narrative_only'), ('table_only')) t(variant)),
vb AS (SELECT v.variant, b.*, row_number() OVER (PARTITION BY v.variant, pos ORDER BY score DESC, chunk_key) AS rank FROM b, v WHERE v.variant = 'all_retrievable' OR (v.variant = 'narrative_only' AND source_type = 'narrative') OR (v.variant = 'table_only' AND source_type IN ('table_row', 'table_summary'))),
t AS (SELECT q.pos, v.variant, {', '.join(f"coalesce(string_agg(c.text, chr(10) ORDER BY rank) FILTER (rank <= {k}), '') AS t{k}" for k in (1, 3, 5))} FROM q CROSS JOIN v LEFT JOIN vb ON vb.pos = q.pos AND vb.variant = v.variant AND vb.rank <= 5 LEFT JOIN c ON c.chunk_key = vb.chunk_key GROUP BY ALL)
SELECT variant, count(*) AS questions, {', '.join(f"round(avg(CAST({S.covered(f't{k}', 'gold_evidence_text', 'answer', 'answer_aliases')} AS INT)), 6) AS coverage_at_{k}" for k in (1, 3, 5))} FROM t JOIN q USING (pos) GROUP BY variant""",
)
def a15(spark, d):
    """Coverage by the kinds of chunks looked at and by how many results are read: each variant ranks anew what was scored once."""
    kinds = {"all_retrievable": None, "narrative_only": ("narrative",), "table_only": ("table_row", "table_summary")}
    q = _questions(spark, d)
    found = M.best_matches(_asked(q), _corpus(spark, d), "pos", "chunk_key", 5, FILTERS, fill=False, variants=kinds)
    texts = _joined(spark, d, found, _told).groupBy("pos").agg(F.collect_list(F.struct("variant", "rank", "norm")).alias("r"))
    joined = q.select("pos", R.wanted(F.col("gold_evidence_text"), F.col("answer"), F.col("answer_aliases")).alias("_w")).join(texts, "pos", "left").withColumn("variant", F.explode(F.array(*map(F.lit, kinds))))
    own = joined.withColumn("r", F.array_sort(F.filter(F.coalesce("r", F.array().cast(texts.schema["r"].dataType)), lambda x: x["variant"] == F.col("variant"))))
    cov = lambda k: F.round(F.avg(R.covers(F.transform(F.slice("r", 1, k), lambda x: x["norm"]), F.col("_w")).cast("int")), 6)
    return own.groupBy("variant").agg(F.count("*").alias("questions"), *(cov(k).alias(f"coverage_at_{k}") for k in (1, 3, 5)))


@query("s17_postings", _WITH + "p AS (SELECT dw.term, count(*) AS chunks, round(sum(dw.w / dw.n), 6) AS weight FROM dw WHERE dw.term IN (SELECT term FROM qt) GROUP BY dw.term) SELECT * FROM p")
def s17(spark, d):
    """The index of the terms that questions have, written to the shared folder, and read back."""
    chunks, counts, weights = _index(spark, d)
    q = _questions(spark, d).withColumn("query", R.rewritten(_questions(spark, d)))
    asked = R.term_counts(q, "pos", "query").select("term").distinct()
    path = scratch(spark, "postings")
    R.save_index(R.postings(counts, weights, chunks, "chunk_key", FILTERS, asked), path, 8)
    return R.load_index(spark, path).groupBy("term").agg(F.count("*").alias("chunks"), F.round(F.sum("w"), 6).alias("weight"))
