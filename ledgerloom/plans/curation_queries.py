"""Queries over the curation operators: all questions against all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import curation as Q
from ledgerloom.plans import query
from ledgerloom.plans import sqltext as S
from ledgerloom.plans.text_queries import _CAND
from ledgerloom.session import table


def _state(spark, d):
    q = table(spark, d, "questions_verified")
    return q, Q.evidence_state(q, table(spark, d, "chunks"))


def _any(x: str, phrases: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(repr(p) for p in phrases)}], lambda p: contains({x}, p))) > 0"


_STATE = f"""
WITH one AS (SELECT chunk_id, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_key DESC) AS rn FROM chunks WHERE text IS NOT NULL) WHERE rn = 1),
refs AS (SELECT * FROM (SELECT pos, gold_evidence_text, answer, answer_aliases, unnest(relevant_chunk_ids) AS chunk_id, generate_subscripts(relevant_chunk_ids, 1) AS i FROM questions_verified) WHERE chunk_id IS NOT NULL AND chunk_id <> ''),
jj AS (SELECT refs.*, one.text, {S.covered("coalesce(one.text, '')", 'gold_evidence_text', 'answer', 'answer_aliases')} AS ok FROM refs LEFT JOIN one ON one.chunk_id = refs.chunk_id),
st AS (SELECT q.pos, count(jj.pos) AS ids, count(*) FILTER (jj.pos IS NOT NULL AND jj.text IS NULL) AS missing, coalesce(bool_or(jj.ok), FALSE) AS supported,
 trim(array_to_string(list_filter(list_concat([any_value(coalesce(q.gold_evidence_text, ''))], coalesce(list(jj.text ORDER BY jj.i) FILTER (jj.text IS NOT NULL), [])), lambda x: x <> ''), ' ')) AS evidence
 FROM questions_verified q LEFT JOIN jj ON jj.pos = q.pos GROUP BY q.pos),
qq AS (SELECT q.*, st.ids, st.missing, st.supported, st.evidence, coalesce(q.expected_refusal, FALSE) AS due, coalesce(q.question_type, '') AS kind, {S.norm("coalesce(q.question, '')")} AS nq, {S.norm("coalesce(q.answer, '')")} AS na, {S.norm("st.evidence")} AS ne,
 row_number() OVER (PARTITION BY coalesce(nullif(q.question_id, ''), {S.norm("coalesce(q.question, '')")}) ORDER BY q.pos) > 1 AS repeat, {S.nums("coalesce(q.answer, '')")} AS nums FROM questions_verified q JOIN st ON st.pos = q.pos)
"""
_W = lambda c, n: f"CASE WHEN {c} THEN '{n}' END"
_B = lambda c: f"trim(coalesce({c}, '')) = ''"
_FIRST = [_W("repeat", "duplicate_question"), _W(_any("nq", Q.VAGUE), "vague_question"), _W(f"lower(coalesce(answer, '')) IN {Q.FILLER}", "placeholder_or_empty_answer"), _W(f"kind NOT IN {tuple(Q.BALANCE)}", "invalid_question_type")]
_NEG = [_W("NOT due AND ids = 0", "negative_expected_refusal_required"), _W("due AND na <> 'not enough information'", "negative_answer_must_be_not_enough_information"), _W("due AND ids > 0", "unsupported_negative_should_not_have_relevant_chunks"), _W(f"(due OR ids = 0) AND {_any('nq', Q.ABSURD)}", "negative_question_not_plausible")]
_UNIT = f"({_any(chr(108) + 'ower(coalesce(answer, ' + chr(39) * 2 + '))', ('%', 'percent', 'million', 'billion', 'thousand', '$'))} OR (len(nums) > 0 AND abs(nums[1]) < 100))"
_POS = [
    _W(_B("ticker"), "ticker_required"), _W(_B("company"), "company_required"), _W(_B('"year"'), "year_required"), _W("coalesce(answer, '') = ''", "answer_required"), _W(_B("normalized_answer"), "normalized_answer_required"),
    _W("coalesce(len(answer_aliases), 0) < 1", "answer_aliases_required"), _W(_B("gold_evidence_text"), "gold_evidence_required"), _W("ids = 0", "relevant_chunk_ids_required"), _W("missing > 0", "relevant_chunk_id_missing"),
    _W("ids > 0 AND missing = 0 AND NOT supported", "evidence_not_supported_by_relevant_chunks"), _W("kind = 'numeric_fact' AND len(nums) = 0", "numeric_answer_required"), _W(f"kind = 'numeric_fact' AND NOT {_UNIT}", "numeric_units_required"),
    _W("kind = 'numeric_fact' AND coalesce(source_type, '') NOT IN ('table_row', 'table_summary')", "numeric_source_type_should_be_table"),
]
_LIST = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL), ';')"
_Q1 = _STATE + f", v AS (SELECT pos, question_id, question_type, CASE WHEN kind = 'negative' THEN {_LIST(_FIRST + _NEG)} ELSE {_LIST(_FIRST + _POS)} END AS reasons FROM qq)"


_SHAPE = [x for x in _POS if "evidence_not_supported" not in x]


@query("q1_structure", _STATE + f", v AS (SELECT pos, question_id, question_type, CASE WHEN kind = 'negative' THEN {_LIST(_FIRST + _NEG)} ELSE {_LIST(_FIRST + _SHAPE)} END AS reasons FROM qq) SELECT * FROM v")
def q1_structure(spark, d):
    """Why questions are not well formed, but for whether their chunks hold their evidence, which SQL can't tell."""
    return Q.structural_reasons(*_state(spark, d), support=False)


@query("q1_validation")
def q1(spark, d):
    """Why questions are not well formed, likeness of evidence included."""
    return Q.structural_reasons(*_state(spark, d))


@query("q3_evidence", _STATE + " SELECT pos, ids, missing, supported AS covered, md5(evidence) AS evidence FROM st")
def q3(spark, d):
    return _state(spark, d)[1].withColumn("evidence", F.md5("evidence")).drop("supported")


@query("q4_fuzzy_support")
def q4(spark, d):
    """Questions whose evidence some chunk they name covers, or is like."""
    return _state(spark, d)[1].select("pos", "covered", "supported")


_KNOWN = "CASE upper(coalesce(ticker, '')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.COMPANIES.items()) + " END"


@query(
    "q8_standardized",
    f"""SELECT pos, coalesce(nullif("year", ''), '') AS "year", CASE WHEN (coalesce(company, '') = '' OR lower(company) = 'unknown') AND {_KNOWN} IS NOT NULL THEN {_KNOWN} ELSE company END AS company,
 CASE WHEN coalesce(normalized_answer, '') = '' AND coalesce(answer, '') <> '' THEN answer ELSE normalized_answer END AS normalized_answer,
 array_to_string(CASE WHEN coalesce(len(answer_aliases), 0) < 1 AND coalesce(question_type, '') <> 'negative' AND coalesce(answer, '') <> '' THEN [answer] ELSE answer_aliases END, '|') AS aliases FROM questions_verified""",
)
def q8(spark, d):
    """Questions with company, year, normalised answer and alias filled in."""
    return Q.standardized(table(spark, d, "questions_verified")).select("pos", "year", "company", "normalized_answer", F.array_join("answer_aliases", "|").alias("aliases"))


def _toc(x: str) -> str:
    n = S.norm(x)
    marks = " + ".join(f"CAST(contains({n}, '{m}') AS INT)" for m in Q.CONTENTS_MARKS)
    return f"({n} <> '' AND ({marks} >= 2 OR contains({n}, 'table of contents') OR len(regexp_extract_all({x}, '(?i)\\bitem\\s+\\d+[a-z]?\\b')) >= 4))"


_ITEM = f"na IN {Q.ITEM_ANSWERS}"
_AS_ITEM = f"({_ITEM} AND ({_toc('evidence')} OR contains(nq, 'what value did')))"
_SUBJECT = f"(NOT {_ITEM} AND len(nums) > 0 AND {_any(S.norm(chr(99) + 'oalesce(question, ' + chr(39) * 2 + ') || ' + chr(39) + ' ' + chr(39) + ' || evidence'), Q.SUBJECTS)})"
_SEM = [
    _W("repeat", "duplicate_question"), _W("coalesce(question, '') = '' OR kind = ''", "malformed_question"), _W(_any("nq", Q.TEMPLATES), "vague_question"), _W(_AS_ITEM, "toc_item_number_answer"),
    _W(f"{_toc('evidence')} OR {_toc(chr(99) + 'oalesce(question, ' + chr(39) * 2 + ')')}", "table_of_contents_question"), _W(f"regexp_full_match(na, '[0-9]+') AND length(na) <= 3 AND {_toc('evidence')} AND lpad(na, 3, '0') <= '400'", "page_number_answer"),
    _W("regexp_full_match(na, '[0-9]{4}') AND na BETWEEN '1900' AND '2100' AND (na = coalesce(\"year\", '') OR contains(nq, 'fiscal year') OR contains(ne, 'form 10 k'))", "incidental_year_answer"), _W("kind <> 'negative' AND evidence = ''", "missing_evidence"),
    _W(f"kind <> 'negative' AND evidence <> '' AND NOT ({S.covered('evidence', 'gold_evidence_text', 'answer', 'answer_aliases')})", "unsupported_answer"), _W(_any("ne", Q.BOILERPLATE), "boilerplate_evidence"),
    _W(f"({_ITEM} AND NOT {_AS_ITEM}) OR (kind = 'numeric_fact' AND NOT {_SUBJECT})", "not_financial_or_operational"),
]
_Q5 = _STATE + f", w AS (SELECT pos, question_type, {_LIST(_SEM)} AS reasons FROM qq), x AS (SELECT *, CASE WHEN reasons = '' THEN 'research_valid' WHEN {_any('reasons', Q.STRUCTURAL)} THEN 'structural_only' ELSE 'reject' END AS quality FROM w)"


@query("q5_cleaning", _Q5 + " SELECT * FROM x")
def q5(spark, d):
    return Q.semantic_reasons(*_state(spark, d))


@query("q7_balance", _Q5 + f", n AS (SELECT * FROM (VALUES {', '.join(f'''('{k}', {v})''' for k, v in Q.BALANCE.items())}) t(question_type, needed)) SELECT n.question_type, count(x.pos) AS questions, n.needed FROM n LEFT JOIN x ON x.question_type = n.question_type AND x.quality = 'research_valid' GROUP BY n.question_type, n.needed HAVING count(x.pos) < n.needed")
def q7(spark, d):
    return Q.balance_gaps(Q.semantic_reasons(*_state(spark, d)).where("quality = 'research_valid'"))


@query("q7_balance_by_ticker", _Q5 + f", n AS (SELECT * FROM (VALUES {', '.join(f'''('{k}', {v})''' for k, v in Q.BALANCE.items())}) t(question_type, needed)), t AS (SELECT DISTINCT coalesce(ticker, '') AS ticker FROM questions_verified), y AS (SELECT x.pos, x.question_type, coalesce(q.ticker, '') AS ticker FROM x JOIN questions_verified q ON q.pos = x.pos WHERE x.quality = 'research_valid') SELECT t.ticker, n.question_type, count(y.pos) AS questions, n.needed FROM t CROSS JOIN n LEFT JOIN y ON y.ticker = t.ticker AND y.question_type = n.question_type GROUP BY ALL HAVING count(y.pos) < n.needed")
def q7_by_ticker(spark, d):
    """Kinds of questions that a benchmark of one ticker would lack."""
    q, state = _state(spark, d)
    asked = q.select("pos", F.coalesce("ticker", F.lit("")).alias("ticker"))
    valid = Q.semantic_reasons(q, state).where("quality = 'research_valid'").join(asked, "pos")
    return Q.balance_gaps(valid, asked.select("ticker").distinct())


@query("q9_reason_counts", _Q5 + " SELECT question_type, reason, count(*) AS questions FROM (SELECT question_type, unnest(string_split(reasons, ';')) AS reason FROM x WHERE reasons <> '') GROUP BY ALL")
def q9(spark, d):
    r = Q.semantic_reasons(*_state(spark, d)).where("reasons <> ''")
    return r.select("question_type", F.explode(F.split("reasons", ";")).alias("reason")).groupBy("question_type", "reason").agg(F.count("*").alias("questions"))


_UNK = lambda c: f"coalesce(nullif({c}, ''), 'unknown')"


@query(
    "q9_cleaning_summary",
    _Q5 + f""", y AS (SELECT x.*, q.ticker, q.company FROM x JOIN questions_verified q ON q.pos = x.pos) SELECT 'total' AS category, 'input_questions' AS value, count(*) AS count FROM y UNION ALL
SELECT 'total', CASE WHEN quality = 'research_valid' THEN 'accepted_research_valid' ELSE 'rejected_or_structural' END, count(*) FROM y GROUP BY 2 UNION ALL SELECT 'rejected_by_reason', string_split(reasons, ';')[1], count(*) FROM y WHERE quality <> 'research_valid' GROUP BY 2 UNION ALL
SELECT 'accepted_by_question_type', {_UNK('question_type')}, count(*) FROM y WHERE quality = 'research_valid' GROUP BY 2 UNION ALL SELECT 'accepted_by_ticker', {_UNK('ticker')}, count(*) FROM y WHERE quality = 'research_valid' GROUP BY 2 UNION ALL
SELECT 'accepted_by_company', {_UNK('company')}, count(*) FROM y WHERE quality = 'research_valid' GROUP BY 2""",
)
def q9_summary(spark, d):
    """What cleaning kept and dropped, and why."""
    q, state = _state(spark, d)
    return Q.cleaning_summary(q, Q.semantic_reasons(q, state))


@query("q13_remap_report")
def q13(spark, d):
    """How much evidence remapping finds, keeps and misses: one row."""
    q = table(spark, d, "questions_verified")
    return Q.remap_report(q, Q.remap_evidence(q, table(spark, d, "chunks")))


@query("q10_evidence_remap")
def q10(spark, d):
    return Q.remap_evidence(table(spark, d, "questions_verified"), table(spark, d, "chunks"))


@query(
    "q15_question_gen",
    f"""WITH r AS (SELECT *, list_filter({_CAND}, lambda x, i: list_position(list_transform({_CAND}, lambda y: lower(y)), lower(x)) = i)[1] AS a FROM chunks WHERE source_type = 'table_row' AND (retrievable IS NULL OR retrievable) AND text IS NOT NULL),
n AS (SELECT *, row_number() OVER (ORDER BY chunk_key) AS n FROM r WHERE a IS NOT NULL ORDER BY chunk_key LIMIT 35)
SELECT concat_ws('_', coalesce(ticker, 'UNK'), coalesce("year", '2025'), 'NUM', printf('%03d', n)) AS question_id, 'What was ' || coalesce(company, ticker, 'the company') || '''s ' || coalesce(row_label, 'the reported row') || ' in fiscal ' || coalesce("year", '2025') || '?' AS question, a AS answer, chunk_id FROM n""",
)
def q15(spark, d):
    """Questions generated from the first rows with a figure: 35 are asked for."""
    return Q.generated_numeric(table(spark, d, "chunks"))
