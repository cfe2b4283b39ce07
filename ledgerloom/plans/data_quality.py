"""Queries of the general data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import orphans, units
from ledgerloom.plans import query
from ledgerloom.session import table


def _read(spark, d):
    states = units.unit_states(table(spark, d, "unit_factors"))
    rows = table(spark, d, "evaluation_details").where("numeric_available")
    return units.readings(rows, states, "detail_id", "question_id", "evaluated_at", "question", ["gold_answer", "prediction", "extracted_numeric_answer"]), states


def _decoded(spark, d, bare_weight):
    return units.decode_units(*_read(spark, d), bare_weight)


@query("p1_found")
def p1_found(spark, d):
    """Fields that state the gold answer's quantity once both are in base units, bare numbers by the rule of the data."""
    return units.matches_gold(units.ruled_values(*_read(spark, d)), "gold_answer", values=("rule_value",)).select(F.col("row_id").alias("detail_id"), "field")


@query("p1_units")
def p1_units(spark, d):
    """Every reading in its base unit, with the unit the level suggests for bare numbers."""
    return _decoded(spark, d, units.INFER).select(F.col("row_id").alias("detail_id"), "field", "mention_no", "dimension", "value", "unit", "scale", F.col("base_value").alias("value_in_base_unit"), "switched", (F.abs(F.col("base_value") - F.col("rule_value")) > 1e-9 * F.abs("rule_value")).alias("differs_from_rule"))


@query("p1_differences")
def p1_differences(spark, d):
    """How many readings of each field and dimension the sequence decodes otherwise than the rule of the data reads them."""
    decoded = _decoded(spark, d, units.RULE)
    differs = F.abs(F.col("base_value") - F.col("rule_value")) > 1e-9 * F.abs("rule_value")
    return decoded.groupBy("field", "dimension").agg(F.count("*").alias("readings"), F.count(F.when(F.col("bare"), 1)).alias("bare"), F.count(F.when(differs, 1)).alias("differ"), F.count(F.when(differs & F.col("bare"), 1)).alias("bare_differ"))


QUESTION_CHUNKS = orphans.ForeignKey("questions_verified", "question_id", "relevant_chunk_ids", "chunks", "chunk_id", "validated_at")
DETAIL_QUESTION = orphans.ForeignKey("evaluation_details", "detail_id", "question_id", "questions_verified", "question_id", "evaluated_at")
DETAIL_CHUNKS = orphans.ForeignKey("evaluation_details", "detail_id", "retrieved_chunk_ids", "chunks", "chunk_id", "evaluated_at")


def _lifetimes(spark, d):
    return {"chunks": orphans.Lifetime("ingested_at", table(spark, d, "chunk_deletions"), "chunk_id", "deleted_at")}


P6_FOUND_SQL = """
WITH refs AS (SELECT DISTINCT question_id, validated_at, unnest(relevant_chunk_ids) AS chunk_id FROM questions_verified),
born AS (SELECT chunk_id, min(ingested_at) AS born FROM chunks GROUP BY chunk_id),
gone AS (SELECT chunk_id, min(deleted_at) AS gone FROM chunk_deletions GROUP BY chunk_id)
SELECT DISTINCT r.question_id, r.chunk_id FROM refs r LEFT JOIN born b ON b.chunk_id = r.chunk_id LEFT JOIN gone g ON g.chunk_id = r.chunk_id
WHERE r.chunk_id IS NOT NULL AND r.question_id IS NOT NULL AND (b.born IS NULL OR b.born > r.validated_at OR g.gone <= r.validated_at)"""


@query("p6_found", P6_FOUND_SQL)
def p6_found(spark, d):
    """Questions' references to chunks that were missing, late or deleted when the question was validated: the cascade's depth 0."""
    found = _links(spark, d, [QUESTION_CHUNKS, DETAIL_QUESTION]).where("depth = 0 AND child_table = 'questions_verified'")
    return found.select(F.col("child_key").alias("question_id"), F.col("parent_key").alias("chunk_id")).distinct()


def _links(spark, d, fks):
    tables = {n: table(spark, d, n) for n in ("questions_verified", "chunks", "evaluation_details")}
    return orphans.orphan_links(tables, fks, _lifetimes(spark, d))


_BORN = """born AS (SELECT chunk_id, min(ingested_at) AS born FROM chunks GROUP BY chunk_id),
gone AS (SELECT chunk_id, min(deleted_at) AS gone FROM chunk_deletions GROUP BY chunk_id)"""
_ORPHAN = "SELECT '{0}' AS child_table, 'chunks' AS parent_table, r.t, CASE WHEN b.born IS NULL THEN 'missing' WHEN b.born > r.t THEN 'late' WHEN g.gone <= r.t OR (g.gone IS NOT NULL AND r.t IS NULL) THEN 'deleted' END AS reason FROM {1} r LEFT JOIN born b ON b.chunk_id = r.chunk_id LEFT JOIN gone g ON g.chunk_id = r.chunk_id WHERE r.chunk_id IS NOT NULL AND r.id IS NOT NULL"


@query(
    "p6_by_month",
    f"""WITH rq AS (SELECT DISTINCT question_id AS id, validated_at AS t, unnest(relevant_chunk_ids) AS chunk_id FROM questions_verified), re AS (SELECT DISTINCT detail_id AS id, evaluated_at AS t, unnest(retrieved_chunk_ids) AS chunk_id FROM evaluation_details), {_BORN},
o AS ({_ORPHAN.format('questions_verified', 'rq')} UNION ALL {_ORPHAN.format('evaluation_details', 're')} UNION ALL
 SELECT 'evaluation_details', 'questions_verified', t, 'missing' FROM (SELECT DISTINCT detail_id, question_id, evaluated_at AS t FROM evaluation_details WHERE question_id IS NOT NULL AND detail_id IS NOT NULL) WHERE question_id NOT IN (SELECT question_id FROM questions_verified WHERE question_id IS NOT NULL))
SELECT child_table, parent_table, strftime(t, '%Y-%m') AS month, reason, count(*) AS orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL""",
)
def p6_by_month(spark, d):
    """Orphan references per table, month and reason: the cascade's depth 0 over every foreign key."""
    found = _links(spark, d, [QUESTION_CHUNKS, DETAIL_QUESTION, DETAIL_CHUNKS]).where("depth = 0")
    return found.groupBy("child_table", "parent_table", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphans"))


@query(
    "p6_cascade",
    """
WITH refs AS (SELECT DISTINCT question_id, validated_at, unnest(relevant_chunk_ids) AS chunk_id FROM questions_verified),
born AS (SELECT chunk_id, min(ingested_at) AS born FROM chunks GROUP BY chunk_id),
gone AS (SELECT chunk_id, min(deleted_at) AS gone FROM chunk_deletions GROUP BY chunk_id),
dq AS (SELECT DISTINCT r.question_id FROM refs r LEFT JOIN born b ON b.chunk_id = r.chunk_id LEFT JOIN gone g ON g.chunk_id = r.chunk_id
 WHERE r.chunk_id IS NOT NULL AND r.question_id IS NOT NULL AND (b.born IS NULL OR b.born > r.validated_at OR g.gone <= r.validated_at)),
er AS (SELECT DISTINCT detail_id, evaluated_at, unnest(retrieved_chunk_ids) AS chunk_id FROM evaluation_details),
de AS (SELECT DISTINCT e.detail_id FROM er e LEFT JOIN born b ON b.chunk_id = e.chunk_id LEFT JOIN gone g ON g.chunk_id = e.chunk_id
 WHERE e.chunk_id IS NOT NULL AND (b.born IS NULL OR b.born > e.evaluated_at OR g.gone <= e.evaluated_at)
 UNION SELECT detail_id FROM evaluation_details WHERE question_id IS NOT NULL AND question_id NOT IN (SELECT question_id FROM questions_verified WHERE question_id IS NOT NULL)),
inh AS (SELECT DISTINCT detail_id FROM evaluation_details WHERE question_id IN (SELECT question_id FROM dq) AND detail_id NOT IN (SELECT detail_id FROM de)),
every AS (SELECT 'questions_verified' AS "table", 0 AS depth, 'direct' AS kind FROM dq UNION ALL SELECT 'evaluation_details', 0, 'direct' FROM de UNION ALL SELECT 'evaluation_details', 1, 'inherited' FROM inh)
SELECT "table", depth, kind, count(*) AS records FROM every GROUP BY ALL""",
)
def p6_cascade(spark, d):
    """Orphaned records per table: direct ones, and those that hang from orphaned questions."""
    tables = {n: table(spark, d, n) for n in ("questions_verified", "chunks", "evaluation_details")}
    found = orphans.orphan_cascade(tables, [QUESTION_CHUNKS, DETAIL_QUESTION, DETAIL_CHUNKS], _lifetimes(spark, d))
    return found.groupBy("table", "depth", "kind").agg(F.count("*").alias("records"))
