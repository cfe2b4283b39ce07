"""Queries of the operators on text for language models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.llm import abuse, boilerplate, copies, leakage, mixing, pairs, splitting, truncation
from ledgerloom.llm import sql as S
from ledgerloom.plans import query
from ledgerloom.session import table


def _pieces(spark, d):
    config = F.coalesce(F.col("chunk_config"), F.lit("table_aware_mixed"))
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"), "chunk_key", "text", config, "chunk_config", "max_words", "overlap_words")


@query("p2_found", S.P2_FOUND)
def p2_found(spark, d):
    """Chunk rows that had to be split."""
    return _pieces(spark, d).where("piece_no = 0").select("chunk_key").distinct()


@query("p2_pieces")
def p2_pieces(spark, d):
    """The pieces of every oversized chunk, in order."""
    return _pieces(spark, d)


def _tables(spark, d):
    t = table(spark, d, "extracted_tables")
    return t, copies.canonical_table(F.col("table_title"), F.col("rows"))


@query("p4_found", S.P4_FOUND)
def p4_found(spark, d):
    """Copies of extracted tables, with the first record of their content."""
    t, key = _tables(spark, d)
    return copies.copy_groups(t, "record_id", key).where("record_id <> first_id").select("first_id", F.col("record_id").alias("copy_id"))


@query("p4_tables", S.P4_TABLES)
def p4_tables(spark, d):
    """One record per table, with its number of copies."""
    t, key = _tables(spark, d)
    return copies.collapse_copies(t, "record_id", key)


@query("p5_found", S.P5_FOUND)
def p5_found(spark, d):
    """Lines that at least 8 chunks of a ticker share."""
    return boilerplate.repeated_lines(table(spark, d, "chunks"), "chunk_key", "chunk_id", "ticker", "text").select("chunk_key", F.col("line_no").cast("long").alias("line_no"))


@query("p5_texts", S.P5_TEXTS)
def p5_texts(spark, d):
    """Every chunk's text without its repeated lines."""
    chunks = table(spark, d, "chunks")
    lines = boilerplate.repeated_lines(chunks, "chunk_key", "chunk_id", "ticker", "text")
    return boilerplate.without_lines(chunks, lines, "chunk_key", "text")


@query("p8_found", S.P8_FOUND)
def p8_found(spark, d):
    """Documents that hold at least 13 consecutive words of a held-out item's passage."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "passage")
    return found.where("run_words >= 13").select("doc_id", "item_id")


@query("p8_regions")
def p8_regions(spark, d):
    """Every region of a document that aligns with an item within the edit budget."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "passage")


def _mix(spark, d):
    sizes = mixing.sized(table(spark, d, "documents"), "doc_id", "source", "text")
    plan = mixing.mix_plan(sizes, table(spark, d, "mix_targets"), "source", "target_share", "max_repeats")
    return mixing.sample(sizes, plan), plan


@query("p9_mix")
def p9_mix(spark, d):
    """The documents of the mix and how often each is taken."""
    return _mix(spark, d)[0].withColumnRenamed("doc", "doc_id")


@query("p9_shares")
def p9_shares(spark, d):
    """Target share and share reached of every source."""
    return mixing.shares(*_mix(spark, d))


def _scored(spark, d):
    docs = table(spark, d, "documents")
    model = abuse.train(docs, table(spark, d, "doc_labels"), "doc_id", "text", "doc_id", "toxic")
    return abuse.scored(docs, model, "doc_id", "text", ["source"])


@query("p10_found")
def p10_found(spark, d):
    """Documents with an abusive, hateful or sexually explicit passage."""
    return _scored(spark, d).where("abusive").select("doc_id").distinct()


@query("p10_rates")
def p10_rates(spark, d):
    """Documents scored and rate of abuse per source."""
    rate = F.avg(F.col("abusive").cast("double"))
    return _scored(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("abusive").cast("int")).alias("abusive"), rate.alias("abusive_rate"), F.avg("score").alias("mean_score"))


def _cut(spark, d, keep=()):
    return truncation.truncated(table(spark, d, "evaluation_details"), "detail_id", "question", ["prediction", "retrieved_context"], list(keep))


@query("p3_found")
def p3_found(spark, d):
    """Values that stop before their end."""
    return _cut(spark, d).where("truncated").select("detail_id", "field").distinct()


@query("p3_rates")
def p3_rates(spark, d):
    """Share of cut values per system, run and field."""
    judged = _cut(spark, d, ("system", "run_id")).where("log_odds is not null")
    return judged.groupBy("system", "run_id", "field").agg(F.count("*").alias("texts"), F.sum(F.col("truncated").cast("int")).alias("cut"), F.avg(F.col("truncated").cast("double")).alias("cut_share"))


def _defects(spark, d):
    return pairs.defects(table(spark, d, "evaluation_details"), "detail_id", "question", ["prediction", "gold_answer"], "expected_refusal")


@query("p7_found")
def p7_found(spark, d):
    """Defective pairs of question and response, with the first defect that applies."""
    return _defects(spark, d).where("defect is not null").distinct()


@query("p7_rates")
def p7_rates(spark, d):
    """Pairs by field and defect, with their share of the field's pairs."""
    from pyspark.sql import Window

    n = _defects(spark, d).groupBy("field", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"))
    return n.withColumn("share", F.col("pairs") / F.sum("pairs").over(Window.partitionBy("field")))
