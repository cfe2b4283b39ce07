"""Lines repeated over the documents of one source, found and removed.

A line's normal form drops letter case, white space and the digits of numbers. Lines are hashed to two numbers of
64 bits from different seeds, distinct documents are counted for each source and hash, and those at the threshold or above are joined back.

Only (source, hash, document) rows are shuffled for the count, partially aggregated before; a line that
a third of all rows share is spread by its documents first. The texts meet the result by their own key.

Defined results: null and blank texts have no lines to remove; a null source has no repeated lines; a null
document counts for nothing; a line repeated within a document counts once there; repeated rows are handled
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_line(line: Column) -> Column:
    """Lower case, each run of digits as one mark, no white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), r"(?U)[\s\p{Z}]+", "")


def _lines(docs: DataFrame, row: str, doc: str, source: str, text: str) -> DataFrame:
    rows = docs.select(F.col(row).alias("_row"), F.col(doc).alias("_doc"), F.col(source).alias("_source"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "_line"))
    rows = rows.where(F.col("_source").isNotNull()).withColumn("_normal", normal_line(F.col("_line"))).where(F.col("_normal") != "")
    hashed = F.struct(F.xxhash64("_normal").alias("a"), F.xxhash64(F.lit("salt"), "_normal").alias("b"))
    return rows.select("_row", "_doc", "_source", "line_no", hashed.alias("_hash"))


def repeated_lines(docs: DataFrame, row: str, doc: str, source: str, text: str, least_docs: int = 8, least_share: float = 0.0) -> DataFrame:
    """(row, line_no, source) of each line found in ``least_docs`` documents of its source and in ``least_share`` of them."""
    lines = _lines(docs, row, doc, source, text)
    counts = lines.where(F.col("_doc").isNotNull()).select("_source", "_hash", "_doc").distinct().groupBy("_source", "_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_docs)
    if least_share > 0:
        sizes = docs.where(F.col(doc).isNotNull()).select(F.col(source).alias("_source"), F.col(doc).alias("_doc")).distinct().groupBy("_source").agg(F.count("*").alias("_docs"))
        counts = counts.join(sizes, "_source").where(F.col("_n") >= least_share * F.col("_docs"))
    found = lines.join(counts, ["_source", "_hash"])
    return found.select(F.col("_row").alias(row), F.col("line_no"), F.col("_source").alias(source), F.col("_n").alias("n_docs"))


def without_lines(docs: DataFrame, lines: DataFrame, row: str, text: str) -> DataFrame:
    """(row, text, n_removed) of every document, less its lines in ``lines``; the other lines keep order and form."""
    drop = lines.groupBy(F.col(row).alias("_row")).agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split(F.col("_text"), "\n"), lambda x, i: ~F.array_contains(F.col("_drop"), i))
    joined = docs.select(F.col(row).alias("_id"), F.col(text).alias("_text")).join(drop, F.col("_id") == F.col("_row"), "left")
    clean = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.concat_ws("\n", kept))
    return joined.select(F.col("_id").alias(row), clean.alias(text), F.coalesce(F.size("_drop"), F.lit(0)).alias("n_removed"))
