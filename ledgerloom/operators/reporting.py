"""Small tables made into Markdown and files, on the driver."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS, MOST_COLUMNS = 12, 12
# What the standard report compares systems by.
COMPARED = ("exact_match", "token_f1", "numeric_accuracy", "refusal_correct", "hallucinated_on_negative", "answer_coverage_at_3", "source_accuracy_at_3", "gold_answer_perplexity", "total_latency_seconds")


def comparison(summary: DataFrame) -> DataFrame:
    """The compared columns of each system's means, and how much slower it is than the baseline."""
    slow = F.max(F.when(F.col("system") == "baseline_gpt", F.col("total_latency_seconds"))).over(Window.partitionBy())  # a row a system
    return summary.select("system", *COMPARED, F.round(F.col("total_latency_seconds") - slow, 6).alias("latency_delta"))


def ablation(chunks: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row a configuration: its chunks, how many can be retrieved and how long they are, coverage, and questions lost to wrong sections or split answers."""
    told = chunks.groupBy("chunk_config").agg(F.count("*").alias("chunks"), F.count(F.when(F.col("retrievable").isNull() | F.col("retrievable"), 1)).alias("retrievable_chunks"), F.round(F.avg("token_count"), 6).alias("mean_tokens"))
    cov = lambda k: F.round(F.avg(F.col(f"coverage_at_{k}").cast("int")), 6).alias(f"coverage_at_{k}")
    lost = lambda n, a: F.count(F.when(F.col("noise_reason") == n, 1)).alias(a)
    found = diagnostics.groupBy("chunk_config").agg(F.count("*").alias("questions"), cov(1), cov(3), lost("wrong_section", "wrong_section"), lost("answer_split_across_chunks", "split"))
    return told.join(found, "chunk_config")


def oracle_report(sanity: DataFrame, path: str | None = None) -> str:
    """The report on the system with the right context: passed, warned or failed, why, and its figures."""
    r = sanity.first()
    verdict = "It passes." if r.passed and not r.reasons else "It passes, slowly." if r.passed else "It fails: " + r.reasons.replace(";", ", ") + "."
    return report("System with the right context", {"Verdict": verdict, "Figures": sanity.drop("passed", "warning_only", "reasons")}, path)


def ablation_report(table: DataFrame, best: DataFrame, path: str | None = None) -> str:
    """The report on configurations: all of them, and the best."""
    return report("Configurations", {"Retrieval": table.orderBy("chunk_config"), "Best": best}, path)


def cell(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, rows: int = MOST_ROWS, columns: int = MOST_COLUMNS) -> str:
    """The first rows and columns as a Markdown table; a line saying so where there are none."""
    cols = df.columns[:columns]
    got = df.select(*(f"`{c}`" for c in cols)).limit(rows).collect()
    if not got:
        return "_No rows._"
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(v) for v in r) + " |" for r in got)]
    return "\n".join(lines)


def report(title: str, sections: dict[str, DataFrame | str], path: str | None = None) -> str:
    """A Markdown report of tables and paragraphs."""
    text = "\n\n".join([f"# {title}", *(f"## {name}\n\n{body if isinstance(body, str) else markdown_table(body)}" for name, body in sections.items())]) + "\n"
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text


def validity_note(reasons: list[str]) -> str:
    """What a report says of a run's fitness."""
    return "The run passes its gates." if not reasons else "Diagnostic only: " + ", ".join(reasons) + "."


def run_report(gates: DataFrame, summary: DataFrame, failures: DataFrame, best: DataFrame, path: str | None = None) -> str:
    """The standard report: gates, systems, failures and the best configuration."""
    reasons = sorted({x for r in gates.limit(1000).collect() for x in (r.reasons or "").split(";") if x})
    keep = [c for c in ("system", "predictions", "exact_match", "token_f1", "numeric_accuracy", "answer_coverage_at_3", "gold_answer_perplexity", "perplexity_delta", "total_latency_seconds") if c in summary.columns]
    return report("Evaluation", {"Validity": validity_note(reasons), "Systems": summary.select(*keep).orderBy("system"), "Failures": failures.orderBy(failures.columns[0]), "Best configuration": best}, path)
