"""Files and records in and out: documents, JSON lines, CSV, question files and chunk tables."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as X

SUFFIXES = (".txt", ".html", ".htm", ".pdf")
# Question files from the most preferred to the least, with the label of their source.
QUESTION_FILES = (
    ("questions_research.validated.jsonl", "research_validated"), ("questions_research.jsonl", "research"), ("questions_verified.remapped.jsonl", "verified_remapped"),
    ("questions_verified.jsonl", "verified"), ("questions.jsonl", "questions"), ("sample_questions.jsonl", "sample"),
)


class _Text(HTMLParser):
    """Text nodes of a page, one a line, without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def page_text(page: str | None) -> str | None:
    """Text of an HTML page; a page that can't be parsed further gives what came before."""
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    return "\n".join(p.out)


def html_to_text(c: Column) -> Column:
    """Text of HTML pages, cleaned; other texts are cleaned only."""

    @F.pandas_udf("string")
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(page_text, na_action="ignore")

    return X.clean_extracted(F.when(X.looks_like_html(c), parse(c)).otherwise(c))


def find_files(spark: SparkSession, root: str) -> DataFrame:
    """Documents under a folder; none where the folder is missing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.lower("path").rlike(r"\.(txt|html?|pdf)$"))


def find_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the documents under a folder, sorted; their contents are not read."""
    return find_files(spark, root).select("path").orderBy("path")


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    """text, source_file, ticker, company, year of every readable, non-blank file. PDFs need a reader that may be absent; they are blank then."""

    @F.pandas_udf("string")
    def read(content: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([pdf_text(b) if p.lower().endswith(".pdf") else bytes(b).decode("utf-8", "ignore") for b, p in zip(content, path, strict=True)], dtype=object)

    texts = find_files(spark, root).select("path", html_to_text(read("content", "path")).alias("text")).where(F.trim("text") != "")
    name = F.element_at(F.split("path", "/"), -1)
    return texts.select("text", name.alias("source_file"), X.filename_metadata(name).alias("m")).select("text", "source_file", "m.ticker", "m.company", "m.year")


def pdf_text(content: bytes) -> str:
    """Pages of a PDF, one after another; nothing without the optional reader."""
    try:
        import fitz
    except ImportError:
        return ""
    with fitz.open(stream=bytes(content), filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a file of JSON lines; blank lines are skipped, a malformed one fails the job; none where the file is missing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line): lines of JSON files that hold no record, by the name of their file; what a failed read is looked into with."""
    told = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("path"), F.col("value").alias("line"), told["_bad"].alias("_bad"))
    return rows.where("_bad is not null").select("path", "line")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines; ``mode`` "append" adds files."""
    df.write.mode(mode).json(path)


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Non-blank lines, unparsed."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_json(path: str, default=None):
    """A small JSON file on the driver."""
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else default


def write_json(path: str, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of several frames with all their columns, in the order in which they first occur."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    flat = df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType) else c for c in df.columns))
    flat.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def question_file(folder: str, explicit: str | None = None) -> tuple[str | None, str]:
    """(path, source label) of the best question file there is; an explicit one that is missing falls back."""
    if explicit and os.path.exists(explicit):
        return explicit, source_label(explicit)
    for name, label in QUESTION_FILES:
        p = os.path.join(folder, name)
        if os.path.exists(p):
            return p, label
    return None, "sample"


def source_label(path: str) -> str:
    return dict(QUESTION_FILES).get(os.path.basename(path), "explicit")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def cached_chunks(spark: SparkSession, root: str, config: str, build) -> DataFrame:
    """The chunk table of a configuration, built and written where it is missing. The path names the configuration, so none is mistaken for another."""
    path = f"{root.rstrip('/')}/chunk_config={config}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_by_system(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("system").parquet(path)


# The columns of a sample question, and two questions to try a run with.
SAMPLE_SCHEMA = "question_id string, question string, answer string, answer_aliases array<string>, ticker string, company string, year string, question_type string, gold_evidence_text string, relevant_chunk_ids array<string>, expected_refusal boolean"
SAMPLE_QUESTIONS = [
    ("SAMPLE_1", "What did Kordadex sell in fiscal 2024?", "pumps", ["pumps"], "KORD", "Kordadex", "2024", "text_fact", "Kordadex sold pumps.", [], False),
    ("SAMPLE_2", "How many ships does Kordadex own?", "not enough information", ["insufficient information"], "KORD", "Kordadex", "2024", "negative", "", [], True),
]
# Two documents to try chunking and retrieval with.
SMOKE_DOCUMENTS = [("Kordadex sold pumps for $12 million in fiscal 2024. Sales rose due to higher volumes.", "smoke_KORD_2024.txt", "KORD", "Kordadex", "2024"), ("Velmotis rents out cranes. This text is only there to be found.", "smoke_VELM_2024.txt", "VELM", "Velmotis", "2024")]


def smoke_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SMOKE_DOCUMENTS, "text string, source_file string, ticker string, company string, year string")


def load_questions(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """Questions of a file; where it is missing or empty, the sample ones, which are written there."""
    if path_exists(spark, path) and count_jsonl(spark, path):
        return read_jsonl(spark, path, schema)
    sample = spark.createDataFrame(SAMPLE_QUESTIONS, SAMPLE_SCHEMA)
    write_jsonl(sample, path)
    return sample


def distribution(questions: DataFrame) -> DataFrame:
    """(field, value, count): questions by kind, ticker and expected refusal, in one pass."""
    fields = {"question_type": F.coalesce("question_type", F.lit("")), "ticker": F.nullif(F.col("ticker"), F.lit("")), "expected_refusal": F.coalesce("expected_refusal", F.lit(False)).cast("string")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items())))
    return questions.select(each.alias("x")).where("x.value is not null").groupBy("x.field", "x.value").agg(F.count("*").alias("count"))


def install_questions(spark: SparkSession, source: str, out_dir: str, schema: str = SAMPLE_SCHEMA, dry_run: bool = False) -> dict:
    """Take a verified question file over: copied under both names, with its distribution as CSV and a summary as JSON. A dry run only counts."""
    if not path_exists(spark, source):
        raise FileNotFoundError(source)
    rows = read_jsonl(spark, source, schema)
    counts = distribution(rows).limit(100_000).collect()
    told = {f: {r["value"]: r["count"] for r in sorted(counts) if r.field == f} for f in ("question_type", "ticker", "expected_refusal")}
    summary = {"questions": rows.count(), **told, "source": source, "dry_run": dry_run}
    if not dry_run:
        for name in ("questions_verified.jsonl", "questions.jsonl"):
            if os.path.join(out_dir, name) != source:
                write_jsonl(rows, os.path.join(out_dir, name))
        write_csv(distribution(rows), os.path.join(out_dir, "question_distribution.csv"))
        write_json(os.path.join(out_dir, "install_summary.json"), summary)
    return summary


# The systems a run may ask for.
ALL_SYSTEMS = ("baseline_gpt", "rag_gpt_tfidf_top3", "oracle_gpt", "random_context_gpt")


@dataclass(frozen=True)
class RunConfig:
    """What a run is asked for; ``systems`` with commas between, all of them where it is empty, and at most ``limit`` questions in input order."""

    questions: str
    chunks: str
    run_id: str = "run"
    systems: str = ""
    chunk_config: str = "table_aware_mixed"
    top_k: int = 3
    context_words: int = 700
    limit: int | None = None

    def system_list(self) -> list[str]:
        asked = [s for s in map(str.strip, self.systems.split(",")) if s] or list(ALL_SYSTEMS)
        if unknown := [s for s in asked if s not in ALL_SYSTEMS]:
            raise ValueError(f"unknown systems: {unknown}")
        return asked

    def limited(self, questions: DataFrame, order: str = "pos") -> DataFrame:
        return questions if self.limit is None else questions.orderBy(order).limit(self.limit)
