"""Commands over files: ``python -m ledgerloom COMMAND``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from ledgerloom.operators import chunking, curation, evaluation, inference, reporting, retrieval
from ledgerloom.session import build_session
from ledgerloom.sources import files


def _read(spark, path: str):
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def corpus(spark, a) -> None:
    """Chunks of the documents under a folder, one table a configuration."""
    docs = (files.load_documents(spark, a.documents) if a.documents else files.smoke_documents(spark)).withColumn("doc", F.sha2("source_file", 256))
    for config in chunking.parse_configs(a.configs):
        chunks = files.cached_chunks(spark, a.out, config, lambda config=config: chunking.build_chunks(docs, "doc", config))
        print(config, chunks.count())


def inspect(spark, a) -> None:
    """The best chunks for a query, with what is known of them."""
    chunks = _read(spark, a.chunks).where("text is not null")
    keyed = chunks if "chunk_key" in chunks.columns else chunks.withColumn("chunk_key", F.xxhash64("chunk_id"))
    counts = retrieval.term_counts(keyed, "chunk_key", "text")
    found = retrieval.search(keyed, counts, retrieval.idf(counts, keyed.count()), a.query, a.top_k, {"ticker": a.ticker, "year": a.year, "company": a.company})
    rows, seconds = retrieval.timed(found)
    for r in rows:
        print(f"{r['rank']} {r.score:.4f} {r.chunk_id} {' '.join(r.text.split())[:300]}")
    print(f"{seconds:.2f} s")


def validate(spark, a) -> None:
    """Questions with why they are not fit, as JSON lines."""
    q = curation.standardized(_read(spark, a.questions))
    reasons = curation.structural_reasons(q, curation.evidence_state(q, _read(spark, a.chunks)))
    files.write_jsonl(reasons, a.out)
    print(curation.balance_gaps(reasons.where("reasons = ''")).count(), "kinds of questions fall short")


def report(spark, a) -> None:
    """The standard report on predictions, and that on the system with the right context."""
    q = _read(spark, a.questions)
    scored = evaluation.details(_read(spark, a.predictions), q).cache()
    failures = scored.select("system", evaluation.failure().alias("failure")).groupBy("failure").count()
    gates = evaluation.run_gates(scored, q, a.source)
    print(reporting.run_report(gates, evaluation.by_system(scored), failures, gates.limit(0), a.out))
    print(reporting.oracle_report(evaluation.oracle_sanity(scored)))


def checkpoint(_, a) -> None:
    """Shape of a checkpoint file."""
    import numpy as np

    with np.load(a.file) as f:
        print(inference.shape_of({k: f[k] for k in f.files}))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    sub = p.add_subparsers(required=True)

    def add(run, *required, **optional):
        one = sub.add_parser(run.__name__, help=run.__doc__)
        one.set_defaults(run=run)
        for name in required:
            one.add_argument(name)
        for name, default in optional.items():
            one.add_argument("--" + name.replace("_", "-"), default=default, type=type(default) if isinstance(default, int) else str)

    add(corpus, "out", documents=None, configs="")
    add(inspect, "chunks", "query", ticker=None, year=None, company=None, top_k=3)
    add(validate, "questions", "chunks", "out")
    add(report, "predictions", "questions", out=None, source="verified")
    add(checkpoint, "file")
    return p


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    a.run(None if a.run is checkpoint else spark or build_session(), a)


if __name__ == "__main__":
    main()
