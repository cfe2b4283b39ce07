"""TF-IDF and dense retrieval over chunks: filter, score, boost, rank, pack and diagnose, all as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.sorted_runs import numbered

# Words too frequent to index; a caller may pass others.
STOP_WORDS = tuple(
    "about above after again all also an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how if in "
    "into is it its just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with would you your".split()
)
# What a result tells of its chunk.
METADATA = ("chunk_config", "source_file", "ticker", "company", "year", "section_id", "section_name", "source_type", "table_id", "table_title", "row_label", "chunk_index", "token_count", "retrievable", "non_retrievable_reason")
# Words of a row label that select nothing.
LABEL_STOPS = ("what", "were", "was", "fiscal", "year", "apple", "microsoft", "company")
# How a row's label is recognised in a question.
ROW_LABEL = r"(?i)([A-Za-z][A-Za-z &'/-]{2,80}?\s(?:net sales|revenue|gross margin|income|expenses|cash flow|sales))"


def terms(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of two characters or more that are no stop words, and their pairs."""
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda x: ~x.isin(*stop))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return rows.select(F.col(key).alias(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n: Column | int) -> DataFrame:
    """(term, idf): ln((1 + n) / (1 + df)) + 1, over all indexed rows, not the filtered ones."""
    n = F.lit(n) if isinstance(n, int) else n
    return counts.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def within(terms: DataFrame, group: str) -> DataFrame:
    """Terms made those of their group: an index of several corpora in one, each with its own document frequencies."""
    return terms.withColumn("term", F.concat_ws("\x01", group, "term"))


def idf_within(counts: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """(term, df, idf) of terms made with :func:`within`; sizes has each group's number of rows, n."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).withColumn(group, F.substring_index("term", "\x01", 1))
    return df.join(F.broadcast(sizes), group).select("term", "df", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))  # a row a configuration


def unit_weights(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, w): tf-idf of terms that are indexed, each key's vector of length 1."""
    w = counts.join(weights.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def candidates(queries: DataFrame, docs: DataFrame, filters: list[str], always: str | None = None) -> list[tuple[DataFrame, list[str]]]:
    """Queries in groups by which of their filters are set, each with its join keys: an unset filter matches everything, and no group needs more than an equi-join.

    A filter that is ``always`` set makes no groups.
    """
    out = []
    for mask in range(1 << len(filters)):
        on = [f for i, f in enumerate(filters) if mask >> i & 1]
        if always in filters and always not in on:
            continue
        cond = reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit("")) != "" if f in on else F.coalesce(F.col(f), F.lit("")) == "" for f in filters], F.lit(True))
        out.append((queries.where(cond), on))
    return out


def postings(counts: DataFrame, weights: DataFrame, docs: DataFrame, key: str, filters: list[str], asked: DataFrame | None = None) -> DataFrame:
    """(key, term, w, _filter...): the index as a table, each row's vector of length 1, with the columns that queries filter by.

    With ``asked``, a table of terms, only their postings are kept; lengths still count every term of a row.
    """
    w = counts.join(weights.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    kept = w if asked is None else w.join(asked.select("term").distinct(), "term", "left_semi")
    return kept.join(norms, key).join(docs.select(key, *(F.upper(f).alias(f"_{f}") for f in filters)), key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"), *(f"_{f}" for f in filters))


def save_index(posted: DataFrame, path: str, buckets: int = 64) -> None:
    """Write postings, in files by the hash of the term, so that a query's terms meet few of them."""
    posted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_index(spark, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Postings from where they were written; of some terms only, where they are named: files without them are not read."""
    df = spark.read.parquet(path)
    if terms is None:
        return df.drop("bucket")
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    return df.join(F.broadcast(wanted), ["bucket", "term"]).drop("bucket")


def scores(query_weights: DataFrame, posted: DataFrame, query_key: str, doc_key: str, queries: DataFrame, filters: list[str], always: str | None = None) -> DataFrame:
    """(query_key, doc_key, score) of pairs that share a term and pass the query's filters.

    Postings carry the filter columns, so term and filters are one join key and a filtered query never meets
    the postings of other groups; a term in a third of the rows is split by AQE as a skewed join.
    """
    out = None
    for group, on in candidates(queries, posted, filters, always):
        asked = query_weights.join(group.select(query_key, *(F.upper(f).alias(f"_{f}") for f in on)), query_key)
        pairs = asked.withColumnRenamed("w", "qw").join(posted.select(doc_key, "term", F.col("w").alias("dw"), *(f"_{f}" for f in on)), ["term", *(f"_{f}" for f in on)])
        one = pairs.groupBy(query_key, doc_key).agg(F.sum(F.col("qw") * F.col("dw")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def passes(filters: dict[str, str | None]) -> Column:
    """Whether a chunk passes filters by ticker, year (equal but for case) and company (contained but for case); unset ones pass all."""
    out = F.lit(True)
    for name in ("ticker", "year", "company"):
        if want := (filters.get(name) or "").strip():
            have = F.lower(F.coalesce(F.col(name), F.lit("")))
            out = out & (F.contains(have, F.lit(want.lower())) if name == "company" else have == want.lower())
    return out


def filters_of(question: dict, open_corpus: bool = False) -> dict[str, str]:
    """What a question filters by: its ticker and year, or nothing over the open corpus."""
    return {} if open_corpus else {k: str(question[k]) for k in ("ticker", "year") if question.get(k)}


def search(chunks: DataFrame, counts: DataFrame, weights: DataFrame, query: str, k: int = 3, filters: dict[str, str | None] | None = None) -> DataFrame:
    """Results of one query typed in: rank, score, chunk_id, text and a chunk's metadata; chunks without a shared word fill up at score 0."""
    spark = chunks.sparkSession
    asked = unit_weights(term_counts(spark.createDataFrame([(0, query)], "q int, query string"), "q", "query"), weights, "q")
    kept = chunks.where(passes(filters or {}))
    found = asked.select("term", F.col("w").alias("qw")).join(postings(counts, weights, chunks, "chunk_key", [], asked), "term").groupBy("chunk_key").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    ranked = kept.join(found, "chunk_key", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6)).orderBy(F.desc("score"), "chunk_key").limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_key"))).select("rank", "score", "chunk_id", "text", *(c for c in METADATA if c in chunks.columns))


def timed(df: DataFrame) -> tuple[list, float]:
    """(rows, seconds) of a small result: what a retrieval took, as a driver sees it."""
    import time

    began = time.perf_counter()
    rows = df.collect()
    return rows, time.perf_counter() - began


def top_k(scored: DataFrame, query_key: str, doc_key: str, k: int, places: int = 6) -> DataFrame:
    """The k best rows of each query, ties by the row's key; scores are rounded first, so the order of summation doesn't show."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scored.withColumn("score", F.round("score", places)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filled(ranked: DataFrame, queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, k: int, filters: list[str], always: str | None = None) -> DataFrame:
    """Ranked rows; a query with fewer than k gets further rows that pass its filters, at score 0, in key order.

    Only short queries look for fillers, and only the first 2k rows of each filter group can be any, as k of them
    may be ranked already: they are gathered by a partial aggregate and meet the queries of their group.
    """
    short = queries.join(ranked.groupBy(query_key).agg(F.count("*").alias("_n")), query_key, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < k)
    out = ranked.select(query_key, doc_key, "score", "rank")
    for group, on in candidates(short, docs, filters, always):
        keys = [F.upper(f).alias(f"_{f}") for f in on]
        w = Window.partitionBy(*(f"_{f}" for f in on), "_part").orderBy(doc_key)
        first = docs.select(doc_key, *keys, F.spark_partition_id().alias("_part")).withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= 2 * k).drop("_part", "_o") if on else docs.select(doc_key).orderBy(doc_key).limit(2 * k)
        first = first.groupBy(*(f"_{f}" for f in on)).agg(F.slice(F.array_sort(F.collect_list(doc_key)), 1, 2 * k).alias("_first"))
        asked = group.select(query_key, "_n", *keys)
        pairs = asked.join(first, [f"_{f}" for f in on]) if on else asked.join(F.broadcast(first))  # one row of 2k ids
        extra = pairs.select(query_key, "_n", F.explode("_first").alias(doc_key)).join(ranked.select(query_key, doc_key), [query_key, doc_key], "left_anti")
        extra = extra.withColumn("_p", F.row_number().over(Window.partitionBy(query_key).orderBy(doc_key))).where(F.col("_p") <= k - F.col("_n"))
        out = out.unionByName(extra.select(query_key, doc_key, F.lit(0.0).alias("score"), (F.col("_n") + F.col("_p")).cast("int").alias("rank")))
    return out


def row_label_terms(row_label: Column, question: Column) -> Column:
    """Words that name the row a question asks for."""
    label = F.coalesce(row_label, F.lit(""))
    source = F.when(label != "", label).otherwise(F.coalesce(question, F.lit("")))
    found = F.regexp_extract(source, ROW_LABEL, 1)
    chosen = F.regexp_replace(F.when(found != "", found).otherwise(label), "'s", "")
    return F.filter(F.transform(F.split(F.trim(chosen), r"\s+"), lambda w: F.lower(w)), lambda w: (F.length(w) > 2) & ~w.isin(*LABEL_STOPS))


def boost(question_type: Column, section_id: Column, source_type: Column, text: Column, row_terms: Column) -> Column:
    """Factor of a score by how well the chunk's kind fits the question's."""
    low = F.lower(text)
    all_there = (F.size(row_terms) > 0) & F.forall(row_terms, lambda t: F.contains(low, t))
    is_table = source_type.isin("table_row", "table_summary")
    numeric = F.when(is_table, F.lit(1.75) * F.when(section_id.isin("Item 7", "Item 8"), 1.35).otherwise(1.0) * F.when(all_there, 2.5).otherwise(1.0)).otherwise(1.0)
    risk = F.when((section_id == "Item 1A") & (source_type == "narrative"), 1.75).otherwise(1.0)
    why = F.when((section_id == "Item 7") & source_type.isin("narrative", "local_context"), 1.5).otherwise(1.0)
    return F.when(question_type == "numeric_fact", numeric).when(question_type == "risk_factor", risk).when(question_type == "explanation", why).otherwise(1.0)


def rewritten(q: DataFrame) -> Column:
    """A question with what is known about its answer's place."""
    base = [F.col(c) for c in ("question", "ticker", "company", "year")]
    numeric = [F.col("row_label"), F.col("source_section"), F.col("source_type"), F.array_join(F.filter(F.slice(F.coalesce("answer_aliases", F.array().cast("array<string>")), 1, 3), lambda x: x != ""), " "), F.array_join(row_label_terms(F.col("row_label"), F.col("question")), " "), F.lit("net sales revenue table")]
    hint = {"risk_factor": "risk factors Item 1A", "explanation": "MD&A Item 7 driven by increase decrease", "text_fact": "business segment products services"}
    joined = lambda cols: F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), " ")
    out = F.when(F.col("question_type") == "numeric_fact", joined(base + numeric))
    for kind, words in hint.items():
        out = out.when(F.col("question_type") == kind, joined([*base, F.lit(words)]))
    return out.otherwise(joined(base))


def packed_context(results: DataFrame, questions: DataFrame, query_key: str, budget: int = 700) -> DataFrame:
    """(query_key, context, pieces) of every question: ranked texts with their marks under a budget of words, as a running sum; empty without results.

    results has rank, text, ticker, year, section_id and source_type. A piece that overflows is cut to what is
    left, and left out where that is eight words or less; so is all that follows.
    """
    label = F.array_join(F.filter(F.array("ticker", "year", "section_id", "source_type"), lambda x: x.isNotNull() & (x != "")), " ")
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit(": "), label, F.lit("] "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    w = Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = results.withColumn("_p", piece).withColumn("_n", T.word_count(F.col("_p"))).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    left = F.lit(budget) - F.col("_before")
    cut = F.array_join(F.slice(T.words(F.col("_p")), F.lit(1), F.greatest(left, F.lit(0)).cast("int")), " ")
    kept = rows.withColumn("_k", F.when(F.lit(budget == 0) | (F.col("_n") <= left), F.col("_p")).when(left > 8, cut)).where("_k is not null")
    got = kept.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", "_k"))).alias("_a"))
    got = questions.select(query_key).join(got, query_key, "left")
    return got.select(query_key, F.coalesce(F.array_join(F.transform("_a", lambda x: x["_k"]), "\n\n"), F.lit("")).alias("context"), F.when(F.col("_a").isNull(), 0).otherwise(F.size("_a")).alias("pieces"))


def wanted(evidence: Column, answer: Column, aliases: Column) -> Column:
    """What an answer is recognised by, normalised."""
    all_ = F.concat(F.array(evidence, answer), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.filter(F.transform(F.filter(all_, lambda x: x.isNotNull()), T.normalize_answer), lambda x: x != "")


def covers(norms: Column, wanted: Column) -> Column:
    """:func:`answer_coverage` of normalised texts, line by line, which reads as that of the texts together."""
    return T.let(F.array_join(F.filter(norms, lambda x: x != ""), " "), lambda hay: F.exists(wanted, lambda x: F.contains(hay, x)))


def diagnostics(results: DataFrame, questions: DataFrame, query_key: str, *keep: str) -> DataFrame:
    """One row per question, those without results too: what was found, coverage at 1, 3 and 5, source, section and row accuracy at 3, the covering chunk and why retrieval failed.

    results has the key, rank, chunk_id, ticker, year, section_id and source_type, and either text, or what is read of
    it: the normalised text, norm, and whether it looks forward, boiler.
    """
    if "norm" not in results.columns:
        results = results.withColumns({"norm": T.normalize_answer(F.coalesce("text", F.lit(""))), "boiler": F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("forward-looking"))})
    known = F.col("wanted") if "wanted" in questions.columns else wanted(F.col("gold_evidence_text"), F.col("answer"), F.col("answer_aliases"))
    asked = questions.select(query_key, "question_type", *(F.col(c).alias(f"q_{c}") for c in ("ticker", "year", "source_section")), known.alias("_w"), *(F.col(c).alias(f"q_{c}") for c in keep))
    own = F.exists("_w", lambda x: F.contains(F.col("norm"), x))
    fits = ((F.coalesce("q_ticker", F.lit("")) == "") | (F.upper(F.coalesce("ticker", F.lit(""))) == F.upper("q_ticker"))) & ((F.coalesce("q_year", F.lit("")) == "") | (F.coalesce("year", F.lit("")) == F.col("q_year")))
    r = results.join(asked.select(query_key, "q_ticker", "q_year", "_w"), query_key).withColumns({"_own": own, "_fits": fits, "_sec": F.coalesce("section_id", F.lit("")), "_type": F.coalesce("source_type", F.lit(""))})
    one = F.struct("rank", "chunk_id", "norm", "boiler", "_own", "_fits", "_sec", "_type")
    g = asked.join(r.groupBy(query_key).agg(F.array_sort(F.collect_list(one)).alias("_r")), query_key, "left").withColumn("_r", F.coalesce("_r", F.array().cast(r.select(F.array(one).alias("x")).schema["x"].dataType)))
    top = lambda k: F.slice("_r", 1, k)
    told = lambda f: F.array_join(F.transform("_r", f), ";")
    cov = lambda k: covers(F.transform(top(k), lambda x: x["norm"]), F.col("_w"))
    expected = (F.coalesce("q_ticker", F.lit("")) != "") | (F.coalesce("q_year", F.lit("")) != "")
    section = F.coalesce("q_source_section", F.lit(""))
    g = g.withColumns({f"coverage_at_{k}": cov(k) for k in (1, 3, 5)}).withColumn("source_accuracy_at_3", F.when(expected, F.exists(top(3), lambda x: x["_fits"])))
    g = g.withColumn("section_accuracy_at_3", F.when(section != "", F.exists(top(3), lambda x: x["_sec"] == section))).withColumn("table_row_recall_at_3", F.when(F.col("question_type") == "numeric_fact", F.exists(top(3), lambda x: x["_type"] == "table_row")))
    src = F.col("source_accuracy_at_3")
    reason = (
        F.when(F.col("coverage_at_3") & (src.isNull() | src), "none").when((F.size("_r") == 0) & ~F.col("coverage_at_3"), "retrieval_miss").when(F.exists("_r", lambda x: x["boiler"]), "boilerplate")
        .when(src.isNotNull() & ~src, "wrong_company").when((F.size("_r") > 0) & (section != "") & ~F.exists("_r", lambda x: x["_sec"] == section), "wrong_section")
        .when((F.col("question_type") == "numeric_fact") & ~F.exists("_r", lambda x: x["_type"] == "table_row"), "table_label_missing").when((F.size("_r") > 0) & ~F.col("coverage_at_3"), "answer_split_across_chunks").otherwise("none")
    )
    matched = F.get(F.filter(top(5), lambda x: x["_own"]), 0)["chunk_id"]
    return g.select(
        query_key, told(lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"), told(lambda x: x["_sec"]).alias("retrieved_sections"), told(lambda x: x["_type"]).alias("retrieved_source_types"), F.size("_r").alias("results"),
        "coverage_at_1", "coverage_at_3", "coverage_at_5", "source_accuracy_at_3", "section_accuracy_at_3", "table_row_recall_at_3", matched.alias("matched_chunk_id"), reason.alias("noise_reason"), *(F.col(f"q_{c}").alias(c) for c in keep),
    )


def first_metadata(results: DataFrame, query_key: str, name: str) -> DataFrame:
    """(query_key, name): the first result's value that is not empty."""
    return results.where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "").groupBy(query_key).agg(F.min_by(F.col(name), "rank").alias(name))


def random_context(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, k: int, seed: int = 100) -> DataFrame:
    """(query_key, rank, doc_key): k rows for each query, each set of k equally likely, by a hash of seed, slot and query.

    Rows are numbered without gaps in key order, so each can be drawn; a number drawn twice gives way to the last
    one its slot allows, which no earlier slot can have: k different ones for every query, or all where there are fewer.
    """
    table = numbered(docs, doc_key)
    n = table.count()
    k = min(k, n)
    if not k:
        return queries.select(query_key, F.lit(None).cast("int").alias("rank"), F.lit(None).cast(docs.schema[doc_key].dataType).alias(doc_key)).limit(0)
    draw = lambda slot: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), slot, F.col(query_key))), 1, 8), 16, 10).cast("long"), slot + F.lit(n - k + 1))
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), lambda got, slot: F.concat(got, F.array(F.when(F.array_contains(got, draw(slot)), slot.cast("long") + (n - k)).otherwise(draw(slot)))))
    hit = queries.select(query_key, F.posexplode(picks).alias("rank", "number")).join(table.select("number", doc_key), "number")
    return hit.select(query_key, (F.col("rank") + 1).alias("rank"), doc_key)


def dense_top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 32_768) -> DataFrame:
    """The k nearest rows of each query by cosine, each query against all rows.

    The stated queries go in blocks, each of which meets every part of the rows in one grouped task: blocks times
    parts tasks, however many queries there are; a task keeps the k best of its part, and only these are shuffled.
    """
    import numpy as np
    import pandas as pd

    src = vectors.select(F.col(key).alias("d"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col(key).alias("d"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    kind = vectors.schema[key].dataType.simpleString()
    blocks = max(1, -(-asked.count() // block))
    parts = max(1, min(src.rdd.getNumPartitions(), 4096))
    place = F.pmod(F.xxhash64("d"), F.lit(blocks))
    left = asked.select(place.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "d", "v")
    right = src.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("d", F.lit(1)), F.lit(parts)).cast("int").alias("p"), "d", "v")

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], "d": [], "score": []})
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        left, right, ids = unit(np.stack(q["v"].to_list())), unit(np.stack(x["v"].to_list())), x["d"].to_numpy()
        top_s, top_d = np.empty((len(q), 0)), np.empty((len(q), 0), dtype=ids.dtype)
        for a in range(0, len(right), 256):
            top_s = np.hstack([top_s, np.round(left @ right[a : a + 256].T, 6)])
            top_d = np.hstack([top_d, np.broadcast_to(ids[a : a + 256], (len(q), len(ids[a : a + 256])))])
            keep = np.lexsort((top_d, -top_s), axis=1)[:, :k]
            top_s, top_d = np.take_along_axis(top_s, keep, 1), np.take_along_axis(top_d, keep, 1)
        return pd.DataFrame({"q": np.repeat(q["d"].to_numpy(), top_s.shape[1]), "d": top_d.ravel(), "score": top_s.ravel()})

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(best, f"q {kind}, d {kind}, score double")
    return top_k(found, "q", "d", k)
