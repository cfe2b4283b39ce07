"""A training mix in which each source has its target share of the tokens, by systematic sampling.

Each source gets an allotment of the mix's tokens, so its documents get allotment / tokens expected copies.
With the prefix sums S of these and one random offset u for the source, a document is emitted once per
integer in (S before + u, S with it + u]. Documents go by size and then by hash, so every size is drawn evenly
and the tokens come out close to the allotment.

Prefix sums don't need one task per source: all documents of a source have the same expected copies, so S is
a rank. Documents fall into buckets of bounded size by (size class, hash); ranks are counted within a bucket,
and a table of bucket sizes gives what lies before it.

Defined results: null, empty and blank texts have no tokens and are never drawn; a source without a target
gets nothing; a null source has none; a target without documents is left unmet; a source short of
documents is repeated at most ``max_repeats`` times and its rest goes to the others in proportion; null or
negative shares count as 0, null repeats as 1; repeated target rows count once (the largest); document rows
with the same id are each a document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import DEFAULT_VOCABULARY, token_count
from ledgerloom.session import checkpointed

BUCKET_ROWS = 100_000  # documents a bucket holds, about: bounds the rows one task ranks
MAX_TARGETS = 100_000


def allot(total: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Tokens per source: in proportion to shares, none above its cap, what a cap cuts off spread over the rest."""
    out = dict.fromkeys(shares, 0.0)
    open_, left = {s for s in shares if shares[s] > 0 and caps.get(s, 0) > 0}, float(total)
    while open_ and left > 0:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / weight >= caps[s]}
        if not full:
            for s in open_:
                out[s] = left * shares[s] / weight
            break
        for s in full:
            out[s] = caps[s]
            left -= caps[s]
        open_ -= full
    return out


def sized(documents: DataFrame, doc_id: str, source: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc, source, n_tokens) of every document, materialised: tokens are counted once."""
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), token_count(F.col(text), vocabulary).alias("n_tokens"))
    return checkpointed(rows)


def mix_plan(sizes: DataFrame, targets: DataFrame, source: str, share: str, repeats: str) -> DataFrame:
    """One row per target source: share, repeats allowed, tokens it has, tokens allotted, expected copies of a document."""
    spark = sizes.sparkSession
    t = targets.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.greatest(F.max(F.coalesce(share, F.lit(0.0))), F.lit(0.0)).alias("share"), F.max(F.coalesce(repeats, F.lit(1))).alias("repeats"))
    has = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("docs"))
    total = has.agg(F.sum("tokens")).first()[0] or 0
    rows = t.join(has, "source", "left").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    got = allot(total, {r.source: r.share for r in rows}, {r.source: float(r.repeats * (r.tokens or 0)) for r in rows})
    out = [(r.source, r.share, int(r.repeats), r.tokens or 0, r.docs or 0, got[r.source], got[r.source] / r.tokens if r.tokens else 0.0) for r in rows]
    return spark.createDataFrame(out, "source string, share double, repeats int, tokens long, docs long, allotted double, copies_each double")


def sample(sizes: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """(doc, source, n_tokens, copies) of every document the mix takes."""
    drawn = sizes.where("n_tokens > 0").join(F.broadcast(plan.where("copies_each > 0").select("source", "docs", "repeats", "copies_each")), "source")
    buckets = F.greatest(F.ceil(F.col("docs") / BUCKET_ROWS), F.lit(1))
    drawn = drawn.withColumn("class", F.floor(F.log2(F.col("n_tokens")) * 4)).withColumn("bucket", F.pmod(F.xxhash64("doc", F.lit(seed)), buckets))
    before = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source", "class", "bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("source", "class", "bucket").orderBy("n_tokens", F.xxhash64("doc", F.lit(seed)), "doc"))
    ranked = drawn.withColumn("_rank", within).join(counts, ["source", "class", "bucket"])
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rank = F.col("_before") + F.col("_rank")
    upto = lambda r: F.floor(r * F.col("copies_each") + offset + 1e-9)
    copies = F.least(upto(rank) - upto(rank - 1), F.col("repeats"))
    return ranked.select("doc", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(sampled: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: documents, copies and tokens drawn, its target share, the share it reached and by how much they differ."""
    got = sampled.groupBy("source").agg(F.count("*").alias("docs_drawn"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"))
    rows = plan.select("source", F.col("share").alias("target_share"), "repeats", "tokens").join(got, "source", "left").na.fill(0, ["docs_drawn", "copies", "tokens_drawn"])
    reached = rows.withColumn("share_reached", F.col("tokens_drawn") / F.sum("tokens_drawn").over(Window.partitionBy()))
    return reached.withColumn("deviation", F.col("share_reached") - F.col("target_share"))
