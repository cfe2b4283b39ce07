"""The best rows for each query by TF-IDF, filters and boost, without a table of postings or of scored pairs.

Terms are 64-bit hashes. Document frequencies are counted over all rows; those of the terms that queries have and of the
``FREQUENT`` most frequent ones go to every task. The others only add to a row's length: with a frequency of one
where all that are more frequent are there, else by a join. Each row goes to one cell of about ``PART`` rows, those alike in all
filters together, and a query to the cells that hold rows of its filters; a task
scores all pairs of a cell that pass the filters as a sparse product and keeps the k best of each query, so what is shuffled grows with
rows and queries and not with pairs.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.operators.retrieval import STOP_WORDS
from ledgerloom.session import scratch

FREQUENT = 3_000_000  # terms whose frequencies every task has, at 17 bytes each, and as many that queries have; no result depends on it
SLICE = 500_000  # terms of which the driver's memory holds frequencies at once, about
PART, BLOCK = 20_000, 50_000  # rows and queries that meet in a cell, about
CELLS, PAIRS = 2_000_000, 4_000_000  # scores and postings that a task handles at once, about
DICTIONARY = 16 << 20  # bytes of a column's distinct values in a file that are written once
MANY = 1000  # document frequencies told apart where the most frequent terms are chosen
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def word_hashes(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Hashes of the words of two characters or more that are no stop words, in order."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda x: ~x.isin(*stop))
    return F.transform(words, lambda x: F.xxhash64(x))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _flat(column: pa.ChunkedArray | pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    sizes = np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return c.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), sizes


def _counted(words: pa.Array, salt: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of words and pairs of neighbours, terms of each salt apart; ordered by row and term."""
    w, sizes = _flat(words, np.int64)
    w, row = w.view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        near = np.flatnonzero(row[1:] == row[:-1])
        h = np.concatenate([w, _mixed(w[near] * _A + w[near + 1])])
        row = np.concatenate([row, row[near]])
        h = _mixed(h + salt.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[row] * _C).view(np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)])
    return row[first], h[first], np.diff(np.r_[first, len(h)])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, at = np.unique(h, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def frequencies(rows: DataFrame) -> DataFrame:
    """(h, df) of rows' terms, summed up within a partition first; rows have words and salt."""

    def count(batches):
        held, size = [], 0
        for b in batches:
            held.append(np.unique(_counted(b.column("words"), b.column("salt"))[1], return_counts=True))
            size += len(held[-1][0])
            if size > PAIRS:
                held = [_summed(held)]
                size = len(held[0][0])
        if held:
            h, n = _summed(held)
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["h", "df"])

    return rows.select("words", "salt").mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: columns that a reader leaves out cost it nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", DICTIONARY).parquet(path)
    return df.sparkSession.read.parquet(path)


def _least(df: DataFrame, most: int) -> tuple[int, int]:
    """The least m such that at most ``most`` terms are in more than m rows, and how many these are."""
    by = {r.d: r.n for r in df.groupBy(F.least("df", F.lit(MANY)).alias("d")).agg(F.count("*").alias("n")).collect()}
    m, left = 0, sum(by.values())
    while left > most and m < MANY:
        m += 1
        left -= by.get(m, 0)
    return (m, left) if left <= most and m < MANY else (1 << 62, 0)


def _idf(n: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def _vectors(rows: DataFrame, known, ones: bool) -> DataFrame:
    """Rows with ids and counts of the terms that queries have, and the sum of squares of all known terms.

    Unknown terms are of no query: with ``ones`` each is in one row, which counts; else they are left to :func:`_squares`, or, as those of queries, in no row.
    """
    keep = [c for c in rows.columns if c not in ("words", "salt")]

    def read(batches):
        for b in batches:
            row, h, tf = _counted(b.column("words"), b.column("salt"))
            n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
            at, hit, df = _looked_up(h, known)
            counts = hit | ones
            w = tf[counts] * _idf(n[row[counts]], df[counts])
            told = hit.copy()
            told[hit] = known.value[2][at[hit]]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[told], minlength=len(n)))].astype(np.int32)), pa.array(x[told].astype(np.int32)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists(at), lists(tf), pa.array(np.bincount(row[counts], w * w, len(n)), pa.float64())], names=[*keep, "ids", "tfs", "sq"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(read, f"{kinds}, ids array<int>, tfs array<int>, sq double")


def _looked_up(h: np.ndarray, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, whether it is there, frequency or 1) of terms among the known ones."""
    h0, df0, _ = known.value
    at = np.minimum(np.searchsorted(h0, h), max(len(h0) - 1, 0))
    hit = h0[at] == h if len(h0) else np.zeros(len(h), bool)
    return at, hit, np.where(hit, df0[at] if len(h0) else 1, 1)


def _squares(rows: DataFrame, known, df: DataFrame) -> DataFrame:
    """(d, cell, sq): what the terms that are not known add to each row's sum of squares; df has their frequencies."""
    kind = rows.schema["d"].dataType.simpleString()

    def rest(batches):
        for b in batches:
            row, h, tf = _counted(b.column("words"), b.column("salt"))
            on = ~_looked_up(h, known)[1]
            of = pa.array(row[on])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in ("d", "cell", "n")), pa.array(h[on]), pa.array(tf[on].astype(np.int32))], names=["d", "cell", "n", "h", "tf"])

    x = rows.select("d", "cell", "n", "words", "salt").mapInArrow(rest, f"d {kind}, cell long, n long, h long, tf int")
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1
    return x.join(df, "h").groupBy("d", "cell").agg(F.sum(F.pow(F.col("tf") * idf, 2)).alias("sq"))


def _collected(terms: DataFrame, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """(h, df), ordered by h; frequencies in four bytes where these hold the number of rows."""
    t = terms.select("h", F.col("df").cast("int" if small else "long").alias("df")).toArrow()
    h, df = t["h"].to_numpy(), t["df"].to_numpy()
    order = np.argsort(h)
    return h[order], df[order]


def _slices(terms: int) -> list[Column]:
    """Conditions that cut the hashes of so many terms into ranges of about ``SLICE`` terms, in order."""
    parts = max(1, -(-terms // SLICE))
    ends = [i * (1 << 64) // parts - (1 << 63) for i in range(1, parts)]
    return [F.lit(True) if a is None and b is None else F.col("h") < b if a is None else F.col("h") >= a if b is None else (F.col("h") >= a) & (F.col("h") < b) for a, b in zip([None, *ends], [*ends, None], strict=True)]


def _known(asked: DataFrame, often: DataFrame, terms: int, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, df, whether asked) of the terms that every task has, ordered by h.

    They come a slice of the hashes at a time and lie in files without a name, so the driver's memory holds a slice, however many there are.
    """
    kinds = (np.int64, np.int32 if small else np.int64, np.bool_)
    files = [tempfile.TemporaryFile() for _ in kinds]
    for own in _slices(terms):
        h, df = _collected(asked.where(own), small)
        more, n = _collected(often.where(own), small)
        if len(h) and len(more):
            new = h[np.minimum(np.searchsorted(h, more), len(h) - 1)] != more
            more, n = more[new], n[new]
        at = np.searchsorted(h, more)
        for f, x, kind in zip(files, (np.insert(h, at, more), np.insert(df, at, n), np.insert(np.ones(len(h), bool), at, False)), kinds, strict=True):
            f.write(x.astype(kind, copy=False))
        del h, df, more, n, at, x
        pa.default_memory_pool().release_unused()
    out = tuple(np.memmap(f, kind, "r").view(np.ndarray) if f.tell() else np.empty(0, kind) for f, kind in zip(files, kinds, strict=True))
    for f in files:
        f.close()  # what is mapped stays
    return out


def _groups(rows: DataFrame, filters: list[str], always: str | None, masks: list[int] | None) -> Column:
    """The filter group of a query, or, with ``masks``, all groups that a row is in."""
    value = lambda f: F.col(f) if f == always else F.upper(F.coalesce(f, F.lit("")))
    of = lambda m: F.concat_ws("\x01", F.lit(str(m)), *(value(f) for i, f in enumerate(filters) if m >> i & 1))
    if masks is None:
        own = sum((F.when((F.lit(f == always)) | (F.coalesce(f, F.lit("")) != ""), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
        out = F.lit(None).cast("string")
        for m in range(1 << len(filters)):
            out = F.when(own == m, of(m)).otherwise(out)
        return out
    return F.array_compact(F.array(*(F.when(F.lit(True) if not m else F.concat(*(value(f) for i, f in enumerate(filters) if m >> i & 1)).isNotNull(), of(m)) for m in masks))) if masks else F.array().cast("array<string>")


def _factors(kind: np.ndarray, section: np.ndarray) -> dict[str, np.ndarray]:
    """Boost of each row by question type, that of numeric ones without their row's terms."""
    table = np.isin(kind, ["table_row", "table_summary"])
    return {
        "numeric_fact": np.where(table, 1.75 * np.where(np.isin(section, ["Item 7", "Item 8"]), 1.35, 1.0), 1.0),
        "risk_factor": np.where((section == "Item 1A") & (kind == "narrative"), 1.75, 1.0),
        "explanation": np.where((section == "Item 7") & np.isin(kind, ["narrative", "local_context"]), 1.5, 1.0),
    }


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _strings(column) -> np.ndarray:
    return np.array([x or "" for x in column.to_pylist()], dtype=object)


def _weights(t: pa.Table, sq: np.ndarray, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, weight, row) of vectors of length 1."""
    df0, n = known.value[1], t["n"].to_numpy().astype(float)
    ids, sizes = _flat(t["ids"], np.int64)
    row = np.repeat(np.arange(t.num_rows), sizes)
    return ids, _flat(t["tfs"], np.int64)[0] * _idf(n[row], df0[ids]) / np.sqrt(sq)[row], row


def _best(q: pa.Table, d: pa.Table, known, k: int, boosted: bool, fill: bool, variants: dict[str, tuple[str, ...] | None]) -> list[tuple]:
    """(query, row, variant, score, found) of the k best rows of each query, rows in key order; without k of them, also the first others, at 0."""
    docs, sq = d["d"].to_numpy(), d["sq"].to_numpy()
    qh, qw, who = _weights(q, q["sq"].to_numpy(), known)
    qsizes = np.bincount(who, minlength=q.num_rows)
    terms = np.unique(qh)
    h, w, row = _weights(d, sq, known)
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    on = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    at, row, w = at[on], row[on], w[on]
    order = np.argsort(at, kind="stable")
    row, w, ends, qends = row[order], w[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(terms)))], np.r_[0, np.cumsum(qsizes)]
    qt = np.searchsorted(terms, qh)
    lengths = ends[qt + 1] - ends[qt] if len(qt) else np.zeros(0, int)
    keys, types = q["q"].to_pylist(), _strings(q["question_type"])
    labels = q["row_terms"].to_pylist()
    kind, section = _strings(d["source_type"]), _strings(d["section_id"])
    factors, texts = _factors(kind, section), d["low"].to_pylist()
    table, plain = np.flatnonzero(np.isin(kind, ["table_row", "table_summary"])), np.ones(len(docs))
    cost = np.r_[0, np.cumsum(lengths)][qends]
    among = {name: np.ones(len(docs), bool) if v is None else np.isin(kind, v) for name, v in variants.items()}
    out, a = [], 0
    while a < len(keys):
        b = a + 1
        while b < len(keys) and (b + 1 - a) * len(docs) <= CELLS and cost[b + 1] - cost[a] <= PAIRS:
            b += 1
        x, y = qends[a], qends[b]
        long = lengths[x:y]
        place = np.arange(long.sum()) + np.repeat(ends[qt[x:y]] - np.r_[0, np.cumsum(long)[:-1]][: len(long)], long)
        who = np.repeat(np.repeat(np.arange(b - a), qsizes[a:b]), long)
        s = np.bincount(who * len(docs) + row[place], np.repeat(qw[x:y], long) * w[place], (b - a) * len(docs)).reshape(b - a, len(docs))
        for i in range(a, b):
            found = s[i - a] > 0
            factor = factors.get(types[i], plain) if boosted else plain
            score = _rounded(s[i - a] * factor)
            if boosted and types[i] == "numeric_fact" and labels[i] and len(table):
                # only rows that might be among the best are read for the row's terms
                least = min(np.partition(score[m], -k)[-k] if m.sum() > k else 0.0 for m in among.values())
                full = _rounded(s[i - a][table] * (factor[table] * 2.5))
                near = (full >= least) & found[table]
                for j, z in zip(table[near].tolist(), full[near].tolist(), strict=True):
                    if all(t in texts[j] for t in labels[i]):
                        score[j] = z
            for name, own in among.items():
                m = np.flatnonzero(found & own)
                if len(m) > k:
                    m = m[score[m] >= np.partition(score[m], -k)[-k]]
                m = m[np.argsort(-score[m], kind="stable")[:k]]
                out.extend((keys[i], docs[j], name, score[j], 1) for j in m.tolist())
                if fill and len(m) < k:
                    out.extend((keys[i], docs[j], name, 0.0, 0) for j in np.flatnonzero(~found[: 2 * k])[:k].tolist())
        a = b
    return out


def _whole(d: pa.Table) -> pa.Table:
    """Rows of a cell in key order, with all of their sums of squares."""
    more = d.filter(pc.is_null(d["ids"]))
    d = d.filter(pc.is_valid(d["ids"])).sort_by("d")
    sq = d["sq"].to_numpy() + np.bincount(np.searchsorted(d["d"].to_numpy(), more["d"].to_numpy()), more["sq"].to_numpy(), d.num_rows)
    return d.set_column(d.column_names.index("sq"), "sq", pa.array(sq, pa.float64()))


def _by_group(q: pa.Table, d: pa.Table):
    """(queries, rows) of each filter group that queries of a cell have."""
    groups = d["gs"].combine_chunks()
    groups = pa.concat_arrays(groups.chunks) if isinstance(groups, pa.ChunkedArray) else groups
    sizes = np.nan_to_num(groups.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat, row = groups.flatten().dictionary_encode(), np.repeat(np.arange(d.num_rows), sizes)
    codes, names = flat.indices.to_numpy(zero_copy_only=False), {g: i for i, g in enumerate(flat.dictionary.to_pylist())}
    order = np.argsort(codes, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(codes.astype(np.int64), minlength=len(names)))]
    asked = q["g"].combine_chunks().dictionary_encode()
    asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
    of = asked.indices.to_numpy(zero_copy_only=False)
    for j, g in enumerate(asked.dictionary.to_pylist()):
        if (i := names.get(g)) is not None:
            yield q.take(pa.array(np.flatnonzero(of == j))), d.take(pa.array(row[order[ends[i] : ends[i + 1]]]))


def best_matches(
    queries: DataFrame, rows: DataFrame, key: str, doc: str, k: int, filters: list[str], group: str | None = None, boosted: bool = True, fill: bool = True,
    variants: dict[str, tuple[str, ...] | None] | None = None, frequent: int | None = None, part: int | None = None, block: int | None = None,
) -> DataFrame:
    """(key, doc, variant, score, rank) of each query's k best rows; equal scores go by the row's key, scores are rounded to 6 places first.

    queries has words, question_type, row_terms and the filters, rows has words, low (the text of tables in lower case),
    section_id, source_type and the filters. Both have the ``group``, whose rows are a corpus of their own. With
    ``fill``, a query with fewer than k gets further rows that pass its filters, at score 0, in key order.
    """
    variants = variants or {"": None}
    assert not fill or list(variants.values()) == [None], "variants are not filled up"
    salt = F.xxhash64(group) if group else F.lit(0).cast("long")
    every = filters + ([group] if group else [])
    n = rows.count()
    if group:
        sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
        d = rows.join(F.broadcast(sizes), group)  # a row a corpus
        q = queries.join(F.broadcast(sizes), group)
    else:
        d, q = rows.withColumn("n", F.lit(n)), queries.withColumn("n", F.lit(n))
    low = F.col("low") if boosted else F.lit(None).cast("string").alias("low")  # only boosts read texts
    d = d.select(F.col(doc).alias("d"), F.col("n").cast("long").alias("n"), *every, "section_id", "source_type", low, "words", salt.alias("salt"))
    q = q.select(F.col(key).alias("q"), F.col("n").cast("long").alias("n"), *every, "question_type", "row_terms", "words", salt.alias("salt"))
    df = saved(frequencies(d), "frequencies")
    most = FREQUENT if frequent is None else frequent
    found = _matched(q, _in_cells(d, n, every, group, part or PART), df, _least(df, most), most, n < 1 << 31, k, every, group, boosted, fill, variants, block or BLOCK)
    w = Window.partitionBy("q", "v").orderBy(F.desc("f"), F.desc("s"), "d")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(key), F.col("d").alias(doc), F.col("v").alias("variant"), F.col("s").alias("score"), "rank")


def _in_cells(d: DataFrame, n: int, every: list[str], group: str | None, part: int) -> DataFrame:
    """Rows with the cell they go to: one for all that are alike in every filter, or several where these are more than ``part``."""
    key = _groups(d, every, group, [(1 << len(every)) - 1])[0]
    d = d.withColumn("_k", key)
    # of these the driver knows at most rows / part
    wide = d.groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > part).select("_k", F.ceil(F.col("_n") / part).cast("long").alias("_parts")).collect()
    own = F.pmod(F.xxhash64("d"), F.coalesce("_parts", F.lit(1).cast("long")))
    return d.join(F.broadcast(d.sparkSession.createDataFrame(wide, "_k string, _parts long")), "_k", "left").withColumn("cell", F.pmod(F.xxhash64("_k", own), F.lit(max(1, -(-n // part))).cast("long"))).drop("_k", "_parts")


def _matched(q, d, df, least, most, small, k, every, group, boosted, fill, variants, block, depth=0) -> DataFrame:
    """(q, d, v, s, f): the best of each part. Queries that have more than ``most`` terms go in halves."""
    spark, (m, often) = d.sparkSession, least

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_counted(b.column("words"), b.column("salt"))[1]))], names=["h"])

    asked = saved(q.select("words", "salt").mapInArrow(told, "h long").distinct().join(df, "h"), "asked")
    terms = asked.count()
    if depth < 16 and terms > most:
        half = lambda i: q.where(F.pmod(F.xxhash64(F.lit(depth), "q"), F.lit(2)) == i)
        return _matched(half(0), d, df, least, most, small, k, every, group, boosted, fill, variants, block, depth + 1).unionByName(_matched(half(1), d, df, least, most, small, k, every, group, boosted, fill, variants, block, depth + 1))
    known = spark.sparkContext.broadcast(_known(asked, df.where(F.col("df") > m), terms + often, small))
    q = saved(_vectors(q.withColumn("g", _groups(q, every, group, None)).drop(*every), known, False), "vectors")
    masks = sorted(int(r.m) for r in q.select(F.substring_index("g", "\x01", 1).alias("m")).distinct().collect())
    d = d.withColumn("gs", _groups(d, every, group, masks)).drop(*every)
    rows = _vectors(d, known, m <= 1)
    if m > 1:
        rows = rows.unionByName(_squares(d, known, df.where(F.col("df") <= m)), allowMissingColumns=True)
    places = d.select(F.explode("gs").alias("g"), "cell").distinct()
    left = q.join(places, "g")
    many = left.groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("cell", F.ceil(F.col("_n") / block).cast("long").alias("_blocks")).collect()
    busy = F.broadcast(spark.createDataFrame(many, "cell long, _blocks long"))  # at most queries and cells / block
    blocks = F.coalesce("_blocks", F.lit(1).cast("long"))
    left = left.join(busy, "cell", "left").withColumn("b", F.pmod(F.xxhash64("q"), blocks)).drop("_blocks")
    right = rows.join(busy, "cell", "left").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("_blocks")
    kinds = [q.schema["q"].dataType, d.schema["d"].dataType]
    schema = pa.schema([*zip("qd", map(to_arrow_type, kinds), strict=True), ("v", pa.string()), ("s", pa.float64()), ("f", pa.int32())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        got = []
        if a.num_rows and b.num_rows:
            for x, y in _by_group(a, _whole(b)):
                got.extend(_best(x, y, known, k, boosted, fill, variants))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*got, strict=True)) or [[]] * 5, schema.types, strict=True)], schema=schema)

    return left.groupBy("cell", "b").cogroup(right.groupBy("cell", "b")).applyInArrow(meet, f"q {kinds[0].simpleString()}, d {kinds[1].simpleString()}, v string, s double, f int")
