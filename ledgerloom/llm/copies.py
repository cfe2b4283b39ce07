"""Records equal but for formatting, collapsed into one each with an exact number of copies.

A record's canonical form keeps only its content; canonical records are range-partitioned and externally
sorted by Spark, and one scan compares neighbours by their full keys, a batch at a time, carrying the last key and
its first id. A group of copies may span any number of partitions: the sort is by (key, id), and only the first run
of a partition can continue an earlier one. Executors compare the first key of each partition with the last key
before it; the driver gets two numbers a partition and no key.

Defined results: null cells and rows are blank, a null title is an empty one; records without any content
are copies of each other; records with a null id are left out; rows repeated with the same id count as
copies and have the same id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.sorted_runs import range_sorted

CELL, ROW, TITLE = "\x01", "\x02", "\x03"


def canonical_text(c: Column) -> Column:
    """Letters and digits in lower case; also a decimal point inside a number, and a minus or bracket right before one."""
    c = F.lower(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"(?U)[\s\p{Z}]+", "\x04")  # white space goes, but "1. 5" holds no decimal point
    c = F.regexp_replace(c, r"(?<=\d)[.](?=\d)", "\x05")
    c = F.regexp_replace(c, r"[-−‐-–](?=\d)(?<![\p{L}\p{N}].)", "\x06")
    c = F.regexp_replace(c, r"[(](?=\d)", "\x07")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\x05\x06\x07]", "")
    return F.translate(c, "\x05\x06\x07", ".-(")


def canonical_table(title: Column, rows: Column) -> Column:
    """Content of a table: cells sorted within rows, rows sorted, blank ones left out; the title is apart."""
    cells = lambda r: F.array_sort(F.filter(F.transform(F.coalesce(r, F.array().cast("array<string>")), canonical_text), lambda x: x != ""))
    lines = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.concat_ws(CELL, cells(r)))
    return F.concat(canonical_text(title), F.lit(TITLE), F.concat_ws(ROW, F.array_sort(F.filter(lines, lambda x: x != ""))))


def copy_groups(records: DataFrame, record_id: str, key: Column, partitions: int | None = None) -> DataFrame:
    """(first_id, record_id) of every record, first_id being the smallest id of the records with the same key."""
    table = range_sorted(records.where(F.col(record_id).isNotNull()).select(key.alias("key"), F.col(record_id).cast("long").alias("id")), ["key", "id"], partitions)
    edges = "part int, first_key string, last_key string, last_first long, runs long"

    def ends(frames):
        part = first = last = last_first = None
        n = 0
        for f in frames:
            if len(f):
                key = f["key"].to_numpy()
                new = np.flatnonzero(np.r_[last is None or key[0] != last, key[1:] != key[:-1]])
                part, first = int(f["_part"].iloc[0]), key[0] if first is None else first
                if len(new):
                    last_first, n = int(f["id"].iloc[int(new[-1])]), n + len(new)
                last = key[-1]
        if part is not None:
            yield pd.DataFrame([(part, first, last, last_first, n)], columns=["part", "first_key", "last_key", "last_first", "runs"])

    before = F.lag("last_key").over(Window.orderBy("part"))  # a row a partition
    pieces = table.mapInPandas(ends, edges).withColumn("goes_on", F.coalesce(F.col("first_key") == before, F.lit(False))).select("part", "last_first", "runs", "goes_on")
    known, open_id = {}, None
    for r in sorted(pieces.collect()):
        if r.goes_on:
            known[r.part] = open_id
        if r.runs > 1 or not r.goes_on:
            open_id = r.last_first

    def scan(frames):
        last, first_id, part = None, None, None
        for f in frames:
            if not len(f):
                continue
            key, ids = f["key"].to_numpy(), f["id"].to_numpy()
            if part is None:
                part = int(f["_part"].iloc[0])
                if part in known:
                    last, first_id = key[0], known[part]
            new = np.r_[last is None or key[0] != last, key[1:] != key[:-1]]
            starts = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(starts < 0, -1 if first_id is None else first_id, ids[np.maximum(starts, 0)])
            last, first_id = key[-1], int(first[-1])
            yield pd.DataFrame({"first_id": first, "record_id": ids})

    return table.mapInPandas(scan, "first_id long, record_id long")


def collapse_copies(records: DataFrame, record_id: str, key: Column, partitions: int | None = None) -> DataFrame:
    """One row per distinct content: (first_id, copies), copies counting the representative too."""
    return copy_groups(records, record_id, key, partitions).groupBy("first_id").agg(F.count("*").alias("copies"))
