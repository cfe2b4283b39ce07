"""Rows that needn't be shuffled are told by prefixes of hashes; what they let pass is settled exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import matching, prefilter


def test_last_of_each_key(spark):
    rows = [(i, f"k{i % 37}" if i % 5 else None if i % 2 else f"own{i}", i * 7 % 11, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, key string, at int, text string")
    best = {}
    for r in rows:
        best[r[1]] = max(best.get(r[1], r), r, key=lambda x: (x[2], x[0]))
    for bits in (None, 2):
        got = prefilter.last_of(df, "key", ["id", "text"], ["at", "id"], bits).collect()
        assert sorted(map(tuple, got)) == sorted((r[0], r[3]) for r in best.values())


def test_rows_that_meet_keys(spark):
    df, keys = spark.range(500), spark.createDataFrame([(i,) for i in (3, 3, 77, 900)], "id long")
    for bits in (None, 1):
        assert {3, 77} <= {r.id for r in prefilter.that_meet(df, keys, "id", bits).collect()}
    assert prefilter.that_meet(df, keys, "id").count() < 10


def test_a_row_goes_to_one_cell_whatever_filters_queries_have(spark):
    d = spark.range(400).selectExpr("id d", "concat('T', id % 3) ticker", "cast(2020 + id % 2 as string) year")
    cells = matching._in_cells(d, 400, ["ticker", "year"], None, 50)
    assert cells.count() == 400 and cells.select("d").distinct().count() == 400 and cells.columns == ["d", "ticker", "year", "cell"]
    assert 1 < cells.select("cell").distinct().count() <= 8


def test_known_terms_are_asked_or_frequent(spark):
    asked, often = (spark.createDataFrame(x, "h long, df long") for x in ([(5, 2), (-3, 9)], [(9, 8), (-3, 9), (0, 7)]))
    h, df, told = matching._known(asked, often, True)
    assert h.tolist() == [-3, 0, 5, 9] and df.tolist() == [9, 7, 2, 8] and told.tolist() == [True, False, True, False] and df.dtype == np.int32


def test_saved_rows_hold_no_texts_but_tables(spark, data):
    from ledgerloom.plans import retrieval_queries as Q

    c = Q._corpus(spark, data)
    assert "text" not in c.columns and c.where("low is not null AND source_type NOT IN ('table_row', 'table_summary')").count() == 0
    assert Q._corpus(spark, data, low=False).where(F.col("low").isNotNull()).count() == 0
