from __future__ import annotations

import datetime as dt

from ledgerloom.operators import orphans as O

T = dt.datetime


def _tables(spark):
    q = spark.createDataFrame([("q1", ["a", "b", None, "a"], T(2025, 2, 1), "x"), ("q2", [], T(2025, 2, 1), "x"), ("q3", None, T(2025, 2, 1), "x"), ("q4", ["c", "d"], T(2025, 2, 1), None), ("q4", ["c", "d"], T(2025, 2, 1), None), ("q5", ["c"], None, None)], "question_id string, refs array<string>, validated_at timestamp, born string")
    c = spark.createDataFrame([("a", T(2025, 1, 1), "1"), ("a", T(2025, 3, 1), "2"), ("b", T(2025, 3, 1), "3"), ("c", T(2025, 1, 1), "4"), (None, T(2025, 1, 1), "5")], "chunk_id string, ingested_at timestamp, at string")
    d = spark.createDataFrame([("c", T(2025, 1, 20), "r"), ("c", T(2025, 1, 20), None), ("a", T(2025, 2, 2), None)], "chunk_id string, deleted_at timestamp, reason string")
    e = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "gone"), (4, None)], "detail_id long, question_id string")
    return {"q": q, "c": c, "e": e}, {"c": O.Lifetime("ingested_at", d, "chunk_id", "deleted_at")}


FK = O.ForeignKey("q", "question_id", "refs", "c", "chunk_id", "validated_at")


def test_direct(spark):
    tables, life = _tables(spark)
    got = {(r.child_key, r.parent_key, r.reason) for r in O.orphan_references(tables, [FK], life).collect()}
    assert got == {("q1", "b", "late"), ("q4", "c", "deleted"), ("q4", "d", "missing"), ("q5", "c", "deleted")}


def test_cascade(spark):
    tables, life = _tables(spark)
    got = {(r.table, r.key, r.depth, r.kind) for r in O.orphan_cascade(tables, [FK, O.ForeignKey("e", "detail_id", "question_id", "q", "question_id")], life).collect()}
    assert got == {("q", "q1", 0, "direct"), ("q", "q4", 0, "direct"), ("q", "q5", 0, "direct"), ("e", "3", 0, "direct"), ("e", "1", 1, "inherited")}


def test_empty(spark):
    tables, life = _tables(spark)
    tables["q"] = tables["q"].where("false")
    assert O.orphan_references(tables, [FK], life).count() == 0
    tables, life = _tables(spark)
    tables["c"] = tables["c"].where("false")
    assert O.orphan_references(tables, [FK], life).count() == 5


def test_links_of_the_cascade(spark):
    tables, life = _tables(spark)
    got = O.orphan_links(tables, [FK, O.ForeignKey("e", "detail_id", "question_id", "q", "question_id")], life)
    direct = {(r.child_key, r.parent_key, r.reason) for r in got.where("depth = 0 AND child_table = 'q'").collect()}
    assert direct == {(r.child_key, r.parent_key, r.reason) for r in O.orphan_references(tables, [FK], life).collect()}
    assert {(r.child_key, r.parent_key, r.reason, r.depth) for r in got.where("depth > 0").collect()} == {("1", "q1", "inherited", 1)}
