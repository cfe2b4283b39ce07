"""References to records that do not exist: direct orphans, and what hangs from them down the foreign keys.

Defined results: null references and null elements are no references; keys are compared exactly; repeated
rows and repeated elements count once; a reference without a time is judged against everything ever
ingested or deleted; a parent row without a time counts as always there; empty tables have no references,
and references into an empty table are all missing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import checkpointed


@dataclass(frozen=True)
class ForeignKey:
    """``refs`` of ``child`` (a column or an array of keys) names ``parent_key`` of ``parent``; ``at`` is when a reference counts."""

    child: str
    child_key: str
    refs: str
    parent: str
    parent_key: str
    at: str | None = None


@dataclass(frozen=True)
class Lifetime:
    """When a parent's rows arrive, and the table of deletions, if any."""

    arrived: str | None = None
    deletions: DataFrame | None = None
    deleted_key: str | None = None
    deleted_at: str | None = None


def _time(df: DataFrame, col: str | None):
    return F.col(col).cast("timestamp") if col else F.lit(None).cast("timestamp")


def references(tables: dict[str, DataFrame], fk: ForeignKey) -> DataFrame:
    """Distinct (child_key, parent_key, at) of a foreign key."""
    child = tables[fk.child]
    is_array = isinstance(child.schema[fk.refs].dataType, T.ArrayType)
    keys = F.explode(F.array_distinct(F.col(fk.refs))) if is_array else F.col(fk.refs)
    rows = child.select(F.col(fk.child_key).cast("string").alias("child_key"), keys.alias("parent_key"), _time(child, fk.at).alias("at"))
    rows = rows.withColumn("parent_key", F.col("parent_key").cast("string"))
    return rows.where(F.col("parent_key").isNotNull() & F.col("child_key").isNotNull()).distinct()


def orphan_references(tables: dict[str, DataFrame], fks: list[ForeignKey], lifetimes: dict[str, Lifetime] | None = None) -> DataFrame:
    """References whose parent is missing, arrived later or was deleted by then: one row per (child, key, parent, key, time).

    The parent side is reduced to one row per key before the join (a partial aggregate on the map side), so a
    key that a third of all references name meets a single row, and its references may be split freely.
    """
    out = None
    for fk in fks:
        life = (lifetimes or {}).get(fk.parent, Lifetime())
        parent = tables[fk.parent]
        never = F.lit("0001-01-01 00:00:00").cast("timestamp")
        born = parent.where(F.col(fk.parent_key).isNotNull()).groupBy(F.col(fk.parent_key).cast("string").alias("parent_key")).agg(F.min(F.coalesce(_time(parent, life.arrived), never)).alias("born"))
        found = references(tables, fk).join(born, "parent_key", "left")
        if life.deletions is not None:
            gone = life.deletions.where(F.col(life.deleted_key).isNotNull() & F.col(life.deleted_at).isNotNull()).groupBy(F.col(life.deleted_key).cast("string").alias("parent_key")).agg(F.min(_time(life.deletions, life.deleted_at)).alias("gone"))
            found = found.join(gone, "parent_key", "left")
        else:
            found = found.withColumn("gone", F.lit(None).cast("timestamp"))
        reason = F.when(F.col("born").isNull(), "missing").when(F.col("born") > F.col("at"), "late").when(F.col("gone").isNotNull() & (F.col("at").isNull() | (F.col("gone") <= F.col("at"))), "deleted")
        found = found.select(F.lit(fk.child).alias("child_table"), "child_key", F.lit(fk.parent).alias("parent_table"), "parent_key", "at", reason.alias("reason")).where("reason is not null")
        out = found if out is None else out.unionByName(found)
    return out


def orphan_links(tables: dict[str, DataFrame], fks: list[ForeignKey], lifetimes: dict[str, Lifetime] | None = None) -> DataFrame:
    """All orphaned references: (child_table, child_key, parent_table, parent_key, at, reason, depth), ``direct`` ones at depth 0, with why, and below them those ``inherited``.

    A fixpoint: references to the records found last are added by a semi-join down each foreign key, less those of
    records known, until none is new. Each round's rows are checkpointed, so the plan stays as long as one round.
    """
    out = checkpointed(orphan_references(tables, fks, lifetimes).withColumn("depth", F.lit(0)))
    record = [F.col("child_table").alias("table"), F.col("child_key").alias("key")]
    known = fresh = out.select(*record).distinct()
    depth = 0
    while True:
        depth += 1
        nexts = None
        for fk in fks:
            if fk.parent not in {x.child for x in fks}:
                continue  # only records that can be orphans themselves hand it on
            parents = fresh.where(F.col("table") == fk.parent).select(F.col("key").alias("parent_key"))
            kids = references(tables, fk).join(parents, "parent_key", "left_semi").select(F.lit(fk.child).alias("child_table"), "child_key", F.lit(fk.parent).alias("parent_table"), "parent_key", "at")
            nexts = kids if nexts is None else nexts.unionByName(kids)
        if nexts is None:
            break
        new = nexts.join(known.select(F.col("table").alias("child_table"), F.col("key").alias("child_key")), ["child_table", "child_key"], "left_anti")
        new = checkpointed(new.select(*out.columns[:5], F.lit("inherited").alias("reason"), F.lit(depth).alias("depth")))
        fresh = new.select(*record).distinct()
        if new.isEmpty():
            break
        out, known = out.unionByName(new), known.unionByName(fresh)
    return out


def orphan_cascade(tables: dict[str, DataFrame], fks: list[ForeignKey], lifetimes: dict[str, Lifetime] | None = None) -> DataFrame:
    """All orphaned records: (table, key, depth, kind), kind ``direct`` at depth 0, else ``inherited``."""
    links = orphan_links(tables, fks, lifetimes).groupBy(F.col("child_table").alias("table"), F.col("child_key").alias("key")).agg(F.min("depth").alias("depth"))
    return links.withColumn("kind", F.when(F.col("depth") == 0, "direct").otherwise("inherited"))
