"""Every registered text query on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerloom import plans
from ledgerloom.llm import queries as _queries  # noqa: F401

NAMES = sorted(n for n, f in plans.QUERIES.items() if f.__module__ == "ledgerloom.llm.queries")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    df = plans.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name in plans.SQL:
        c = duckdb.connect()
        for f in os.listdir(data):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
        cur = c.execute(plans.SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(r[names.index(x)] for x in cols)) for r in cur.fetchall())
