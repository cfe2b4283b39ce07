"""Every registered query outside the text subpackage against its SQL, on the smallest tables."""

from __future__ import annotations

import importlib
import math
import os

import duckdb
import pytest

from ledgerloom import plans

for m in ("data_quality", "text_queries", "chunk_queries", "retrieval_queries", "evaluation_queries", "curation_queries", "other_queries"):
    importlib.import_module(f"ledgerloom.plans.{m}")
CORE = sorted(plans.QUERIES)


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, duck, name):
    df = plans.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in plans.SQL:
        cur = duck.execute(plans.SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
