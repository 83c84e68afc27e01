"""Every query against its SQL in DuckDB on the smallest tables; a few invariants for those that SQL can't express."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from deckloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert mine == theirs


def test_every_query_runs(spark):
    for name in sorted(set(plans.queries()) - set(plans.oracle_sql())):
        assert plans.queries()[name](spark, SF).count() > 0, name


def test_entry_and_guard(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
