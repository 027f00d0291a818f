"""Every registered point-cloud query against its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from pointloom.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_plain(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(x) for x in r) for r in df.select(columns).collect()), key=repr)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_is_deterministic(spark, name):
    runs = [sorted(map(repr, catalog.queries()[name](spark, SF).collect())) for _ in range(2)]
    assert runs[0] and runs[0] == runs[1]


def test_stream_equals_batch(spark):
    a, b = (sorted(map(repr, catalog.queries()[n](spark, SF).collect())) for n in ("track_batch", "track_stream"))
    assert a == b


def test_wall_join_needs_no_shuffle(spark):
    plan = catalog.queries()["wall_semi_join"](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "Exchange hashpartitioning" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = catalog.queries()["latency_report"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan or "ReadSchema: struct<value:double,event_type:string>" in plan or "user_id" not in plan.rpartition("ReadSchema")[2]
