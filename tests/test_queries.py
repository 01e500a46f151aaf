"""Every registered query against its SQL on the smallest data."""

import math
import os

import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF)] if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.5f}" if isinstance(x, (int, float)) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not TABLES, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not TABLES, reason="no test tables here")
def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SF).count() > 0, name


def test_entry(spark):
    if TABLES:
        assert registry.entry(spark, SF).count() > 0


@pytest.mark.skipif(not TABLES, reason="no test tables here")
def test_markdown_sections_are_a_query(spark):
    assert registry.queries()["chk04_markdown"](spark, SF).count() > 0


@pytest.mark.skipif(not TABLES, reason="no test tables here")
def test_search_answers_every_question(spark):
    asked = {r.log_id for r in spark.read.parquet(f"{SF}/rag_logs.parquet").filter("question is not null").select("log_id").collect()}
    got = registry.queries()["ret11_search"](spark, SF).collect()
    assert {r.query_id for r in got} == asked and len(got) == 5 * len(asked)
