"""The text queries over whole small tables against their SQL."""

import duckdb
import pytest

from figurant.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SMALL, TABLES, TYPES, plain


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert {c: TYPES.get(df.schema[c].dataType.simpleString()) for c in columns} == dict(zip(want.columns, map(str, want.types)))
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_a_row_per_row(spark, name):
    table, key = ("pages", "page_id") if name == "op7_language" else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()]
    assert sorted(r[0] for r in QUERIES[name](spark, SMALL).select(key).collect()) == sorted(ids)
