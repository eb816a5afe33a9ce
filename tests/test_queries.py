"""Every registered query of the plans against its SQL, and the contract without the text part."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from figurant.plans import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(df.schema[c].dataType.simpleString()) for c in columns} == kinds
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["fig_id", "panel_id", "parent_id", "dist"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_text_part(tmp_path):
    root = Path(entry.__file__).parent
    for p in root.iterdir():
        if p.name == "figurant":
            (tmp_path / p.name).mkdir()
            for q in p.iterdir():
                if q.name != "llm":
                    (tmp_path / p.name / q.name).symlink_to(q)
        elif p.name == "__spark_entry__.py":
            (tmp_path / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('figurant.plans').plans.QUERIES), len(e.oracle_sql()) > 50)"
    # the script's own folder comes first on the path
    (tmp_path / "run.py").write_text(code)
    out = subprocess.run([sys.executable, "-B", str(tmp_path / "run.py")], capture_output=True, text=True, cwd=tmp_path, check=False)
    assert out.stdout.strip() == "True True", out.stderr
