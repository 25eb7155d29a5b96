"""Every query of the subpackage against its SQL, and over empty tables."""

import importlib
from pathlib import Path

import duckdb
import pytest

from graphloom import llm
from verify import norm

SF = Path("/root/testdata/sf0.001")
QUERIES, SQL = {}, {}
for name in llm.QUERY_MODULES:
    module = importlib.import_module(f"graphloom.llm.{name}")
    QUERIES.update(module.QUERIES)
    SQL.update(module.ORACLE)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in SF.iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert mine == sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for p in SF.iterdir():
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(out / p.name))
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert len(QUERIES[name](spark, empty).collect()) <= 1
