"""Every query with SQL gives what DuckDB gives for it over the same tables."""

import glob
import math
import os
import re

import duckdb
import pytest

from shelfspark import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "hour"):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        r = db.execute(SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_nothing_but_llm_imports_llm():
    root = os.path.dirname(registry.__file__)
    for p in glob.glob(f"{root}/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert not re.search(r"(import|from)\b.*\bllm\b", open(p, encoding="utf-8").read()), p
