"""Queries give what their SQL gives on tables larger than the smallest ones: copies of a table with shifted keys."""

import os

import duckdb
import pytest

from shelfspark import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def grown(at, table: str, key: str, copies: int) -> duckdb.DuckDBPyConnection:
    """A connection with the table, written to ``at`` in so many copies; the others are those of DATA."""
    con = duckdb.connect()
    source = f"{DATA}/{table}.parquet"
    shift = f"SELECT max({key}) - min({key}) + 1 FROM '{source}'"
    con.execute(f"COPY (SELECT t.* REPLACE (t.{key} + i.i * ({shift}) AS {key}) FROM '{source}' t, range({copies}) i) TO '{at}/{table}.parquet' (FORMAT parquet)")
    for f in os.listdir(DATA):
        if not os.path.exists(f"{at}/{f}"):
            os.symlink(f"{DATA}/{f}", f"{at}/{f}")
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{at}/{f}'")
    return con


@pytest.mark.parametrize(
    ("name", "table", "key", "copies"),
    [
        ("o08_users_by_registration", "customer", "c_custkey", 20),
        ("pr17_action_labels", "part", "p_partkey", 60),
        ("pr17_action_labels", "part", "p_partkey", 6000),
    ],
)
def test_query_on_copies(spark, tmp_path, name, table, key, copies):
    con = grown(tmp_path, table, key, copies)
    df = registry.queries()[name](spark, str(tmp_path))
    r = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert [tuple(x[c] for c in names) for x in df.collect()] == r.fetchall()


def test_labels_of_counts_are_in_threes(spark):
    from shelfspark.operators import refresh

    counts = spark.createDataFrame([(1_200_000, 12_000)], "total long, failed long")
    assert refresh.action_labels(counts).first().asDict() == {"full": "Переиндексировать все книги (1 200 000)", "retry": "Повторить ошибки (12 000)", "retry_hidden": False}
