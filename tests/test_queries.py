"""Every registered query with SQL, compared on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def kind(name):
    """Spark's and DuckDB's names of a type under one name."""
    name = str(name).lower()
    names = {"long": "bigint", "integer": "int", "varchar": "string", "bool": "boolean"}
    return next((to for of, to in names.items() if name.startswith(of)), name.split("(")[0])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    sql = con.sql(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})")
    types, want = [kind(t) for t in sql.types], sql.fetchall()
    assert [kind(dict(df.dtypes)[c]) for c in columns] == types

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=key) == sorted(map(tuple, want), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
