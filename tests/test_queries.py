"""Every query with SQL gives the SQL's rows, and every query runs."""

import importlib.util
import math

import duckdb
import pytest

import __spark_entry__
from fuzzloom.plans import data, maps

SQL = maps.oracle_sql() | data.oracle_sql()
QUERIES = maps.queries() | data.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in ("nation", "customer", "part", "orders", "lineitem", "events", "documents", "learning_rows", "fcm_records", "concept_deletions", "csv_lines", "csv_files", "class_values"):
        c.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return c


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


def key(row):
    return [(x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in row]


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(spark, small, con, name):
    frame = QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(con.execute(f"select {quoted} from ({SQL[name]})").fetchall(), key=key)
    assert len(got) == len(want) > 0
    assert all(all(map(close, g, w)) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert any(n.startswith("p2_") for n in names) == bool(importlib.util.find_spec("fuzzloom.llm") and importlib.util.find_spec("fuzzloom.llm.queries"))
