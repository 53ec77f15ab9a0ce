"""Every catalogued query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyrule.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, float):
            return "None" if math.isnan(x) else f"{x:.9g}"
        return f"{float(x):.9g}" if isinstance(x, int) else str(x)

    return sorted(tuple(norm(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, data, name):
    df = catalogue.QUERIES[name](spark, data)
    found = duck.execute(catalogue.SQL[name])
    cols = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_run(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry_works_without_corpus_operators():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
