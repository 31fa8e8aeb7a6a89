"""Every query beside its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import canonical, connect

NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(("p2_", "p3_", "p4_", "p5_", "p8_", "p9_", "p10_")))


@pytest.fixture(scope="module")
def con(data) -> duckdb.DuckDBPyConnection:
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, data, con, name):
    a, b = canonical(entry.queries()[name](spark, data).toPandas()), canonical(con.execute(entry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(10)


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "token", "n", "per_10k", "n_sentences", "rank"]


def test_names_are_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
