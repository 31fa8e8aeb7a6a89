import duckdb
import pytest

from legajo.llm import queries
from tools.verify import canonical, connect


@pytest.fixture(scope="module")
def con(data) -> duckdb.DuckDBPyConnection:
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, data, con, name):
    a, b = canonical(queries.QUERIES[name](spark, data).toPandas()), canonical(con.execute(queries.ORACLES[name]).df())
    assert a.equals(b)


FOUND = {
    "p2_found": ["paragraph_id", "kind", "item"], "p3_found": ["paragraph_id", "term"], "p4_found": ["tab", "rec_id"],
    "p5_found": ["rec_id", "sent_no", "start_pos"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_single_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns == FOUND[name]
    assert df.count() == df.distinct().count()
