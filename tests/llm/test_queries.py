"""The registered queries over the driver's tables, against SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

from weftline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        path = Path(DATA, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    found = queries.queries()[name](spark, DATA)
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, v) for v in r])
    assert order(map(tuple, found.select(*columns).collect())) == order(result.fetchall())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
