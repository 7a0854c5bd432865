import duckdb
import pytest
from helpers import SF_CHECK

from marketgrid.llm.queries import QUERIES, SQL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_CHECK}/{table}.parquet')")
    df = QUERIES[name](spark, SF_CHECK)
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({SQL[name]})").fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)
    assert expected
