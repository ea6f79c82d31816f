"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from tessella.plans import catalog, relations

QUERIES, ORACLES = catalog.QUERIES | relations.QUERIES, catalog.ORACLES | relations.ORACLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r[c] for c in columns) for r in df.collect()], columns) == canonical(want.fetchall(), columns)
