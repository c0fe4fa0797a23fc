"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest
from conftest import SMALL

from plateaux.plans import classification_queries, pipeline_queries, preprocess_queries, registry, retrieval_queries  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "float64"):
        return f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE_SQL:
        assert got[1]
        return
    found = db.execute(registry.ORACLE_SQL[name])
    assert got == canonical([d[0] for d in found.description], found.fetchall())
