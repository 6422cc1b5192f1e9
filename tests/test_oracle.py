"""Every query that SQL can say too, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from kindred.plans import registry


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return round(float(v), 9)
    except (TypeError, ValueError):
        return str(v)


def compare(spark, small, query, sql):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, small)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda rows, cols: sorted((repr([cell(r[cols.index(c)]) for c in order]) for r in rows))
    assert key([tuple(r) for r in df.collect()], df.columns) == key(rel.fetchall(), names)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
