"""Every query with oracle SQL gives DuckDB's rows; every other one runs."""

import math

import duckdb
import pytest

from plumbline import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        assert got.count() >= 0 and got.columns
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
