"""Every registered query of the metrics engine against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from gristmill.queries import ORACLE, QUERIES


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db(folder):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    own = _rows(df.columns, df.collect())
    if name not in ORACLE:
        assert own
        return
    r = db.execute(ORACLE[name])
    columns = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert own == _rows(columns, r.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
