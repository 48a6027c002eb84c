"""Every registered query of the engine against DuckDB on the same tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from crossquery.queries import ORACLE_SQL, QUERIES


def plain(x):
    if isinstance(x, float | decimal.Decimal):
        return float(x)
    return x.isoformat() if isinstance(x, datetime.date | datetime.datetime) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[k]) for k in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    with duckdb.connect() as db:
        for p in Path(sf_dir).iterdir():
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        yield db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    expected = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, expected.fetchall())
