"""Every registered query against its SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from corvane.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int | float | decimal.Decimal):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_equals_sql(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted([plain(r[i]) for i in place] for r in result.fetchall())
    got = sorted([plain(r[c]) for c in columns] for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_gives_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.queries()
