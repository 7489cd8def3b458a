import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tenmark.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_terms_cover_every_order(spark, sf_dir, duck):
    n = duck.execute("SELECT count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n DESC LIMIT 2").fetchall()
    assert sum(r.doc_count for r in registry.QUERIES["terms_agg_all"](spark, sf_dir).collect()) == sum(x for x, in n)
