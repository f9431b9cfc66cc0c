"""Each query against its SQL in another engine: same columns, same rows."""

import math
import os

import duckdb
import pytest

from millrace.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    want, have = rows(columns, got.fetchall()), rows(df.columns, df.collect())
    assert have == want and want, next(((a, b) for a, b in zip(have, want) if a != b), (len(have), len(want)))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_alarms_are_a_small_share(spark, sf):
    got = QUERIES["fdc_monitor"](spark, sf)
    assert 0 < got.where("spe_alarm").count() < 0.2 * got.count()
