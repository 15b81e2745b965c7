"""Every registered query with an oracle gives the rows of its SQL; the others give rows of a fixed schema."""

from __future__ import annotations

import math

import duckdb
import pytest

from netsift.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return int(value) if isinstance(value, bool) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, cursor.fetchall())
    as_numbers = lambda x: [r.replace(".0,", ",").replace(".0)", ")") for r in x]
    assert sorted(as_numbers(mine)) == sorted(as_numbers(theirs))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in ("ml_drift_monitor", "str_drift_monitor")
    for r in rows:
        for c, x in r.asDict().items():
            if c in ("accuracy", "mean", "least", "most", "importance", "score") and x is not None:
                assert 0 <= x <= 1, (c, x)
