"""The three queries that have SQL of their own kind against it, on the small tables."""

from __future__ import annotations

import duckdb
import pytest
from netsift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_hash_tree_shards", "op13_ranked_search"])
def test_rows_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    want = sorted(repr(tuple(r[at[c]] for c in columns)) for r in cursor.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
