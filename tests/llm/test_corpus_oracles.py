"""The corpus queries that SQL can express, and that every query is registered."""

from collections import Counter

import duckdb
import pytest

from tidemill.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())


def test_one_query_for_each_operator():
    names = registry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
