"""Listings give all matches, under either name."""

import pytest

from pagelode.plans.queries import QUERIES, SQL

CAPPED = "category_members category_members_by_time all_pages all_transclusion_targets all_users blocks all_revisions recent_changes log_events".split()
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", CAPPED)
def test_all_matches(spark, name):
    import duckdb

    from pagelode.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).fetchdf()
    for own in (name, f"{name}_whole"):
        got = QUERIES[own](spark, SF).toPandas()[list(want.columns)]
        assert SQL[own] == SQL[name] and "limit" not in SQL[name]
        assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
