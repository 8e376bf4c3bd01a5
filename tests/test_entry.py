"""The registered queries read the given tables and agree with their SQL (a few of them here; the driver compares all)."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["io6_resolve_hashtags", "mx1_count_phrases", "ev10_slices", "ml25_psi", "ag9_score_level"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    relation = con.sql(entry.oracle_sql()[name])
    want = sorted(str([dict(zip(relation.columns, r))[c] for c in sorted(relation.columns)]) for r in relation.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
