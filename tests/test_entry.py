import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["by_region", "timeseries_week", "adapter_orders", "synthetic_ids", "text_uniqueness", "bm25_topk", "hybrid_search", "qrels_metrics", "risk_ladder", "metrics_grouping_sets"])
def test_queries_match_their_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)
