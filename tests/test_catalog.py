"""The named queries against their SQL twins (a fast share of them; check.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal
from loamgrid.catalog.base import TABLES

SF = "/root/testdata/sf0.001"
FAST = [
    "a11_filtered_tile_bins", "f01_f02_filter_and", "f01_f03_filter_or", "a01_a05_layer_aggregates", "a08_a10_grouped_filtered", "a16_equal_breaks",
    "u02_merge_edits", "x08_x10_tiles", "g08_bounds", "j03_within_counts", "r02_heatmap", "s17_j07_raster_sampling", "t01_box_smooth", "w02_j08_flow_direction", "st2_stream_bins",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(FAST) <= set(names)


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, con, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)


def test_filter_reaches_the_scan(spark):
    from loamgrid.catalog.base import table
    from loamgrid.operators.filters import filter_rules

    df = filter_rules(table(spark, SF, "events"), [{"field": "value", "operator": ">", "value": "50"}]).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50.0)" in plan and "props" not in plan
