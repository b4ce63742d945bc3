"""Plan shape and the query catalog."""

import os

import pytest

from citylens.catalog import ORACLES, QUERIES
from citylens.session import shared_dir

SMALL = "/root/testdata/sf0.001"
SURVEYED = ["agg_od_matrix", "join_dwithin", "join_point_within", "geo_nearest", "agg_subtotals", "win_min_qualify", "report_response_times"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", SURVEYED)
def test_no_products_and_no_python(spark, key):
    text = plan(QUERIES[key](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["src_parquet"](spark, SMALL))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in text and "l_tax" not in text


def test_top_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk_latest"](spark, SMALL))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == shared_dir(spark) and (named is None or shared_dir(spark) == named.rstrip("/"))


@pytest.fixture(params=[True, False], ids=["broadcast", "shuffle"])
def broadcasting(spark, request):
    """Small sides broadcast, or every join shuffled as with sides too big to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        if not request.param:
            spark.conf.set(name, "-1")
    yield request.param
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("key", ["report_subway_flow", "report_injury_summary", "report_traffic_daily", "join_dwithin", "ingest_stream"])
def test_queries_match_their_sql(spark, key, broadcasting):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    found = con.execute(ORACLES[key])
    columns = [d[0] for d in found.description]
    tidy = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    want = sorted((str(tidy(r)) for r in found.fetchall()))
    got = sorted(str(tidy(r)) for r in QUERIES[key](spark, SMALL).select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
