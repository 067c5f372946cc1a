"""Batch limits need the maps' sizes, not the maps."""

from pyspark.sql import functions as F

from diegrid.plans import catalog
from diegrid.sources import views as V

SF = "/root/testdata/sf0.001"


def test_sizes_are_those_of_the_maps(spark):
    want = V.wafers(spark, SF).select(F.col("lot_id").alias("batch"), F.size("wafer_map").alias("height"), F.size(F.get("wafer_map", F.lit(0))).alias("width"))
    assert sorted(map(tuple, V.map_sizes(spark, SF).collect())) == sorted(map(tuple, want.collect()))


def test_lineitem_is_read_once_and_no_map_is_made(spark):
    plan = catalog.QUERIES["batch_limits"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey#") and plan.count("Relation [l_orderkey") == 1 and "MapInArrow" not in plan and "collect_list" not in plan
