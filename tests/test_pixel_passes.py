"""Pixels are read once for each use, and joined or grouped without a shuffle of their own."""

from pyspark.sql import functions as F

from diegrid.operators import pixels as X


def test_no_pixel_is_read_to_build_the_lookup(spark):
    bad = spark.range(1).select(F.col("id").alias("image"), *[F.raise_error("read").cast("int").alias(n) for n in ("y", "x", "r", "g", "b")])
    X.with_position(bad)                     # ran a job over all pixels before


def test_states_add_no_shuffle_of_pixels(spark):
    px = spark.range(2000).repartition(8, "id").selectExpr("id AS image", "0 AS y", "0 AS x", "68 AS r", "1 AS g", "84 AS b")
    plan = X.pixel_states(X.with_position(px))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan      # the input's own, for each side of the join


def test_lines_are_in_order_of_x(spark):
    rows = spark.createDataFrame([(7, 1, 2, 0), (7, 0, 1, 2), (7, 1, 0, 1), (7, 0, 0, 0)], "image bigint, y int, x int, state int")
    assert sorted(map(tuple, X.state_lines(rows).collect())) == [(7, 0, "02"), (7, 1, "10")]
