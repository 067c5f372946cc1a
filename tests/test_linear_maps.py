"""A wafer's map is put together in time linear in its cells."""

import threading

import pytest

from diegrid.operators import dies as D


def test_large_map_in_linear_time(spark):
    side = 300
    rows = spark.range(side * side).where("id % 7 <> 3").selectExpr(
        "CAST(1 AS BIGINT) AS wafer_id", f"CAST(id div {side} AS INT) AS r", f"CAST(id % {side} AS INT) AS c", "CAST(id % 2 + 1 AS INT) AS state")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)     # a scan of the map for each cell takes hours
    stop.start()
    try:
        (row,) = D.collect_die_map(rows).collect()
    finally:
        stop.cancel()
    assert row.wafer_map == [[0 if i % 7 == 3 else i % 2 + 1 for i in range(y * side, (y + 1) * side)] for y in range(side)]


def test_gaps_ends_and_null_states(spark):
    rows = spark.createDataFrame([(1, 2, 1, 2), (1, 0, 3, 1), (1, 1, 0, None), (2, 0, 0, 1)], "wafer_id bigint, r int, c int, state int")
    got = {r.wafer_id: r.wafer_map for r in D.collect_die_map(rows).collect()}
    assert got == {1: [[0, 0, 0, 1], [0, 0, 0, 0], [0, 2, 0, 0]], 2: [[1]]}


def test_two_rows_of_one_die_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 2)], "wafer_id bigint, r int, c int, state int")
    with pytest.raises(Exception, match="two rows of one die"):
        D.collect_die_map(rows).collect()


def test_wide_gaps_are_put_together_some_at_a_time(spark):
    """600 wafers of one die in a far corner: 157 million cells, never all of them in one piece."""
    rows = spark.range(600).selectExpr("concat('w', id) AS wafer_id", "511L AS r", "511 AS c", "2 AS state")
    rows = rows.union(spark.createDataFrame([(None, 1, 1, 2), ("v", 0, 0, 1), ("v", None, 0, 2)], "wafer_id string, r bigint, c int, state int"))
    got = D.collect_die_map(rows.coalesce(1)).selectExpr("wafer_id", "size(wafer_map) AS h", "size(wafer_map[0]) AS w", "wafer_map[size(wafer_map) - 1][size(wafer_map[0]) - 1] AS s").collect()
    assert sorted(map(tuple, got)) == sorted([(f"w{i}", 512, 512, 2) for i in range(600)] + [("v", 1, 1, 1)])


def test_maps_leave_python_whole(spark):
    """No list of dies is gathered and no lambda runs for each cell."""
    rows = spark.createDataFrame([(1, 0, 0, 1)], "wafer_id bigint, r int, c int, state int")
    plan = D.collect_die_map(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambdafunction" not in plan
