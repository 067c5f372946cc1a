"""Running totals, row numbers, lags and quantiles of very many keys: no cuts collected, nothing broadcast by hint."""

import pytest
from pyspark.sql import Window, functions as F

from diegrid.functions import prefix


@pytest.fixture(scope="module")
def rows(spark):
    """100,000 keys of two rows; one key with 3,000."""
    many = spark.range(200000).select((F.col("id") % 100000).alias("k"), F.col("id").alias("o"), (F.col("id") * 7919 % 1009).alias("v"))
    return many.union(spark.range(200000, 203000).select(F.lit(-1).cast("long"), F.col("id"), F.col("id") % 13))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_many_keys(spark, rows):
    key = Window.partitionBy("k")
    got = prefix.running_totals(rows, ["k"], "o", ["v"], buckets=8)
    assert same(got, rows.select("*", F.sum("v").over(key.orderBy("o")).alias("run_v"), F.sum("v").over(key).alias("all_v")))
    got = prefix.global_lag(rows, ["k"], "o", "v", "before", buckets=8)
    assert same(got.select("k", "o", "before"), rows.select("k", "o", F.lag("v").over(key.orderBy("o"))))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "hint" not in plan.lower() and "strategy=broadcast" not in plan


def test_limit_of_few_keys_changes_nothing(spark, rows, monkeypatch):
    part = rows.where("k < 40")
    few = prefix.running_totals(part, ["k"], "o", ["v"], buckets=8)
    numbers = prefix.global_row_number(part, ["k"], "v", "o", buckets=8)
    shares = prefix.exact_quantiles(part, ["k"], "v", [0.1, 0.5], buckets=8)
    monkeypatch.setattr(prefix, "FEW", 3)
    assert same(few, prefix.running_totals(part, ["k"], "o", ["v"], buckets=8))
    assert same(numbers, prefix.global_row_number(part, ["k"], "v", "o", buckets=8))
    assert same(shares, prefix.exact_quantiles(part, ["k"], "v", [0.1, 0.5], buckets=8))
