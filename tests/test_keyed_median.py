"""Exact medians of keys of any size, against the built-in aggregate that buffers each key."""

import math

import numpy as np
from pyspark.sql import functions as F

from diegrid.functions.prefix import keyed_median


def test_keyed_median(spark):
    random = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in random.normal(size=4000)] + [("ties", float(v)) for v in random.integers(0, 3, 500)]
    rows += [("far", float(v)) for v in [*random.random(301), 1e300, -1e300]] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("same", 7.0), ("same", 7.0), ("none", None), (None, 1.0)]
    rows += [("gap", float(v)) for v in [0, 0, 0, 100, 100, 100]] + [("inf", float(v)) for v in (1, 2, math.inf)] + [("zero", -0.0), ("zero", 0.0)]
    rows += [(f"k{i}", float(v)) for i in range(300) for v in random.integers(-5, 5, 1 + i % 7)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {r["k"]: r["m"] for r in df.where("v is not null and k is not null").groupBy("k").agg(F.median("v").alias("m")).collect()}
    for buckets in (256, 4, 1):
        assert {r["k"]: r["median"] for r in keyed_median(df, ["k"], "v", buckets=buckets).collect()} == want
    assert keyed_median(df.where("false"), ["k"], "v").count() == 0


def test_keyed_median_of_integers_by_two_keys(spark):
    df = spark.range(5000).selectExpr("id % 3 as a", "id % 7 as b", "id * id % 1013 as v", "id as v_")
    want = {(r["a"], r["b"]): r["m"] for r in df.groupBy("a", "b").agg(F.median("v").alias("m")).collect()}
    assert {(r["a"], r["b"]): r["m"] for r in keyed_median(df, ["a", "b"], "v", "m").collect()} == want
