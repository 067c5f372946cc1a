"""Wafers that are written with an audit table are worked out once."""

from pyspark.sql import functions as F

from diegrid.sources import writers


def test_audit_comes_from_what_was_written(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    wafers = spark.range(40, numPartitions=3).selectExpr("id AS wafer_id", "concat('c', id % 3) AS cls").mapInArrow(run, "wafer_id long, cls string")
    writers.write_wafers(wafers, str(tmp_path), lambda written: written.groupBy("cls").agg(F.count("*").alias("wafers")))
    assert made.value == 40
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/audit").select("cls", "wafers").collect())) == [("c0", 14), ("c1", 13), ("c2", 13)]
    assert spark.read.parquet(f"{tmp_path}/wafers").count() == 40
