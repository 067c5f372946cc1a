"""Pixels leave the decoder in large batches, whatever the width of an image."""

import time

from pyspark.sql import functions as F

from diegrid.sources import readers, writers


def test_pixels_of_narrow_images(spark, tmp_path, monkeypatch):
    """60,000 lines of one pixel: a batch for each line took longer than reading the files."""
    tall = spark.createDataFrame([(1, "Loc", [[i % 3] for i in range(60_000)]), (2, "Loc", [[0, 1, 2], [2, 1, 0]]), (3, "Center", [[2]])], "wafer_id long, cls string, wafer_map array<array<tinyint>>")
    assert writers.write_bitmaps(tall, str(tmp_path)).count() == 3
    colours = {r["image"]: r for r in readers.image_pixels(spark, str(tmp_path)).groupBy("image").agg(
        F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y"), F.count_if(F.col("g") == 145).alias("ok"), F.count_if(F.col("g") == 231).alias("bad")).collect()}
    assert [tuple(colours[f"wafer_{i}.bmp"])[1:] for i in (1, 2, 3)] == [(60_000, 0, 59_999, 20_000, 20_000), (6, 2, 1, 2, 2), (1, 0, 0, 0, 1)]
    start = time.time()
    readers.image_pixels(spark, str(tmp_path)).count()
    assert time.time() - start < 5
    monkeypatch.setattr(readers, "PIXELS", 4)
    small = {(r["y"], r["x"]): r["g"] for r in readers.image_pixels(spark, str(tmp_path)).where("image = 'wafer_2.bmp'").collect()}
    assert small == {(0, 0): 1, (0, 1): 145, (0, 2): 231, (1, 0): 231, (1, 1): 145, (1, 2): 1}
