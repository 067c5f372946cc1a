"""Readers and streams at their edges: unknown labels, unreadable images, empty and growing streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from diegrid.sources import readers, writers
from diegrid.sources.tables import shared_path
from diegrid.streaming import flow


def test_unknown_label_is_an_error(spark):
    path = shared_path(spark, "labels")
    rows = [(1, 1, [[1, 2]], [["Donut"]]), (2, 1, [[1, 2]], [["martian"]]), (3, 1, [[1, 2]], None)]
    spark.createDataFrame(rows, readers.WAFER_SCHEMA).write.parquet(path)
    with pytest.raises(Exception, match="martian"):
        readers.read_wafers(spark, path).collect()
    lenient = {r.wafer_id: (r.label, r.cls) for r in readers.read_wafers(spark, path, strict=False).collect()}
    assert lenient == {1: ("Donut", "Donut"), 2: ("martian", None)}


def test_unreadable_images_are_kept_with_a_reason(spark, tmp_path):
    maps = spark.createDataFrame([(1, "Donut", [[1, 2, 0], [2, 1, 1]])], "wafer_id long, cls string, wafer_map array<array<tinyint>>")
    root = str(tmp_path / "images")
    writers.write_bitmaps(maps, root).count()
    (tmp_path / "images" / "Donut").mkdir(exist_ok=True)
    (tmp_path / "images" / "Donut" / "broken.png").write_bytes(b"no image at all")
    bad = readers.unreadable_images(spark, root).collect()
    assert [(r.image, r.reason) for r in bad] == [("broken.png", "not an image")]
    px = readers.image_pixels(spark, root).collect()
    assert len(px) == 6 and {r.image for r in px} == {"wafer_1.bmp"} and {(r.y, r.x) for r in px} == {(y, x) for y in (0, 1) for x in (0, 1, 2)}
    by_state = {}
    for r in px:
        by_state.setdefault([[1, 2, 0], [2, 1, 1]][r.y][r.x], set()).add((r.r, r.g, r.b))
    assert all(len(v) == 1 for v in by_state.values()) and len(by_state) == 3


EVENTS = "ts timestamp, chamber string, class string"


def test_stream_is_the_batch(spark):
    """Several micro-batches: open windows are there, updated windows count once, and nothing is there twice."""
    path, start = shared_path(spark, "events"), dt.datetime(2024, 1, 1)
    spark.createDataFrame([], EVENTS).write.parquet(path)
    stream = flow.defect_rate(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path))
    assert flow.run_to_table(stream, "rates", ["start", "end", "chamber"]).collect() == []
    rows = [(start + dt.timedelta(minutes=20 * i), "AB"[i % 2], "None" if i % 3 else "Loc") for i in range(100)]
    for i in range(4):
        spark.createDataFrame(rows[25 * i:25 * i + 25], EVENTS).coalesce(1).write.mode("append").parquet(path)
    got = flow.run_to_table(stream, "rates", ["start", "end", "chamber"])
    want = flow.defect_rate(spark.read.parquet(path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and sum(r.wafers for r in got.collect()) == 100


def test_empty_stream_of_maps(spark):
    path = shared_path(spark, "maps")
    schema = "wafer_id long, wafer_map array<array<tinyint>>"
    spark.createDataFrame([], schema).write.parquet(path)
    good, bad = flow.validate_stream(spark.readStream.schema(schema).parquet(path), "checked")
    assert good.columns == ["wafer_id", "wafer_map"] and good.count() == bad.count() == 0
    spark.createDataFrame([(1, [[1, 2]]), (2, [[7]])], schema).write.mode("append").parquet(path)
    good, bad = flow.validate_stream(spark.readStream.schema(schema).parquet(path), "checked")
    assert [r.wafer_id for r in good.collect()] == [1] and [(r.wafer_id, r.reason) for r in bad.where(F.col("reason").isNotNull()).collect()] == [(2, "bad value")]
