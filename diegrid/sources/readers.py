"""Scans: labelled wafers, process logs, image folders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from diegrid.functions.labels import canonical_label, nested_label

PIXELS = 1 << 17                         # that leave a task together, about

WAFER_SCHEMA = T.StructType([
    T.StructField("wafer_id", T.LongType()), T.StructField("lot_id", T.IntegerType()),
    T.StructField("wafer_map", T.ArrayType(T.ArrayType(T.ByteType()))),
    T.StructField("failureType", T.ArrayType(T.ArrayType(T.StringType()))),
])


def read_wafers(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = WAFER_SCHEMA, strict: bool = True) -> DataFrame:
    """Labelled wafers with a declared schema (no inference pass); unlabelled ones are dropped
    before the maps are touched. An unknown label is an error; if not `strict`, its class is NULL and `label` tells it."""
    raw = spark.read.schema(schema).format(fmt).load(path)
    return (raw.withColumn("label", nested_label(F.col("failureType"))).where("label IS NOT NULL")
            .withColumn("cls", canonical_label(F.col("label"), strict)).drop("failureType"))


def read_process_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Process log with a header line; pass the schema to avoid the inference pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """<Class>/<file> images, class from the folder name; only the metadata is read unless
    `content` is selected. Extensions match case-insensitively."""
    path = F.col("path")
    ext = "{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in ("jpg", "jpeg", "png", "bmp")) + "}"
    return (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", True).load(root)
            .select("path", canonical_label(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("cls"),
                    F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), "length", "content"))


def _decoded(spark: SparkSession, root: str) -> DataFrame:
    image = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")
    return image.select(F.regexp_extract("origin", r"([^/]+)$", 1).alias("image"), "origin", "width", "height", "nChannels", "data")


def unreadable_images(spark: SparkSession, root: str) -> DataFrame:
    """(image, path, reason) of files that hold no image: what `image_pixels` has no rows for."""
    bad = _decoded(spark, root).where("width <= 0 OR height <= 0 OR nChannels NOT IN (1, 3, 4)")
    return bad.select("image", F.col("origin").alias("path"), F.lit("not an image").alias("reason"))


def image_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pixels (image, y, x, r, g, b) of an image folder; unreadable files are listed by `unreadable_images`.

    An image is cut into its rows first, so what travels with a row of pixels is that row's bytes."""
    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, channels, size = (np.asarray(c) for c in (batch.column(1), batch.column(2), pc.binary_length(batch.column(3))))
            width = size // np.maximum(channels, 1)
            upto, start = np.cumsum(width), 0
            while start < len(width):                    # lines of about PIXELS pixels together, a longer one alone
                stop = max(start + 1, int(np.searchsorted(upto, upto[start] - width[start] + PIXELS, side="right")))
                for n in np.unique(channels[start:stop]).tolist():
                    mine = start + np.flatnonzero(channels[start:stop] == n)
                    data = batch.column(3).take(pa.array(mine)).buffers()[2]
                    colours = np.frombuffer(data, np.uint8, int(size[mine].sum())).reshape(-1, n).astype(np.int32)        # blue, green, red, or grey
                    b, g, r = (colours[:, k if n > 1 else 0] for k in range(3))
                    w = width[mine]
                    x = np.arange(w.sum(), dtype=np.int32) - np.repeat(np.cumsum(w) - w, w).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(mine, w))), pa.array(np.repeat(y[mine], w)), pa.array(x),
                                                      *(pa.array(np.ascontiguousarray(v)) for v in (r, g, b))], ["image", "y", "x", "r", "g", "b"])
                start = stop

    rows = (_decoded(spark, root).where("width > 0 AND height > 0 AND nChannels IN (1, 3, 4)")
            .select("*", F.explode(F.expr("sequence(0, height - 1)")).alias("y"))
            .select("image", "y", "nChannels", F.expr("substring(data, y * width * nChannels + 1, width * nChannels)").alias("row")))
    return rows.mapInArrow(pixels, "image string, y int, x int, r int, g int, b int")
