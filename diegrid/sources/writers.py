"""Sinks: the wafer dataset with its audit side table, and rendered bitmap folders."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from diegrid.constants import STATE_COLOURS


def write_wafers(wafers: DataFrame, path: str, audit: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Parquet partitioned by class; rows of one class are spread over several files, because one
    class may hold most wafers. `audit` makes the side table from the wafers as they are in the files: they are
    not worked out again for it, and it tells what was written."""
    wafers.write.mode("overwrite").partitionBy("cls").parquet(f"{path}/wafers")
    if audit is not None:
        audit(wafers.sparkSession.read.schema(wafers.schema).parquet(f"{path}/wafers")).write.mode("overwrite").parquet(f"{path}/audit")


def write_bitmaps(wafers: DataFrame, root: str) -> DataFrame:
    """One 24-bit bitmap per wafer (wafer_id, cls, wafer_map) in a folder per class. Tasks write
    through Arrow's file systems, so `root` may be any shared store; returns the files written."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        palette = [bytes(reversed(c)) for c in STATE_COLOURS]
        made: set[str] = set()
        for pdf in batches:
            names = []
            for wid, cls, grid in pdf[["wafer_id", "cls", "wafer_map"]].itertuples(index=False):
                h, w = len(grid), len(grid[0])
                pad = b"\0" * (-3 * w % 4)
                body = b"".join(b"".join(palette[v] for v in row) + pad for row in reversed(list(grid)))
                head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0)
                if cls not in made:
                    store.create_dir(f"{base}/{cls}", recursive=True)
                    made.add(cls)
                with store.open_output_stream(f"{base}/{cls}/wafer_{wid}.bmp") as out:
                    out.write(head + body)
                names.append(f"{cls}/wafer_{wid}.bmp")
            yield pd.DataFrame({"file": names})
    return wafers.select("wafer_id", "cls", F.col("wafer_map").cast("array<array<int>>").alias("wafer_map")).mapInPandas(run, "file string")
