"""Whole wafers as numpy grids: sorted dies streamed through Arrow, some wafers at a time.

A wafer is bounded (MAX_DIM x MAX_DIM dies), so a task holds the rows of one group of wafers beyond the batch it reads,
whatever the input's size. Nothing is exploded into cells of the model grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diegrid.constants import FAIL
from diegrid.operators.dies import by_wafer

ROWS = 1 << 17                           # dies that are worked on together, about; a wafer is never cut


class Wafers:
    """Wafers of one group: ids, the place of each row's wafer in them, and the rows' columns."""

    def __init__(self, table: pa.Table):
        wafer = table.column("wafer_id").to_numpy()
        self.starts = np.flatnonzero(np.r_[True, wafer[1:] != wafer[:-1]])
        self.ids = wafer[self.starts]
        self.at = np.repeat(np.arange(len(self.ids)), np.diff(np.r_[self.starts, len(wafer)]))
        self.columns = {name: table.column(name) for name in table.column_names}
        self.r, self.c = (table.column(name).to_numpy().astype(np.int64) for name in ("r", "c"))

    def fails(self) -> np.ndarray:
        return self.columns["state"].to_pandas().eq(FAIL).to_numpy()


def per_wafer(dies: DataFrame, body: Callable[[Wafers], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`body` of groups of whole wafers; rows without wafer or place take no part. One shuffle and one sort by wafer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                rows = pa.Table.from_batches(held)
                wafer = rows.column("wafer_id").to_numpy()
                cut = int(np.searchsorted(wafer, wafer[-1]))
                if cut:
                    yield from body(Wafers(rows.slice(0, cut)))
                    held = rows.slice(cut).to_batches()
                    n -= cut
        if held:
            yield from body(Wafers(pa.Table.from_batches(held)))

    rows = dies.where("wafer_id is not null and r is not null and c is not null")
    return by_wafer(rows).sortWithinPartitions("wafer_id").mapInArrow(run, schema)


@cache
def overlaps(s: int, size: int) -> np.ndarray:
    """(s, size): overlap of each die's span with each cell's, in units of 1 / (s * size)."""
    i, j = np.arange(s)[:, None], np.arange(size)[None, :]
    return np.maximum(np.minimum((j + 1) * s, (i + 1) * size) - np.maximum(j * s, i * size), 0).astype(np.float64)


def resampled(wafers: Wafers, size: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """By side length s of the square around a wafer, some wafers at a time: their places, s, wn and fn (wafers, size, size), which are
    whole numbers, as `resample_area` has them."""
    r0, r1 = np.minimum.reduceat(wafers.r, wafers.starts), np.maximum.reduceat(wafers.r, wafers.starts)
    c0, c1 = np.minimum.reduceat(wafers.c, wafers.starts), np.maximum.reduceat(wafers.c, wafers.starts)
    h, w = r1 - r0 + 1, c1 - c0 + 1
    side = np.maximum(h, w)
    r = wafers.r - (r0 - (side - h) // 2)[wafers.at]
    c = wafers.c - (c0 - (side - w) // 2)[wafers.at]
    fail = wafers.fails()
    for s in np.unique(side).tolist():
        a, places = overlaps(s, size), np.flatnonzero(side == s)
        step = max(1, min(256, (1 << 22) // (s * s)))
        new = np.full(len(side), -1)
        for i in range(0, len(places), step):
            part = places[i:i + step]
            new[:] = -1
            new[part] = np.arange(len(part))
            mine = np.flatnonzero(new[wafers.at] >= 0)
            cell = (new[wafers.at[mine]] * s + r[mine]) * s + c[mine]
            grids = [np.bincount(x, minlength=len(part) * s * s).reshape(-1, s, s).astype(np.float64) for x in (cell, cell[fail[mine]])]
            yield part, s, *(a.T @ (g @ a) for g in grids)
