"""Connected components: of cells inside bounded grids, and of an unbounded edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from diegrid.operators.dies import STRIDE, by_wafer
from diegrid.sources.tables import ensure_checkpoint_dir

# forward half of each neighbourhood: every touching pair is found once
_FORWARD = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, -1), (1, 0), (1, 1)]}


def _label(ids: np.ndarray, connectivity: int) -> np.ndarray:
    """Index of the smallest cell of each cell's component; `ids` is ascending."""
    src, dst = [], []
    for dr, dc in _FORWARD[connectivity]:
        want = ids + dr * STRIDE + dc
        at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
        hit = np.flatnonzero(ids[at] == want)
        src.append(hit)
        dst.append(at[hit])
    a, b = np.concatenate(src), np.concatenate(dst)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]


def label_cells(cells: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """cells(keys.., r, c) -> keys.., r, c, comp, where comp is the code of the component's
    first cell in row-major order.

    One shuffle on the keys; tasks stream sorted Arrow batches and hold one grid (a bounded
    number of cells) beyond the batch. All grids of a batch are labelled together.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            new = np.r_[True, (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)]
            grid = np.cumsum(new).astype(np.int64)
            code = pdf["r"].to_numpy(np.int64) * STRIDE + pdf["c"].to_numpy(np.int64)
            root = _label(grid * (STRIDE * STRIDE) + code, connectivity)
            return pdf.assign(comp=code[root])

        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[keys].to_numpy()
            if held and (k[0] != held[-1][keys].to_numpy()[-1]).any():
                yield flush(held)
                held = []
            cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
            if len(cut):
                yield flush(held + [pdf.iloc[:cut[-1] + 1]])
                held = [pdf.iloc[cut[-1] + 1:]]
            else:
                held.append(pdf)
        if held:
            yield flush(held)

    cells = cells.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    return (by_wafer(cells, *keys).sortWithinPartitions(*keys, "r", "c")
            .mapInPandas(run, f"{fields}, comp bigint"))


def component_sizes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys, "comp").agg(
        F.count("*").alias("size"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))


def connected_nodes(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges(a, b) BIGINT of any size -> (node, root): the smallest node of each component.

    Alternating large-star / small-star (Kiveris et al., 2014): every round only rewrites the
    edge list, so a hub never becomes one group; minima are combined on the map side and the
    join back can be split by adaptive skew handling. Each round is checkpointed to the shared
    folder, so a lost executor does not replay earlier rounds.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")) if not large else \
            e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        if not large:                                  # orient towards the smaller end
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def digest(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = digest(e)
    for _ in range(max_rounds):
        e = star(star(e, large=True), large=False).checkpoint()
        after = digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root")).distinct())
