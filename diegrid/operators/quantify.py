"""Damage quantification on die tables: fail rates, profiles, clusters, pattern areas, batch pools."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from diegrid.constants import BASELINE_CLASS, FAIL, WHOLE_WAFER_CLASSES
from diegrid.functions.numeric import r6, ratio, wilson
from diegrid.operators.components import _label, component_sizes, label_cells
from diegrid.operators.dies import (BIN_EPS, STRIDE, cell_code, die_polar, die_units, fail_neighbors,
                                    morans_i, neighbour_total, resample_area, to_mm)
from diegrid.operators.grids import Wafers, per_wafer

def is_fail() -> Column:
    return F.col("state") == FAIL


def wafer_summary(dies: DataFrame) -> DataFrame:
    """Dies, fails, fail and clean share in percent, Wilson interval. One map-side combined pass."""
    g = dies.groupBy("wafer_id").agg(F.count("*").alias("dies_total"), F.count_if(is_fail()).alias("dies_failed"))
    lo, hi = wilson(F.col("dies_failed"), F.col("dies_total"))
    share = ratio(F.col("dies_failed"), F.col("dies_total"))
    return g.select("wafer_id", "dies_total", "dies_failed",
                    (F.col("dies_total") - F.col("dies_failed")).alias("dies_passed"),
                    (100 * share).alias("fail_pct"), (100 * (1 - share)).alias("clean_pct"),
                    (100 * lo).alias("wilson_lo"), (100 * hi).alias("wilson_hi"))


def _profile(polar: DataFrame, bin_: Column, n: int, name: str) -> DataFrame:
    """Conditional counts per bin in one aggregate, so empty bins need no outer join."""
    g = polar.select("wafer_id", "state", bin_.alias("bin")).groupBy("wafer_id").agg(
        *[F.count_if(F.col("bin") == i).alias(f"n{i}") for i in range(n)],
        *[F.count_if((F.col("bin") == i) & is_fail()).alias(f"f{i}") for i in range(n)])
    bins = F.array(*[F.struct(F.lit(i).alias(name), F.col(f"n{i}").alias("dies"), F.col(f"f{i}").alias("fails"))
                     for i in range(n)])
    return (g.select("wafer_id", F.inline(bins))
            .select("wafer_id", name, "dies", ratio(F.col("fails"), F.col("dies")).alias("fail_density")))


def radial_profile(dies: DataFrame) -> DataFrame:
    """Ten rings of width 0.1; the last one takes everything from 0.9 outwards."""
    ring = F.least(F.floor(F.col("radius") * 10 + BIN_EPS), F.lit(9)).cast("int")
    return _profile(die_polar(dies), ring, 10, "ring")


def angular_profile(dies: DataFrame) -> DataFrame:
    """Twelve sectors of 30 degrees."""
    sector = (F.floor(F.col("theta") / 30 + BIN_EPS) % 12).cast("int")
    return _profile(die_polar(dies), sector, 12, "sector")


def wafer_moran(dies: DataFrame) -> DataFrame:
    return morans_i(dies, "r", "c", F.when(is_fail(), 1).otherwise(0))


def fail_clusters(dies: DataFrame, connectivity: int = 8) -> DataFrame:
    """Clusters of failed dies, numbered by their first die in row-major order."""
    sizes = component_sizes(label_cells(dies.where(is_fail()), ["wafer_id"], connectivity), ["wafer_id"])
    number = F.row_number().over(Window.partitionBy("wafer_id").orderBy("comp"))
    return sizes.select("wafer_id", number.alias("cluster"), "size",
                        (F.col("sum_r") / F.col("size")).alias("row_mean"),
                        (F.col("sum_c") / F.col("size")).alias("col_mean"),
                        "r_min", "r_max", "c_min", "c_max")


def pattern_candidates(dies: DataFrame, classes: DataFrame, min_neighbors: list[int],
                       cam: DataFrame | None = None) -> DataFrame:
    """Failed dies that may belong to the pattern, per neighbour setting, with the number of
    dies and the hottest activation of their core cluster. Whole-wafer classes keep every fail.

    Returns wafer_id, min_neighbors, r, c, comp, size, hot (cluster maximum of cam or null),
    cam_max (wafer maximum or null).
    """
    n = fail_neighbors(dies).where(is_fail()).join(classes, "wafer_id").where(F.col("cls") != BASELINE_CLASS)
    n = n.select("wafer_id", "r", "c", "cls", "neighbors", F.explode(
        F.array(*[F.lit(k) for k in min_neighbors])).alias("min_neighbors"))
    keys = ["wafer_id", "min_neighbors"]
    whole = n.where(F.col("cls").isin(WHOLE_WAFER_CLASSES))
    core = label_cells(n.where(~F.col("cls").isin(WHOLE_WAFER_CLASSES) & (F.col("neighbors") >= F.col("min_neighbors"))), keys)
    if cam is not None:
        hottest = cam.groupBy("wafer_id").agg(F.max("cam").alias("cam_max"))
        core = core.join(cam, ["wafer_id", "r", "c"], "left").join(hottest, "wafer_id", "left")
    else:
        core = core.withColumn("cam", F.lit(None).cast("double")).withColumn("cam_max", F.lit(None).cast("double"))
    w = Window.partitionBy(*keys, "comp")
    core = core.select(*keys, "r", "c", "comp", F.count("*").over(w).alias("size"), F.max("cam").over(w).alias("hot"), "cam_max")
    return core.unionByName(whole.select(*keys, "r", "c", F.lit(-1).cast("long").alias("comp"),
                                         F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("hot"),
                                         F.lit(None).cast("double").alias("cam_max")))


def select_pattern(candidates: DataFrame, cam_frac: float | Column, keys: list[str], min_size: int = 3) -> DataFrame:
    """Keep clusters of at least min_size dies; with an activation map only those that touch
    cam >= cam_frac * max, unless none does. `keys` identify one segmentation."""
    frac = cam_frac if isinstance(cam_frac, Column) else F.lit(cam_frac)
    touches = F.coalesce((F.col("cam_max") > 0) & (F.col("hot") >= frac * F.col("cam_max")), F.lit(False))
    kept = candidates.where(F.col("size").isNull() | (F.col("size") >= min_size)).withColumn("focus", touches)
    any_focus = F.max("focus").over(Window.partitionBy(*keys))
    return kept.withColumn("any_focus", any_focus).where("focus OR NOT any_focus OR size IS NULL").drop("focus", "any_focus")


def segment_pattern(dies: DataFrame, classes: DataFrame, cam: DataFrame | None = None, min_neighbors: int = 2,
                    cam_frac: float = 0.5, min_size: int = 3) -> DataFrame:
    """Pattern dies (wafer_id, r, c)."""
    cand = pattern_candidates(dies, classes, [min_neighbors], cam)
    return select_pattern(cand, cam_frac, ["wafer_id", "min_neighbors"], min_size).select("wafer_id", "r", "c")


def segmentation_range(dies: DataFrame, classes: DataFrame, cam: DataFrame | None = None) -> DataFrame:
    """Fewest and most pattern dies over neighbour limits 1-3 and activation shares .3/.5/.7.

    Neighbours are counted and clusters labelled once per limit; the three shares only change which labelled
    clusters are kept. Dies and activations of a wafer meet in one group of whole wafers: neither is joined or exploded.
    """
    def body(wafers: Wafers) -> Iterator[pa.RecordBatch]:
        stride, n = STRIDE * STRIDE, len(wafers.ids)
        die, code = wafers.columns["die"].to_numpy(), wafers.at * stride + wafers.r * STRIDE + wafers.c
        fails = np.unique(code[wafers.fails() & die])
        heat = wafers.columns["cam"].to_numpy()
        hot = np.flatnonzero(~die & ~np.isnan(heat))
        hot = hot[np.argsort(code[hot], kind="stable")]
        top = np.full(n, -np.inf)
        np.maximum.at(top, wafers.at[hot], heat[hot])

        def found(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            return at, (keys[at] == want if len(keys) else np.zeros(len(want), bool))

        near = sum((found(fails, fails + dr * STRIDE + dc)[1].astype(np.int64) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc), np.zeros(len(fails), np.int64))
        at, has = found(code[hot], fails)
        cam_of = np.full(len(fails), -np.inf)
        cam_of[has] = heat[hot][at[has]]
        counts = []
        for limit in (1, 2, 3):
            core = np.flatnonzero(near >= limit)
            root = _label(fails[core], 8) if len(core) else core
            size, warm = np.bincount(root, minlength=len(core)), np.full(len(core), -np.inf)
            np.maximum.at(warm, root, cam_of[core])
            comp = np.flatnonzero(size >= 3)
            size, warm, owner = size[comp], warm[comp], fails[core][comp] // stride
            for share in (0.3, 0.5, 0.7):
                focus = (top[owner] > 0) & (warm >= share * top[owner])
                kept = focus | (np.bincount(owner[focus], minlength=n) == 0)[owner]
                counts.append(np.bincount(owner[kept], size[kept], n).astype(np.int64))
        there = np.bincount(wafers.at[die], minlength=n) > 0
        out = [wafers.ids, np.bincount(fails // stride, minlength=n).astype(np.int64), np.min(counts, axis=0), np.max(counts, axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(v[there]) for v in out], ["wafer_id", "fails", "lo", "hi"])

    place = [F.col("wafer_id").cast("long").alias("wafer_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")]
    rows = dies.select(*place, F.col("state").cast("int").alias("state"), F.lit(None).cast("double").alias("cam"), F.lit(True).alias("die"))
    if cam is not None:
        rows = rows.union(cam.select(*place, F.lit(None).cast("int"), F.when(F.isnan("cam"), float("inf")).otherwise(F.col("cam").cast("double")), F.lit(False)))     # NaN is the largest value
    ranges = per_wafer(rows, body, "wafer_id long, fails long, lo long, hi long").join(classes, "wafer_id", "left")
    cls = F.col("cls")

    def of_class(name: str) -> Column:
        return F.when(cls.isNull() | (cls == BASELINE_CLASS), F.lit(0)).when(cls.isin(WHOLE_WAFER_CLASSES), F.col("fails")).otherwise(F.col(name)).cast("long")

    return ranges.select("wafer_id", of_class("lo").alias("dies_min"), of_class("hi").alias("dies_max"))


def segmentation_area(dies: DataFrame, ranges: DataFrame, **geometry) -> DataFrame:
    """The range of `segmentation_range` in percent of the dies and in mm^2: adds pct_min, pct_max, mm2_min, mm2_max."""
    units = die_units(dies, **geometry).select("wafer_id", (F.col("die_w_mm") * F.col("die_h_mm")).alias("die"))
    held = ranges.join(dies.groupBy("wafer_id").agg(F.count("*").alias("n")), "wafer_id").join(units, "wafer_id")
    return held.select(*ranges.columns, *[(100 * F.col(f"dies_{m}") / F.col("n")).alias(f"pct_{m}") for m in ("min", "max")],
                       *[(F.col(f"dies_{m}") * F.col("die")).alias(f"mm2_{m}") for m in ("min", "max")])


def pattern_area(dies: DataFrame, pattern: DataFrame, **geometry) -> DataFrame:
    p = pattern.groupBy("wafer_id").agg(F.count("*").alias("p"))
    g = (dies.groupBy("wafer_id").agg(F.count("*").alias("n"), F.count_if(is_fail()).alias("f"))
         .join(die_units(dies, **geometry), "wafer_id").join(p, "wafer_id", "left"))
    k = F.coalesce("p", F.lit(0))
    lo, hi = wilson(k, F.col("n"))
    pct = 100 * ratio(k, F.col("n"))
    return g.select("wafer_id", k.alias("dies"), pct.alias("affected_pct"), (100 - pct).alias("clean_pct"),
                    (100 * lo).alias("wilson_lo"), (100 * hi).alias("wilson_hi"),
                    (k * F.col("die_w_mm") * F.col("die_h_mm")).alias("area_mm2"),
                    (F.col("f") - k).alias("background_fail_dies"))


def pattern_centroid(dies: DataFrame, pattern: DataFrame, **geometry) -> DataFrame:
    g = (pattern.groupBy("wafer_id").agg((F.sum("r") / F.count("*")).alias("row_mean"), (F.sum("c") / F.count("*")).alias("col_mean"))
         .join(die_units(dies, **geometry), "wafer_id"))
    r, c = F.col("row_mean"), F.col("col_mean")
    dy, dx = F.col("cy") - r, c - F.col("cx")
    x, y = to_mm(r, c)
    angle = (F.degrees(F.atan2(r6(dy), r6(dx))) + 360) % 360
    return g.select("wafer_id", "row_mean", "col_mean", x.alias("x_mm"), y.alias("y_mm"),
                    (F.sqrt(dx * dx + dy * dy) / F.col("radius_dies")).alias("radius_norm"), angle.alias("angle_deg"))


def labelled_regions(pattern: DataFrame) -> DataFrame:
    """Pattern dies with the region they belong to."""
    return label_cells(pattern, ["wafer_id"])


def pattern_regions(dies: DataFrame, pattern: DataFrame, **geometry) -> DataFrame:
    """All regions of each wafer's pattern, numbered from the largest."""
    w = Window.partitionBy("wafer_id").orderBy(F.desc("size"), "comp")
    g = (component_sizes(labelled_regions(pattern), ["wafer_id"])
         .withColumn("region", F.row_number().over(w))
         .join(die_units(dies, **geometry), "wafer_id"))
    r, c = F.col("sum_r") / F.col("size"), F.col("sum_c") / F.col("size")
    x, y = to_mm(r, c)
    return g.select("wafer_id", "region", F.col("size").alias("dies"), "comp",
                    (F.col("size") * F.col("die_w_mm") * F.col("die_h_mm")).alias("area_mm2"),
                    r.alias("row_mean"), c.alias("col_mean"), x.alias("x_mm"), y.alias("y_mm"))


def _simplify(ring: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, split at its two farthest-apart anchors."""
    if len(ring) < 5:
        return ring
    far = int(((ring - ring[0]) ** 2).sum(1).argmax())
    keep = {0, far}
    work = [(0, far), (far, len(ring))]
    closed = np.vstack([ring, ring[:1]])
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        p, q, mid = closed[a], closed[b], closed[a + 1:b]
        d, m = q - p, mid - p
        dist = np.abs(d[0] * m[:, 1] - d[1] * m[:, 0]) / max(math.hypot(*d), 1e-12)
        k = int(dist.argmax())
        if dist[k] > tol:
            keep.add(a + 1 + k)
            work += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[sorted(keep)]


# unit steps of the four side directions, the die on the right hand: north, east, south, west side
_SIDE_START = np.array([(0, 0), (0, 1), (1, 1), (1, 0)])
_SIDE_STEP = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def _outer_ring(sides: np.ndarray) -> np.ndarray:
    """Corners of the ring that starts at the region's first die. Sides are (cell code * 4 +
    direction); at a corner shared by two diagonal dies the left turn keeps them together."""
    cell, way = sides // 4, sides % 4
    begin = np.c_[cell // STRIDE, cell % STRIDE] + _SIDE_START[way]
    leaving: dict[tuple[int, int], list[int]] = {}
    for (y, x), d in zip(begin.tolist(), way.tolist()):
        leaving.setdefault((y, x), []).append(d)
    first = int(np.lexsort((way, cell))[0])
    here = start = tuple(begin[first].tolist())
    d, corners = int(way[first]), []
    while True:
        options = leaving[here]
        turn = (d + 3) % 4 if len(options) > 1 and (d + 3) % 4 in options else options[0]
        options.remove(turn)
        if turn != d or not corners:
            corners.append(here)
        d, here = turn, (here[0] + _SIDE_STEP[turn][0], here[1] + _SIDE_STEP[turn][1])
        if here == start:
            return np.array(corners, float)


def region_polygons(dies: DataFrame, pattern: DataFrame, tolerance: float = 0.5, **geometry) -> DataFrame:
    """Outline of every region with vertices on die corners, simplified within
    `tolerance` dies. Boundary sides come from RANGE frames; only the ordering of one bounded
    region's sides into a ring runs in Python, on Arrow batches of regions."""
    w = Window.partitionBy("wafer_id", "comp").orderBy("code")

    def bare(offset: int) -> Column:
        return F.coalesce(F.count("*").over(w.rangeBetween(offset, offset)), F.lit(0)) == 0

    regions = pattern_regions(dies, pattern, **geometry).select("wafer_id", "region", "comp")
    sides = (labelled_regions(pattern).withColumn("code", cell_code().cast("long"))
             .select("wafer_id", "comp", "code", F.array(bare(-STRIDE), bare(1), bare(STRIDE), bare(-1)).alias("open"))
             .select("wafer_id", "comp", "code", F.posexplode("open").alias("way", "is_open")).where("is_open")
             .groupBy("wafer_id", "comp").agg(F.collect_list(F.col("code") * 4 + F.col("way")).alias("sides"))
             .join(regions, ["wafer_id", "comp"]))

    @F.pandas_udf("array<array<double>>")
    def ring(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: (_simplify(_outer_ring(np.asarray(s)), tolerance) - 0.5).tolist())

    x, y = to_mm(F.col("row"), F.col("col"))
    return (sides.select("wafer_id", "region", F.posexplode(ring("sides")).alias("vertex", "p"))
            .select("wafer_id", "region", "vertex", F.col("p")[0].alias("row"), F.col("p")[1].alias("col"))
            .join(die_units(dies, **geometry), "wafer_id")
            .select("wafer_id", "region", "vertex", "row", "col", x.alias("x_mm"), y.alias("y_mm")))


def clustering_stats(dies: DataFrame) -> DataFrame:
    """Clusters of three or more, largest cluster, clustered share, Moran's I, mean failing neighbours."""
    sizes = component_sizes(label_cells(dies.where(is_fail()), ["wafer_id"]), ["wafer_id"])
    per = sizes.groupBy("wafer_id").agg(
        F.count_if(F.col("size") >= 3).alias("clusters_ge3"), F.max("size").alias("largest"),
        F.sum(F.when(F.col("size") >= 3, F.col("size")).otherwise(F.lit(0))).alias("clustered"), F.sum("size").alias("fails"))
    near = fail_neighbors(dies).groupBy("wafer_id").agg(
        F.sum(F.when(is_fail(), F.col("neighbors"))).alias("near"), F.count_if(is_fail()).alias("f"))
    return (wafer_moran(dies).join(near, "wafer_id").join(per, "wafer_id", "left").select(
        "wafer_id", F.col("moran_i").alias("morans_i"), F.coalesce("clusters_ge3", F.lit(0)).alias("clusters_ge3"),
        F.coalesce("largest", F.lit(0)).alias("largest_cluster_dies"),
        ratio(F.col("clustered"), F.col("fails")).alias("clustered_fail_frac"),
        ratio(F.col("near"), F.col("f")).alias("mean_fail_neighbors")))


def gaussian_taps(sigma: float = 1.5) -> list[float]:
    """Normalised kernel; radius 4 sigma, as image libraries choose it for float input."""
    n = int(round(sigma * 8 + 1)) | 1
    g = np.exp(-(np.arange(n) - n // 2) ** 2 / (2 * sigma * sigma))
    return [float(v) for v in g / g.sum()]


@cache
def _blur(n: int, sigma: float) -> np.ndarray:
    """(n, n): what each cell of a line adds to each one, reflected at both ends without repeating them."""
    taps = gaussian_taps(sigma)
    half, out, dst = len(taps) // 2, np.zeros((n, n)), np.arange(n)
    for k, tap in enumerate(taps):
        at = (dst + k - half) % max(1, 2 * (n - 1))
        np.add.at(out, (np.where(at < n, at, 2 * (n - 1) - at), dst), tap)
    return out


def density_heatmap(dies: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Gaussian blur of the fail mask over the bounding grid (reflected at its border without
    repeating the edge), kept on the wafer and scaled to the wafer's maximum.

    A blur is two matrix products for all wafers of one grid size that a task holds together.
    """
    def body(wafers: Wafers) -> Iterator[pa.RecordBatch]:
        h, w = np.maximum.reduceat(wafers.r, wafers.starts) + 1, np.maximum.reduceat(wafers.c, wafers.starts) + 1
        fail, value = wafers.fails(), np.zeros(len(wafers.r))
        shape, of = np.unique(np.stack([h, w], axis=1), axis=0, return_inverse=True)
        of = of.ravel()[wafers.at]
        order = np.argsort(of, kind="stable")
        for rows, (height, width) in zip(np.split(order, np.flatnonzero(np.diff(of[order])) + 1), shape.tolist()):
            ids, at = np.unique(wafers.at[rows], return_inverse=True)
            cell = (at.ravel() * height + wafers.r[rows]) * width + wafers.c[rows]
            mask = np.bincount(cell[fail[rows]], minlength=len(ids) * height * width).reshape(-1, height, width).astype(np.float64)
            value[rows] = (_blur(height, sigma).T @ (mask @ _blur(width, sigma))).ravel()[cell]
        peak = np.maximum.reduceat(value, wafers.starts)[wafers.at]
        table = pa.table([*(wafers.columns[n] for n in ("wafer_id", "r", "c")), pa.array(value / (peak + 1e-9))], ["wafer_id", "r", "c", "heat"])
        yield from table.to_batches(max_chunksize=10_000)

    return per_wafer(dies.select(F.col("wafer_id").cast("long").alias("wafer_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "state"),
                     body, "wafer_id long, r int, c int, heat double")


def failed_die_list(dies: DataFrame, pattern: DataFrame, affected: DataFrame | None = None,
                    **geometry) -> DataFrame:
    """All failed dies of each wafer, ranked in row-major order."""
    w = Window.partitionBy("wafer_id")
    x, y = to_mm(F.col("r"), F.col("c"))
    f = (dies.where(is_fail())
         .withColumn("rank", F.row_number().over(w.orderBy("r", "c")))
         .join(die_units(dies, **geometry), "wafer_id")
         .join(pattern.select("wafer_id", "r", "c", F.lit(True).alias("hit")), ["wafer_id", "r", "c"], "left"))
    if affected is not None:
        f = f.join(affected, ["wafer_id", "r", "c"], "left")
    extra = [(100 * F.col("affected")).alias("affected_pct")] if affected is not None else []
    return f.select("wafer_id", "r", "c", x.alias("x_mm"), y.alias("y_mm"),
                    F.coalesce("hit", F.lit(False)).alias("in_pattern"), "rank", *extra)


def batch_pool(dies: DataFrame, pattern: DataFrame, batches: DataFrame) -> DataFrame:
    """Pooled counts and rates per batch (wafers -> batch in `batches`)."""
    per = (dies.groupBy("wafer_id").agg(F.count("*").alias("n"), F.count_if(is_fail()).alias("f"))
           .join(pattern.groupBy("wafer_id").agg(F.count("*").alias("p")), "wafer_id", "left").join(batches, "wafer_id"))
    g = per.groupBy("batch").agg(F.count("*").alias("wafers"), F.sum("n").alias("dies_total"), F.sum("f").alias("dies_failed"),
                                 F.sum(F.coalesce("p", F.lit(0))).alias("pattern_dies"))
    lo, hi = wilson(F.col("dies_failed"), F.col("dies_total"))
    return g.select("batch", "wafers", "dies_total", "dies_failed",
                    (100 * ratio(F.col("dies_failed"), F.col("dies_total"))).alias("fail_pct"),
                    (100 * lo).alias("wilson_lo"), (100 * hi).alias("wilson_hi"),
                    (100 * ratio(F.col("pattern_dies"), F.col("dies_total"))).alias("pattern_pct"))


def batch_class_counts(classes: DataFrame, batches: DataFrame) -> DataFrame:
    return classes.join(batches, "wafer_id").groupBy("batch", "cls").agg(F.count("*").alias("wafers"))


def batch_mean_ci(dies: DataFrame, batches: DataFrame) -> DataFrame:
    """Mean wafer fail percentage with a normal 95 % interval; width 0 for one wafer."""
    g = wafer_summary(dies).join(batches, "wafer_id").groupBy("batch").agg(
        F.count("*").alias("wafers"), F.avg("fail_pct").alias("mean"), F.stddev_samp("fail_pct").alias("sd"))
    half = F.when(F.col("wafers") > 1, 1.96 * F.col("sd") / F.sqrt("wafers")).otherwise(F.lit(0.0))
    return g.select("batch", "wafers", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def batch_heatmap(dies: DataFrame, size: int = 64) -> DataFrame:
    """Mean fail share on the model grid over all wafers, every grid cell present."""
    heat = resample_area(dies, size).groupBy("y", "x").agg(F.sum(F.col("fn") / F.col("s2")).alias("total"))
    n = dies.agg(F.count_distinct("wafer_id")).scalar()
    grid = dies.sparkSession.range(size * size).select(F.expr(f"CAST(id DIV {size} AS INT)").alias("y"), F.expr(f"CAST(id % {size} AS INT)").alias("x"))
    return (grid.join(heat, ["y", "x"], "left")
            .select("y", "x", (F.coalesce("total", F.lit(0.0)) / n).alias("heat")))


def batch_radial(dies: DataFrame) -> DataFrame:
    """Unweighted mean of the wafers' ring densities."""
    return radial_profile(dies).groupBy("ring").agg(F.avg("fail_density").alias("fail_density"))


def severity_band(cls: Column, affected_pct: Column) -> Column:
    return (F.when(cls == BASELINE_CLASS, "NONE").when(affected_pct < 2, "LOW")
            .when(affected_pct <= 10, "MEDIUM").otherwise("HIGH"))
