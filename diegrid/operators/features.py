"""35 morphology features per wafer on the resampled grid.

Input is cells(wafer_id, y, x, wn, fn, s2) of resample_area. A cell is on the wafer when its
on-wafer share exceeds one half. Densities are ratios of exact integer sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from diegrid.constants import FEATURES, INPUT_SIZE
from diegrid.functions.numeric import ratio
from diegrid.operators.components import _label, label_cells
from diegrid.operators.dies import BIN_EPS, STRIDE, morans_i
from diegrid.operators.grids import Wafers, per_wafer, resampled
from diegrid.sources.tables import ensure_checkpoint_dir

PI = 3.141592653589793
ANGLES, EDGE_RINGS = 64, (12, 16)        # angles of the edge profile; its rings, of 16 up to the inscribed circle


def on_cells(cells: DataFrame, size: int = INPUT_SIZE) -> DataFrame:
    """On-wafer cells with radius (1 = inscribed circle) and angle of the cell centre."""
    dx, dy = F.col("x") - (size - 1) / 2, F.col("y") - (size - 1) / 2
    return cells.where("2 * wn > s2").select(
        "wafer_id", "y", "x", "fn", "s2",
        (F.sqrt(dx * dx + dy * dy) / (size / 2)).alias("r"), F.atan2(dy, dx).alias("th"))


@cache
def zone_masks(size: int = INPUT_SIZE) -> dict[str, np.ndarray]:
    """Which cells belong to each radial zone, region and edge bin."""
    y, x = np.divmod(np.arange(size * size), size)
    dy, dx = y - (size - 1) / 2, x - (size - 1) / 2
    r, th = np.sqrt(dx * dx + dy * dy) / (size / 2), np.arctan2(dy, dx)
    sector = {n: np.floor((th + PI) / (2 * PI / n) + BIN_EPS).astype(int) % n for n in (4, 8)}
    zones = {f"radial_{i}": (r >= i / 8) & (r < (i + 1) / 8) for i in range(8)}
    zones |= {"inner": r < 0.3, "not_inner": r >= 0.3, "mid": (r >= 0.3) & (r < 0.75), "outer": r >= 0.8, "not_outer": r < 0.8,
              "region_center": r < 1 / 3}
    zones |= {f"mid_{k}": (r >= 1 / 3) & (r < 2 / 3) & (sector[4] == k) for k in range(4)}
    zones |= {f"out_{k}": (r >= 2 / 3) & (sector[8] == k) for k in range(8)}
    ring = np.floor(r * EDGE_RINGS[1] + BIN_EPS).astype(int)
    angle = np.minimum(np.floor((th + PI) / (2 * PI) * ANGLES + BIN_EPS), ANGLES - 1).astype(int)
    return zones | {f"edge_{i}_{t}": (r < 1) & (ring == i) & (angle == t) for i in range(*EDGE_RINGS) for t in range(ANGLES)}


SUMS = ["wafer_id", "s2", "area", "fails", "f", "n", "radon_peak"]


def _sums(fails: np.ndarray, held: np.ndarray, s2: np.ndarray, zones: np.ndarray, turned: np.ndarray) -> list[pa.Array]:
    """area, fails, f, n and radon_peak of (wafers, cells) fail shares and cells on the wafer."""
    sums = (fails / s2[:, None] @ turned).reshape(len(fails), -1, math.isqrt(fails.shape[1]))
    peak = (sums.max(axis=2) / (sums.sum(axis=2) / sums.shape[2] + 1e-6)).max(axis=1)
    counts = [pa.array(list((m @ zones).astype(np.int64)), pa.list_(pa.int64())) for m in (fails, held)]       # whole numbers below 2^53
    return [*[pa.array(m.sum(axis=1).astype(np.int64)) for m in (held, fails)], *counts, pa.array(peak)]


def _moran(v: np.ndarray, on: np.ndarray, unit: int, min_sd: float) -> np.ndarray:
    """`morans_i` of (wafers, y, x) whole numbers on the cells `on`."""
    n, total = on.sum(axis=(1, 2)).astype(np.float64), (v * on).sum(axis=(1, 2))
    z = (v * n[:, None, None] - total[:, None, None]) * on
    zz = (z * z).sum(axis=(1, 2))
    pairs = (z[:, :, :-1] * z[:, :, 1:]).sum(axis=(1, 2)) + (z[:, :-1] * z[:, 1:]).sum(axis=(1, 2))
    links = (on[:, :, :-1] & on[:, :, 1:]).sum(axis=(1, 2)) + (on[:, :-1] & on[:, 1:]).sum(axis=(1, 2))
    ok = (n >= 10) & (zz > 0) & (links > 0) & (np.sqrt(zz / np.maximum(n, 1)) / np.maximum(n, 1) / unit >= min_sd)
    return np.where(ok, n * pairs / np.where(ok, links * zz, 1), 0.0)


OUTLINE = "struct<comp: bigint, r: int, k: bigint, lo: int, hi: int, sc: bigint, scc: bigint>"


def _outline(bad: np.ndarray) -> pa.Array:
    """`outlines` of (wafers, y, x) failing cells, one list for each wafer."""
    wafer, y, x = np.nonzero(bad)
    fields, ints = ["comp", "r", "k", "lo", "hi", "sc", "scc"], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    if not len(wafer):
        return pa.array([[]] * len(bad), pa.list_(pa.struct(list(zip(fields, ints)))))
    root = _label(wafer * (STRIDE * STRIDE) + y * STRIDE + x, 8)
    order = np.lexsort((x, y, root))
    root, y, x = root[order], y[order], x[order]
    first = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (y[1:] != y[:-1])])
    last = np.r_[first[1:], len(x)] - 1
    at = np.arange(len(bad) + 1)
    head = np.nonzero(bad)
    comp = head[1][root[first]] * STRIDE + head[2][root[first]]
    values = [comp, y[first], np.diff(np.r_[first, len(x)]), x[first], x[last], np.add.reduceat(x, first), np.add.reduceat(x * x, first)]
    rows = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, ints)], fields)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(wafer[root[first]], at).astype(np.int32)), rows)


def wafer_grids(dies: DataFrame, size: int = INPUT_SIZE) -> DataFrame:
    """dies(wafer_id, r, c, state) -> the columns of `grid_sums`, with moran_i and the outlines of clusters, one row per wafer.

    All that features need of the resampled grid is worked out where it is made: no cell is a row."""
    def body(wafers: Wafers) -> Iterator[pa.RecordBatch]:
        zones, turned = np.stack(list(zone_masks(size).values()), axis=1).astype(np.float64), rotation_operator(size)
        for part, s, wn, fn in resampled(wafers, size):
            some = np.flatnonzero((2 * wn > s * s).any(axis=(1, 2)))
            if len(some):
                on, fn, s2 = 2 * wn[some] > s * s, fn[some], np.full(len(some), s * s)
                sums = _sums((fn * on).reshape(len(some), -1), on.reshape(len(some), -1).astype(np.float64), s2, zones, turned)
                yield pa.RecordBatch.from_arrays([pa.array(wafers.ids[part[some]]), pa.array(s2), *sums, pa.array(_moran(fn, on, s * s, 1e-6)), _outline(on & (2 * fn > s * s))],
                                                 [*SUMS, "moran_i", "outline"])

    return per_wafer(dies.select("wafer_id", "r", "c", "state"), body,
                     f"wafer_id long, s2 long, area long, fails long, f array<long>, n array<long>, radon_peak double, moran_i double, outline array<{OUTLINE}>")


def grid_sums(on: DataFrame, size: int = INPUT_SIZE) -> DataFrame:
    """wafer_id, s2, area, fails, f and n (sum of fn and number of cells per zone, exact), radon_peak.

    A wafer is one row of at most size^2 cells. Everything that is linear in its grid is one matrix product for
    a batch of wafers: sums over zones, and column sums of all rotations."""
    rows = on.groupBy("wafer_id").agg(F.max("s2").cast("long").alias("s2"), F.collect_list(F.struct((F.col("y") * size + F.col("x")).cast("int").alias("at"), F.col("fn").cast("long").alias("fn"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zones, turned = np.stack(list(zone_masks(size).values()), axis=1).astype(np.float64), rotation_operator(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                flat, n = part.column(2).flatten(), part.num_rows
                at = np.repeat(np.arange(n), part.column(2).value_lengths().to_numpy()) * size * size + flat.field("at").to_numpy()
                fails, held = np.zeros(n * size * size), np.zeros(n * size * size)
                fails[at], held[at] = flat.field("fn").to_numpy(), 1
                columns = _sums(fails.reshape(n, -1), held.reshape(n, -1), part.column(1).to_numpy(), zones, turned)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], SUMS)

    return rows.mapInArrow(run, "wafer_id long, s2 long, area long, fails long, f array<long>, n array<long>, radon_peak double")


def _zone(name: str) -> tuple[Column, Column]:
    i = list(zone_masks()).index(name)
    return F.col("f")[i], F.col("n")[i]


def density_features(sums: DataFrame) -> DataFrame:
    """Overall and radial densities, contrasts and the 13 regions; sectors are sorted within each ring, which
    makes them rotation invariant."""
    def dens(name: str) -> Column:
        f, n = _zone(name)
        return ratio(f, F.col("s2") * n)

    mids = F.sort_array(F.array(*[dens(f"mid_{k}") for k in range(4)]))
    outs = F.sort_array(F.array(*[dens(f"out_{k}") for k in range(8)]))
    return sums.select(
        "wafer_id", "area", ratio(F.col("fails"), F.col("s2") * F.col("area")).alias("fail_frac"),
        *[dens(f"radial_{i}").alias(f"radial_{i}") for i in range(8)],
        (dens("inner") - dens("not_inner")).alias("center_contrast"),
        (dens("mid") - F.greatest(dens("inner"), dens("outer"))).alias("donut_contrast"),
        (dens("outer") - dens("not_outer")).alias("edge_contrast"),
        dens("region_center").alias("region_center"),
        *[mids[k].alias(f"region_mid_{k}") for k in range(4)], *[outs[k].alias(f"region_out_{k}") for k in range(8)])


def polar_bins(on: DataFrame, n_r: int = 16, n_theta: int = 64) -> DataFrame:
    """Sums and counts per non-empty (radius, angle) bin inside the inscribed circle."""
    return (on.where("r < 1").groupBy(
        "wafer_id", F.floor(F.col("r") * n_r + BIN_EPS).cast("int").alias("ri"),
        F.least(F.floor((F.col("th") + PI) / (2 * PI) * n_theta + BIN_EPS), F.lit(n_theta - 1)).cast("int").alias("ti"))
        .agg((F.sum("fn") / (F.max("s2") * F.count("*"))).alias("density")))


def polar_density(on: DataFrame, n_r: int = 16, n_theta: int = 64) -> DataFrame:
    """Every bin of the polar grid, empty ones 0."""
    g = polar_bins(on, n_r, n_theta).groupBy("wafer_id").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("ri") * n_theta + F.col("ti"), F.col("density")))).alias("m"))
    return (g.select("wafer_id", "m", F.explode(F.sequence(F.lit(0), F.lit(n_r * n_theta - 1))).alias("bin"))
            .select("wafer_id", F.floor(F.col("bin") / n_theta).cast("int").alias("ri"), (F.col("bin") % n_theta).alias("ti"),
                    F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0.0)).alias("density")))


def edge_features(sums: DataFrame) -> DataFrame:
    """Share of edge angles above max(.3, 2 * fail share) and the worst 8-wide circular mean.

    The edge profile of one wafer is a fixed array of 64 values, so the circular mean is an
    array expression rather than a window over duplicated angles.
    """
    names, rings = list(zone_masks()), EDGE_RINGS[1] - EDGE_RINGS[0]
    first = names.index(f"edge_{EDGE_RINGS[0]}_0")

    def at_angle(t: Column) -> Column:
        total = F.lit(0.0)
        for i in range(rings):
            at = t + (first + i * ANGLES)
            total = total + ratio(F.get("f", at), F.col("s2") * F.get("n", at))
        return total / rings

    edge = sums.select("wafer_id", ratio(F.col("fails"), F.col("s2") * F.col("area")).alias("ff"), F.transform(F.sequence(F.lit(0), F.lit(ANGLES - 1)), at_angle).alias("edge"))
    return edge.select("wafer_id",
                       F.expr(f"size(filter(edge, e -> e > greatest(0.3D, 2 * ff))) / {ANGLES}D").alias("edge_coverage"),
                       F.expr(f"array_max(transform(sequence(0, {ANGLES - 1}), i -> aggregate(sequence(0, 7), 0D, "
                              f"(a, j) -> a + edge[(i + j) % {ANGLES}]) / 8))").alias("edge_max_sector"))


def outlines(cells: DataFrame) -> DataFrame:
    """Clusters of failing cells by row: (wafer_id, comp, r, k, lo, hi, sc, scc). All cluster features come from it."""
    bad = cells.where("2 * wn > s2 AND 2 * fn > s2").select("wafer_id", F.col("y").alias("r"), F.col("x").alias("c"))
    c = F.col("c").cast("long")
    return label_cells(bad, ["wafer_id"]).groupBy("wafer_id", "comp", "r").agg(
        F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum(c).alias("sc"), F.sum(c * c).alias("scc"))


def cluster_table(outline: DataFrame) -> DataFrame:
    """Clusters of failing cells with their exact moments."""
    r = F.col("r").cast("long")
    return outline.groupBy("wafer_id", "comp").agg(
        F.sum("k").alias("n"), F.sum(r * F.col("k")).alias("sr"), F.sum("sc").alias("sc"),
        F.sum(r * r * F.col("k")).alias("srr"), F.sum("scc").alias("scc"), F.sum(r * F.col("sc")).alias("src"))


def cluster_features(sums: DataFrame, clusters: DataFrame) -> DataFrame:
    """Share of failing cells in large clusters, and how many large clusters there are."""
    area = sums.select("wafer_id", "area")
    big = F.col("n") >= F.greatest(F.lit(8.0), 0.004 * F.col("area"))
    return (area.join(clusters, "wafer_id", "left").groupBy("wafer_id").agg(
        F.sum(F.when(big, F.col("n")).otherwise(F.lit(0))).alias("clustered"), F.sum("n").alias("fails"),
        F.count_if(big).cast("double").alias("n_clusters"))
        .select("wafer_id", F.coalesce(ratio(F.col("clustered"), F.col("fails")), F.lit(0.0)).alias("clustered_frac"), "n_clusters"))


def largest_cluster(clusters: DataFrame) -> DataFrame:
    """The largest cluster of each wafer, the first one on ties."""
    return clusters.groupBy("wafer_id").agg(F.max_by(
        F.struct("comp", "n", "sr", "sc", "srr", "scc", "src"), F.struct(F.col("n"), -F.col("comp"))).alias("k")).select("wafer_id", "k.*")


def salient_features(sums: DataFrame, clusters: DataFrame, size: int = INPUT_SIZE) -> DataFrame:
    """Area share, distance from the centre and elongation of the largest cluster; the
    eigenvalues of the 2 x 2 sample covariance are closed-form."""
    area = sums.select("wafer_id", "area")
    n, m = F.col("n"), (size - 1) / 2

    def cov(sab: str, sa: str, sb: str) -> Column:
        return F.try_divide((n * F.col(sab) - F.col(sa) * F.col(sb)).cast("double"), (n * (n - 1)).cast("double"))

    a, b, d = cov("srr", "sr", "sr"), cov("src", "sr", "sc"), cov("scc", "sc", "sc")
    mid, gap = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + b * b)
    dy, dx = F.col("sr") / n - m, F.col("sc") / n - m
    return (area.join(largest_cluster(clusters), "wafer_id", "left").select(
        "wafer_id", F.coalesce(n / F.col("area"), F.lit(0.0)).alias("salient_area"),
        F.coalesce(F.sqrt(dx * dx + dy * dy) / (size / 2), F.lit(0.0)).alias("salient_r"),
        F.coalesce(F.when(n >= 3, F.sqrt((mid + gap + 1e-3) / (mid - gap + 1e-3))), F.lit(1.0)).alias("salient_elong")))


@F.pandas_udf(T.DoubleType())
def hull_area(rows: pd.Series) -> pd.Series:
    """Area of the convex hull of lattice rows, each coded (row * 65536 + min) * 65536 + max."""
    def area(codes) -> float:
        codes = np.sort(np.asarray(codes, dtype=np.int64))
        y, lo, hi = codes >> 32, (codes >> 16) & 0xFFFF, codes & 0xFFFF
        total = 0.0
        for cols, sign in ((hi, 1), (lo, -1)):          # right and left chain, then trapezoids
            chain: list[tuple[int, int]] = []
            for p in zip(y.tolist(), (sign * cols).tolist()):
                while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                          - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) >= 0:
                    chain.pop()
                chain.append(p)
            total += sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(chain, chain[1:]))
        return total
    return rows.map(area)


def solidity_feature(sums: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of the largest cluster over the area of their convex hull (at least 1), from outlines.

    Rows shrink to their two ends in the JVM; a batch of at most 64-row outlines goes to Python.
    """
    code = (F.col("r").cast("long") * 65536 + F.col("lo")) * 65536 + F.col("hi")
    best = (rows.groupBy("wafer_id", "comp").agg(F.sum("k").alias("n"), F.collect_list(code).alias("rows"))
            .groupBy("wafer_id").agg(F.max_by(F.struct("n", "rows"), F.struct(F.col("n"), -F.col("comp"))).alias("k")))
    return (sums.select("wafer_id").join(best.select("wafer_id", "k.*"), "wafer_id", "left")
            .select("wafer_id", F.when(F.col("n") >= 3, F.col("n") / F.greatest(hull_area(F.coalesce(
                "rows", F.array().cast("array<bigint>"))), F.lit(1.0))).otherwise(F.lit(1.0)).alias("salient_solidity")))


@cache
def rotation_operator(size: int = INPUT_SIZE, step: int = 15) -> np.ndarray:
    """(size^2, angles * size): how much each cell adds to each column of the rotated map, by bilinear
    interpolation. Of fixed size, 25 MB in a worker."""
    m = (size - 1) / 2
    v, col = np.divmod(np.arange(size * size), size)
    out = np.zeros((size * size, 180 // step * size))
    for i in range(180 // step):
        a = math.radians(i * step)
        sx, sy = math.cos(a) * (col - m) - math.sin(a) * (v - m) + m, math.sin(a) * (col - m) + math.cos(a) * (v - m) + m
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        for j in (0, 1):
            for k in (0, 1):
                weight = np.abs(1 - j - (sy - y0)) * np.abs(1 - k - (sx - x0))
                y, x = y0 + j, x0 + k
                ok = (y >= 0) & (y < size) & (x >= 0) & (x < size)
                np.add.at(out, (y[ok] * size + x[ok], i * size + col[ok]), weight[ok])
    return out


def radon_feature(sums: DataFrame) -> DataFrame:
    """Largest peak-to-mean ratio of the column sums over 12 rotations."""
    return sums.select("wafer_id", "radon_peak")


def moran_feature(cells: DataFrame) -> DataFrame:
    return morans_i(cells.where("2 * wn > s2"), "y", "x", F.col("fn"), min_sd=1e-6, unit=F.col("s2"))


def feature_matrix(cells: DataFrame) -> DataFrame:
    """All 35 features, one row per wafer, in the fixed order. Three branches read the resampled grid: sums over it,
    cluster outlines and Moran's I. The grid, and what clusters need of it, are checkpointed to the shared folder.

    Instead of resampled cells there may be dies(wafer_id, r, c, state): all three come from one pass, map by map."""
    ensure_checkpoint_dir(cells.sparkSession)
    if "state" in cells.columns:
        grids = wafer_grids(cells).checkpoint()
        sums, outline, moran = grids.select(*SUMS), grids.select("wafer_id", F.inline("outline")), grids.select("wafer_id", "moran_i")
    else:
        cells = cells.checkpoint()
        sums, outline, moran = grid_sums(on_cells(cells)).checkpoint(), outlines(cells).checkpoint(), moran_feature(cells)
    clusters = cluster_table(outline)
    parts = [density_features(sums).drop("area"), edge_features(sums), cluster_features(sums, clusters),
             salient_features(sums, clusters), solidity_feature(sums, outline), radon_feature(sums), moran]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "wafer_id")
    return out.select("wafer_id", *FEATURES)
