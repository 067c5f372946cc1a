"""Pixel tables to die maps: pixels(image, y, x, r, g, b), one row per pixel of a picture.

Colours are looked up in a table of the 32^3 quantised ones, histograms are per-image aggregations, pitches and votes
come from one picture at a time, and neighbouring dies meet in RANGE frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from diegrid.functions.prefix import exact_quantiles, keyed_median
from diegrid.operators.dies import STRIDE

# --- fixed values: degree-6 polynomial fit of the viridis colour map (public domain, M. Zucker);
# rows are the coefficients of t^0 .. t^6 for red, green, blue in [0, 1]
VIRIDIS = [
    (0.2777273272234177, 0.005407344544966578, 0.3340998053353061),
    (0.1050930431085774, 1.404613529898575, 1.384590162594685),
    (-0.3308618287255563, 0.214847559468213, 0.09509516302823659),
    (-4.634230498983486, -5.799100973351585, -19.33244095627987),
    (6.228269936347081, 14.17993336680509, 56.69055260068105),
    (4.776384997670288, -13.74514537774601, -65.35303263337234),
    (-5.435455855934631, 4.645852612178535, 26.3124352495832),
]
# --- fixed values: positions of off, pass, fail in a standard render, and tolerances
STANDARD, SPREAD, STANDARD_MASS, PEAK_MASS = (0, 128, 255), 24, 0.9, 0.004


def _nearest() -> pd.DataFrame:
    """Every colour in steps of 8 (32^3, packed in q) with the nearest position v, the smallest on ties, and the map's
    colour there: whatever the pictures hold."""
    t = np.arange(256) / 255.0
    colours = []
    for k in range(3):
        v = np.full(256, VIRIDIS[-1][k])
        for c in reversed(VIRIDIS[:-1]):
            v = v * t + c[k]
        colours.append(np.floor(np.clip(v * 255, 0.0, 255.0) + 0.5).astype(np.int32))
    q = np.arange(32 ** 3)
    v = sum((((q >> shift & 31) * 8 + 4)[:, None] - c) ** 2 for shift, c in zip((10, 5, 0), colours)).argmin(1).astype(np.int32)
    return pd.DataFrame({"q": q, "v": v} | {f"m{n}": c[v] for n, c in zip("rgb", colours)})


def with_position(pixels: DataFrame) -> DataFrame:
    """Adds v, the colour map position (0-255) nearest to the pixel's colour in steps of 8, and
    dist, the distance of the true colour to that map colour. Pixels without a colour are left out,
    channels outside 0-255 are an error.

    The search over the map runs once for each of the 32^3 quantised colours, not for pixels, which are read once.
    """
    found = pixels.sparkSession.createDataFrame(_nearest(), "q bigint, v int, mr int, mg int, mb int")
    channels = [F.col(n) for n in "rgb"]
    packed = sum((F.shiftleft(F.shiftright(F.col(n), 3), shift) for n, shift in (("g", 5), ("b", 0))), F.shiftleft(F.shiftright("r", 3), 10))
    beyond = (F.least(*channels) < 0) | (F.greatest(*channels) > 255)
    key = F.coalesce(F.when(beyond, F.raise_error("with_position: a channel outside 0-255").cast("bigint")).otherwise(packed.cast("bigint")), F.lit(-1).cast("bigint"))
    gap = sum(((F.col(n) - F.col(f"m{n}")) * (F.col(n) - F.col(f"m{n}")) for n in "rgb"), F.lit(0))
    return pixels.select("*", key.alias("q")).join(F.broadcast(found), "q").select("image", "y", "x", "v", F.sqrt(gap).alias("dist"))


def palette_levels(positions: DataFrame) -> DataFrame:
    """(image, palette, levels, codes): the standard palette where at least 90 % of the pixels lie
    near its colours, else the well separated peaks of the image's own histogram."""
    hist = positions.groupBy("image", "v").agg(F.count("*").alias("n"))
    near = F.lit(False)
    for s in STANDARD:
        near = near | (F.abs(F.col("v") - s) <= SPREAD)
    g = hist.groupBy("image").agg(F.sum("n").alias("total"), F.sum(F.when(near, F.col("n")).otherwise(F.lit(0))).alias("near"),
                                  F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "v"))).alias("peaks"))
    large = F.filter("peaks", lambda p: -p["neg"] >= PEAK_MASS * F.col("total"))
    picked = F.aggregate(large, F.array().cast("array<int>"), lambda acc, p: F.when(
        F.forall(acc, lambda a: F.abs(a - p["v"]) > SPREAD), F.array_append(acc, p["v"])).otherwise(acc))
    standard = F.col("near") / F.col("total") >= STANDARD_MASS
    levels = F.when(standard, F.array(*[F.lit(s) for s in STANDARD])).otherwise(F.array_sort(picked))
    g = g.select("image", standard.alias("std"), levels.alias("levels"))
    codes = (F.when(F.col("std"), F.array(F.lit(0), F.lit(1), F.lit(2)))
             .when(F.size("levels") == 2, F.array(F.lit(0), F.when(F.get("levels", F.lit(1)) < 128, 1).otherwise(2)))
             .otherwise(F.transform("levels", lambda _l, i: F.least(i, F.lit(2)))))
    name = F.when(F.col("std"), "standard").otherwise(F.concat(F.lit("levels["), F.array_join(F.col("levels").cast("array<string>"), ", "), F.lit("]")))
    return g.select("image", name.alias("palette"), "levels", codes.alias("codes"))


def pixel_states(positions: DataFrame) -> DataFrame:
    """Pixels with their die state: the code of the nearest level, the lower one on ties. States
    are decided for the 256 positions of each image, 256 bytes that its pixels look up."""
    distance = lambda v: F.zip_with("levels", "codes", lambda a, c: F.struct(F.abs(a - v).alias("d"), a.alias("a"), c.alias("c")))
    states = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.array_min(distance(v))["c"].cast("byte"))
    table = palette_levels(positions).select("image", states.alias("states"))
    return (positions.select("image", "y", "x", "v").join(table.hint("shuffle_hash"), "image")
            .select("image", "y", "x", F.get("states", F.col("v")).cast("int").alias("state")))


def _picture(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    y, x, state = (rows.column(n).to_numpy().astype(np.int64) for n in ("y", "x", "state"))
    return y, x, state, int(y.max()) + 1, int(x.max()) + 1


def state_lines(states: DataFrame) -> DataFrame:
    """(image, y, line): the states (0-9) of each pixel line as text, by x."""
    def run(rows: pa.Table) -> pa.Table:
        y, x, state, _h, _w = _picture(rows)
        order = np.lexsort((x, y))
        text = (state[order] + 48).astype(np.uint8).tobytes().decode("ascii")
        at, start = np.unique(y[order], return_index=True)
        lines = [text[a:b] for a, b in zip(start, [*start[1:], len(text)])]
        return pa.table([pa.array(np.full(len(at), rows.column("image")[0].as_py())), pa.array(at, pa.int32()), pa.array(lines, pa.string())], names=["image", "y", "line"])

    return (states.select(F.col("image").cast("long").alias("image"), "y", "x", "state").groupBy("image")
            .applyInArrow(run, "image long, y int, line string"))


def _count(line: np.ndarray, pos: np.ndarray, state: np.ndarray, size: int, lo: int, hi: int, min_boundaries: int) -> int | None:
    """Dies along an axis: the smallest count whose phases of the colour changes come near the best one's."""
    order = np.lexsort((pos, line))
    line, pos, state = line[order], pos[order], state[order]
    at = pos[1:][(line[1:] == line[:-1]) & (state[1:] != state[:-1])]
    if len(at) < max(1, min_boundaries):
        return None
    n = np.bincount(at)
    where = np.flatnonzero(n)
    k = np.arange(lo, hi + 1)
    phase = 6.283185307179586 * k[:, None] * where / size
    score = np.hypot(np.cos(phase) @ n[where], np.sin(phase) @ n[where]) / len(at)
    return int(k[score >= 0.8 * score.max()][0])


def _pitch(rows: pa.Table, lo: int, hi: int, min_boundaries: int) -> tuple[int, int, int | None, int | None]:
    y, x, state, h, w = _picture(rows)
    return h, w, _count(x, y, state, h, lo, hi, min_boundaries), _count(y, x, state, w, lo, hi, min_boundaries)


def grid_pitch(states: DataFrame, lo: int = 12, hi: int = 160, min_boundaries: int = 20) -> DataFrame:
    """(image, h, w, rows, cols): dies along each axis; NULL where there are too few boundaries.

    Colour changes sit on multiples of the pitch, so the mean phase |e^{2 pi i n pos / size}| peaks
    at the right count n and its multiples; the smallest n near the maximum is taken. A picture, a bounded group, is
    looked at as a whole; Spark deals the pictures to the tasks.
    """
    def run(rows: pa.Table) -> pa.Table:
        return pa.table([[v] for v in (rows.column("image")[0].as_py(), *_pitch(rows, lo, hi, min_boundaries))], schema=schema)

    schema = pa.schema([("image", pa.int64()), *[(n, pa.int32()) for n in ("h", "w", "rows", "cols")]])
    return (states.select(F.col("image").cast("long").alias("image"), "y", "x", "state").groupBy("image")
            .applyInArrow(run, "image long, h int, w int, rows int, cols int"))


def cell_votes(states: DataFrame, lo: int = 12, hi: int = 160, min_boundaries: int = 20) -> DataFrame:
    """Majority state in a window of 0.4 pitch round each die centre (lowest state on ties), and how
    many pixels of the die's whole cell carry that state. Pictures without a pitch have no cells."""
    names = ["image", "r", "c", "state", "agree", "pixels"]

    def run(rows: pa.Table) -> pa.Table:
        h, w, n_rows, n_cols = _pitch(rows, lo, hi, min_boundaries)
        if n_rows is None or n_cols is None:
            return schema.empty_table()
        y, x, state, _h, _w = _picture(rows)
        r, c = y * n_rows // h, x * n_cols // w
        k = max(1, int(np.floor(0.4 * min(h / n_rows, w / n_cols))))

        def inside(pos: np.ndarray, cell: np.ndarray, n: int, length: int) -> np.ndarray:
            start = np.floor((cell + 0.5) * length / n).astype(np.int64) - k // 2
            return (pos >= start) & (pos < start + k)

        near = inside(y, r, n_rows, h) & inside(x, c, n_cols, w)
        cell = r * n_cols + c
        known = (state >= 0) & (state <= 2)
        every = np.bincount(cell[known] * 3 + state[known], minlength=n_rows * n_cols * 3).reshape(-1, 3)
        votes = np.bincount((cell * 3 + state)[near & known], minlength=n_rows * n_cols * 3).reshape(-1, 3)
        found = np.unique(cell)
        win = votes[found].argmax(1)                                # the lowest state on ties
        columns = [np.full(len(found), rows.column("image")[0].as_py()), found // n_cols, found % n_cols, win, every[found, win], every[found].sum(1)]
        return pa.table([pa.array(v).cast(f.type) for v, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([(n, pa.int32() if n in ("r", "c", "state") else pa.int64()) for n in names])
    return (states.select(F.col("image").cast("long").alias("image"), "y", "x", "state").groupBy("image")
            .applyInArrow(run, "image long, r int, c int, state int, agree long, pixels long"))


def render_agreement(votes: DataFrame) -> DataFrame:
    """Share of each image's pixels that the recovered grid reproduces."""
    return votes.groupBy("image").agg((F.sum("agree") / F.sum("pixels")).alias("agreement"))


def audit_agreement(agreement: DataFrame) -> DataFrame:
    """Minimum, first percentile and median over all images, linearly interpolated."""
    return exact_quantiles(agreement, [], "agreement", [0.0, 0.01, 0.5]).toDF("min", "p01", "median")


def looks_rendered(positions: DataFrame, near: float = 40.0) -> DataFrame:
    """More than 90 % of all pixels within `near` of a map colour."""
    g = positions.groupBy("image").agg(F.avg((F.col("dist") < near).cast("int")).alias("share"))
    return g.select("image", "share", (F.col("share") > 0.9).alias("rendered"))


def die_to_die(die_px: DataFrame, k_mad: float = 6.0, min_affected: float = 0.05) -> DataFrame:
    """Registered die measurements (wafer_id, r, c, px, value) -> share of deviating pixels and
    state of each die.

    Each die's median is removed; the reference of a pixel is the median over the eight
    neighbouring dies, absent ones replaced by the wafer's median die; deviations are judged by
    the wafer's median absolute deviation. The other medians are over one die or one pixel position
    of a wafer: bounded groups. The last one, over all pixels of a wafer, holds no buffer of them.
    """
    die = Window.partitionBy("wafer_id", "r", "c")
    spot = Window.partitionBy("wafer_id", "px")
    d = die_px.select("wafer_id", "r", "c", "px", (F.col("r") * STRIDE + F.col("c")).alias("code"), (F.col("value") - F.median("value").over(die)).alias("v"))
    order = spot.orderBy("code")
    frames = [F.collect_list("v").over(order.rangeBetween(a, b)) for a, b in (
        (-STRIDE - 1, -STRIDE + 1), (-1, -1), (1, 1), (STRIDE - 1, STRIDE + 1))]
    d = d.select("*", F.median("v").over(spot).alias("golden"), F.concat(*frames).alias("near"))
    full = F.array_sort(F.concat("near", F.array_repeat("golden", 8 - F.size("near"))))
    d = d.select("wafer_id", "r", "c", F.abs(F.col("v") - (F.get(full, F.lit(3)) + F.get(full, F.lit(4))) / 2).alias("diff"))
    mad = keyed_median(d, ["wafer_id"], "diff", "mad").withColumn("mad", F.col("mad") + 1e-6)
    g = d.join(mad, "wafer_id").groupBy("wafer_id", "r", "c").agg(F.avg((F.col("diff") > k_mad * 1.4826 * F.col("mad")).cast("int")).alias("affected"))
    return g.select("*", F.when(F.col("affected") >= min_affected, 2).otherwise(1).alias("state"))


def blob_shapes(blobs: DataFrame, nm_per_px: float = 5.0, min_px: float = 20.0) -> DataFrame:
    """blobs(image, blob, area_px, perimeter, length, width) -> size, shape numbers and a hint for
    each, ranked by size within its image."""
    w = Window.partitionBy("image").orderBy(F.desc("area_px"), "blob")
    circ = 4 * 3.141592653589793 * F.col("area_px") / (F.col("perimeter") * F.col("perimeter") + 1e-9)
    elong = F.greatest("length", "width") / (F.least("length", "width") + 1e-9)
    hint = F.when(elong > 4, "scratch").when(circ > 0.7, "particle").otherwise("residue/irregular")
    return (blobs.where(F.col("area_px") >= min_px).withColumn("rank", F.row_number().over(w))
            .select("image", "rank", (F.col("area_px") * (nm_per_px / 1000) ** 2).alias("area_um2"), circ.alias("circularity"), elong.alias("elongation"), hint.alias("shape_hint")))
