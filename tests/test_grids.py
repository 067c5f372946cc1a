"""Whole wafers as numpy grids, held against the same work on rows of cells."""

import numpy as np
from pyspark.sql import functions as F

from diegrid.constants import FEATURES
from diegrid.operators import dies as D, duplicates as U, features as M, grids, mask_search as S, quantify as Q


def some_dies(spark, wafers=40):
    random, rows = np.random.default_rng(4), []
    for w in range(wafers):
        h, wd = (int(v) for v in random.integers(1, 70 if w % 5 else 9, 2))
        if w == 7:
            h = wd = 1
        p = random.random()
        rows += [(w - 5, 3 + r, 2 + c, 2 if random.random() < p else 1) for r in range(h) for c in range(wd) if random.random() < 0.8 or (r, c) == (0, 0)]
    return spark.createDataFrame(rows, "wafer_id long, r int, c int, state int").repartition(5)


def test_packed_dies(spark, monkeypatch):
    monkeypatch.setattr(grids, "ROWS", 300)
    dies = some_dies(spark)
    want = {r["wafer_id"]: bytes(r["canon"]) for r in S.packed(U.fingerprint(D.resample_area(dies))).collect()}
    found = S.packed_dies(dies)
    assert {r["wafer_id"]: bytes(r["canon"]) for r in found.collect()} == want and len(want) > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan              # no row of a cell
    assert S.packed_dies(dies.where("r < 0")).count() == 0


def test_features_of_dies(spark):
    dies = some_dies(spark)
    want = {r["wafer_id"]: r for r in M.feature_matrix(D.resample_area(dies)).collect()}
    got = {r["wafer_id"]: r for r in M.feature_matrix(dies).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    for w, row in want.items():
        assert np.allclose([row[f] for f in FEATURES], [got[w][f] for f in FEATURES], rtol=1e-9, atol=1e-9), w
    plan = M.wafer_grids(dies)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_heatmap_of_many_shapes(spark):
    """Against the blur cell by cell; one shuffle of dies, no join of them."""
    dies = some_dies(spark, 12)
    found = Q.density_heatmap(dies)
    got = {(r["wafer_id"], r["r"], r["c"]): r["heat"] for r in found.collect()}
    rows, taps = dies.collect(), Q.gaussian_taps()
    mirror = lambda p, n: 0 if n == 1 else (p % (2 * n - 2) if p % (2 * n - 2) < n else 2 * n - 2 - p % (2 * n - 2))
    want = {}
    for w in {r["wafer_id"] for r in rows}:
        mine = [r for r in rows if r["wafer_id"] == w]
        h, wd = max(r["r"] for r in mine) + 1, max(r["c"] for r in mine) + 1
        mask = np.zeros((h, wd))
        for r in mine:
            mask[r["r"], r["c"]] = r["state"] == 2
        across = sum(t * mask[:, [mirror(c + k - 6, wd) for c in range(wd)]] for k, t in enumerate(taps))
        blur = sum(t * across[[mirror(r + k - 6, h) for r in range(h)]] for k, t in enumerate(taps))
        top = max(blur[r["r"], r["c"]] for r in mine)
        want |= {(w, r["r"], r["c"]): blur[r["r"], r["c"]] / (top + 1e-9) for r in mine}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1


def test_segmentation_range_of_whole_wafers(spark, monkeypatch):
    """Against nine segmentations by rows; neither dies nor activations are joined or exploded."""
    dies = some_dies(spark, 20)
    names = F.array(*[F.lit(c) for c in ("Center", "Loc", "Scratch", "None", "Random", "Edge-Ring", "Near-full")])
    classes = dies.select("wafer_id").distinct().where("wafer_id <> 3").select("wafer_id", F.element_at(names, F.pmod(F.col("wafer_id"), F.lit(7)).cast("int") + 1).alias("cls"))
    cam = dies.where("(r * 7 + c * 3 + wafer_id) % 5 <> 0 and wafer_id <> 2").select("wafer_id", "r", "c", ((F.col("r") * 13 + F.col("c") * F.col("c") + F.col("wafer_id")) % 17).cast("double").alias("cam"))
    monkeypatch.setattr(grids, "ROWS", 700)
    odd = cam.withColumn("cam", F.when((F.col("wafer_id") % 3 == 0) & (F.col("r") == 4), float("nan")).otherwise(F.col("cam")))
    for heat in (odd, None):
        found = Q.segmentation_range(dies, classes, heat)
        got = {r["wafer_id"]: (r["dies_min"], r["dies_max"]) for r in found.collect()}
        sizes = {}
        for limit in (1, 2, 3):
            for share in (0.3, 0.5, 0.7):
                for r in Q.segment_pattern(dies, classes, heat, limit, share).groupBy("wafer_id").count().collect():
                    sizes.setdefault(r["wafer_id"], []).append(r["count"])
        want = {w: (min(sizes[w]) if len(sizes.get(w, [])) == 9 else 0, max(sizes.get(w, [0]))) for w in got}
        assert got == want and len(got) == 20 and len(set(got.values())) > 5
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan
