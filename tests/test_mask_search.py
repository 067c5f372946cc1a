"""The similarity search against brute force over all pairs, at several thresholds and densities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diegrid.operators import mask_search as K


def maps():
    """Unrelated maps from nearly empty to nearly full, half-full ones, and edited, turned copies of each."""
    random = np.random.default_rng(7)
    wafer = (np.add.outer((np.arange(32) - 15.5) ** 2, (np.arange(32) - 15.5) ** 2) < 250)
    out = []
    for density in [0.003, 0.01, 0.03, 0.1, 0.3, 0.48, 0.5, 0.52, 0.7, 0.97] * 3:
        fail = wafer & (random.random((32, 32)) < density)
        fail[16, 16] = True
        fail[15, 15] = False
        for edits in (0, 1, 2, 0.1, 0.2, 0.4):
            n = int(edits if edits >= 1 else edits * min(fail.sum(), (wafer & ~fail).sum()))
            changed = fail.copy()
            ys, xs = np.nonzero(wafer)
            at = random.choice(len(ys), n, replace=False)
            changed[ys[at], xs[at]] ^= True
            if changed.any() and (wafer & ~changed).any():
                out.append(K.turns(np.stack([changed, wafer & ~changed]))[int(random.integers(0, 8))])
    return np.array(out)


def similarity(a, b):
    turned = np.stack([K.turns(a[side][None])[:, 0] for side in (0, 1)], axis=1)
    both = (turned & b[None]).sum(axis=(2, 3))
    return (both / np.maximum((turned | b[None]).sum(axis=(2, 3)), 1)).min(axis=1).max()


@pytest.fixture(scope="module")
def grids():
    return maps()


@pytest.fixture(scope="module")
def truth(grids):
    return {(i, j): similarity(grids[i], grids[j]) for i in range(len(grids)) for j in range(i + 1, len(grids))}


def test_turns():
    g = np.arange(1024).reshape(1, 32, 32)
    y, x, m = *np.divmod(np.arange(1024), 32), 31
    where = [(y, x), (x, m - y), (m - y, m - x), (m - x, y), (y, m - x), (x, y), (m - y, x), (m - x, m - y)]
    assert all((K.turns(g)[v, 0][a, b] == np.arange(1024)).all() for v, (a, b) in enumerate(where))


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.6, 0.8, 0.9, 1.0])
def test_no_pair_is_missed(spark, grids, truth, threshold):
    from diegrid.sources.tables import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    rows = [(i, bytearray(np.packbits(g.reshape(2, -1), axis=1, bitorder="little").tobytes())) for i, g in enumerate(grids)]
    reps = spark.createDataFrame(rows, "rep long, canon binary").repartition(3)
    candidates = K.candidate_pairs(reps, threshold).cache()
    found = {(r["a"], r["b"]): r["sim"] for r in K.similar_pairs(candidates, reps, threshold).collect()}
    want = {p: s for p, s in truth.items() if s >= threshold}
    assert found.keys() == want.keys() and len(want) >= 20 and all(abs(found[p] - s) < 1e-12 for p, s in want.items())
    if threshold >= 0.8:                                 # chance candidates are rare
        assert candidates.count() < len(want) + 0.1 * len(truth)


def test_packed(spark, grids):
    """Words of rows to the smallest variant: turned copies have one form; maps without fails or passes drop out."""
    rows = []
    for i, g in enumerate(grids[:20]):
        for turn in (0, 3, 6):
            f, p = (K.turns(g[side][None])[turn, 0] for side in (0, 1))
            rows += [(3 * i + turn // 3, y, int((f[y] * (1 << np.arange(32))).sum()), int((p[y] * (1 << np.arange(32))).sum())) for y in range(32) if f[y].any() or p[y].any()]
    rows += [(900, 3, 5, 0), (901, 3, 0, 5)]
    got = {r["wafer_id"]: bytes(r["canon"]) for r in K.packed(spark.createDataFrame(rows, "wafer_id long, y int, fail_word long, pass_word long")).collect()}
    assert sorted(got) == list(range(60)) and all(got[3 * i] == got[3 * i + 1] == got[3 * i + 2] for i in range(20))
    assert K.packed(spark.createDataFrame([], "wafer_id long, y int, fail_word long, pass_word long")).where(F.col("canon").isNotNull()).count() == 0
