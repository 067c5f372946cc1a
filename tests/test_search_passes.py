"""Keys of the duplicate search: few for each map, met in passes, and off the disks when a pass ends."""

import numpy as np
import pytest

from diegrid.operators import mask_search as K
from diegrid.sources.tables import ensure_checkpoint_dir, stored


@pytest.fixture(scope="module")
def grids():
    """Random wafers, each with a turned copy in which one die in 30 is inverted."""
    random = np.random.default_rng(3)
    fails = [random.random((32, 32)) < 0.23 for _ in range(60)]
    fails += [K.turns((f ^ (random.random((32, 32)) < 0.03))[None])[i % 8, 0] for i, f in enumerate(fails)]
    return np.array([[f, ~f] for f in fails])


@pytest.fixture(scope="module")
def reps(spark, grids):
    ensure_checkpoint_dir(spark)
    rows = [(i, bytearray(np.packbits(g.reshape(2, -1), axis=1, bitorder="little").tobytes())) for i, g in enumerate(grids)]
    return spark.createDataFrame(rows, "rep long, canon binary").repartition(3)


def pairs(candidates, reps):
    return {(r["a"], r["b"], r["sim"]) for r in K.similar_pairs(candidates, reps, 0.8).collect()}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_no_mask_is_turned(reps):
    """Before, the larger mask of a pair had keys in eight positions: some 2,000 of a map."""
    assert K.search_keys(reps, 0.8, True).count() < 400 * 120 and K.search_keys(reps, 0.8, False).count() < 700 * 120


def test_counts_leave_no_chance_candidates(reps, grids):
    found = {(r["a"], r["b"]) for r in K.candidate_pairs(reps, 0.8).collect()}
    assert found >= {(i, i + 60) for i, a in enumerate(grids[:60])
                     if max(min((t[s] & grids[i + 60][s]).sum() / (t[s] | grids[i + 60][s]).sum() for s in (0, 1))
                            for t in np.stack([K.turns(a[s][None])[:, 0] for s in (0, 1)], axis=1)) >= 0.8}
    assert len(found) < 90


def test_passes_find_the_same_and_leave_the_disk(spark, reps, monkeypatch):
    want = pairs(K.candidate_pairs(reps, 0.8).cache(), reps)
    before = shuffle_files(spark)
    monkeypatch.setattr(K, "PASS", 9)                    # 14 passes
    few = K.candidate_pairs(reps, 0.8)
    assert not shuffle_files(spark) - before
    assert len(want) > 40 and pairs(few.cache(), reps) == want
    each = [K.search_keys(reps, 0.8, True, k, 14).count() for k in range(14)]
    assert sum(each) == K.search_keys(reps, 0.8, True).count() and max(each) < sum(each) / 5


def test_stored_leaves_no_shuffle_files(spark):
    ensure_checkpoint_dir(spark)
    before = shuffle_files(spark)
    out = stored(spark.range(1000).groupBy("id").count(), "rows")
    assert not shuffle_files(spark) - before and out.count() == 1000
