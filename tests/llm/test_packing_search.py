"""The local search of packing: exchanges that raise squared fills, measured on instances whose optimum is known."""

import numpy as np
import pytest

from diegrid.llm import packing


def perfect(n, k, low, seed=5):
    """Lengths of n full bins of k documents of at least `low` tokens each."""
    random, out = np.random.default_rng(seed), []
    while len(out) < n * k:
        x = np.diff([0, *np.sort(random.integers(1, 2048, k - 1)), 2048])
        out += list(x) if x.min() >= low else []
    return np.array(out)


@pytest.mark.parametrize("n, k, low, share", [(1000, 3, 300, 0.8), (1000, 4, 200, 0.8), (800, 3, 500, 0.6)])
def test_perfect_bins(n, k, low, share):
    """The search saves `share` of the bins that best fit uses beyond the optimum."""
    lengths = perfect(n, k, low)
    packer = packing.Packer(lengths, 2048)
    before = sum(map(bool, packer.docs))
    packer.search()
    after = sum(map(bool, packer.docs))
    assert n <= after <= before - share * (before - n)
    assert sorted(d for ds in packer.docs for d in ds) == list(range(len(lengths)))
    assert all(sum(packer.lengths[d] for d in ds) + room == 2048 for ds, room in zip(packer.docs, packer.left))


def exchanges(packer, a, b):
    """By brute force: growths of the squares over all exchanges by which a loses and b gains."""
    def options(ds):
        ls = [packer.lengths[d] for d in ds]
        return [(0, 0), *((x, 1) for x in ls), *((x + y, 2) for i, x in enumerate(ls) for y in ls[:i])]
    fill = [packer.size - packer.left[a], packer.size - packer.left[b]]
    for mine, n in options(packer.docs[a])[1:]:
        for theirs, k in options(packer.docs[b]):
            if mine > theirs and (n, k) != (2, 2) and fill[1] + mine - theirs <= packer.size:
                yield (fill[0] - mine + theirs) ** 2 + (fill[1] + mine - theirs) ** 2 - fill[0] ** 2 - fill[1] ** 2


def test_ends_where_no_exchange_is_left():
    random = np.random.default_rng(4)
    for lengths in (random.integers(500, 900, 60), random.integers(200, 1300, 60), random.choice([650, 700, 720, 1300], 80)):
        packer = packing.Packer(lengths, 2048)
        packer.search()
        bins = [b for b, ds in enumerate(packer.docs) if ds and packer.left[b] > 0]
        optimal = sum(map(bool, packer.docs)) == -(-int(lengths.sum()) // 2048)
        assert optimal or not any(g > 0 for a in bins for b in bins if a != b for g in exchanges(packer, a, b))


def test_each_exchange_is_the_best(monkeypatch):
    """Every step raises the squares by as much as the best exchange of its giver found by brute force."""
    random, steps = np.random.default_rng(6), []
    give = packing.Packer._give

    def checked(self, a):
        bins = [b for b, ds in enumerate(self.docs) if ds and self.left[b] > 0 and b != a]
        want = max((g for b in bins for g in exchanges(self, a, b)), default=0)
        before = sum((self.size - x) ** 2 for x in self.left)
        found = give(self, a)
        grown = sum((self.size - x) ** 2 for x in self.left) - before
        assert found == (want > 0) and grown == max(want, 0)
        steps.append(grown)
        return found

    monkeypatch.setattr(packing.Packer, "_give", checked)
    packing.Packer(random.integers(400, 1000, 80), 2048).search()
    assert sum(g > 0 for g in steps) > 20


def test_pool_of_many_blocks(spark, monkeypatch):
    """Blocks of 200 pieces: all pieces placed once, without gaps, and few sequences beyond the optimum."""
    monkeypatch.setattr(packing, "BLOCK", 200)
    lengths = [int(x) for x in perfect(500, 3, 300)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_id long, length long").repartition(4)
    rows = packing.pack(pieces, 2048).collect()
    assert sorted(r["piece_id"] for r in rows) == list(range(len(lengths)))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["piece_id"]]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 515
