"""Exact similarity search over pairs of bit masks up to the eight symmetries of the square.

Two masks with an IoU of at least t differ in at most d = floor((1 - t) / (1 + t) * (sum of their sizes)) cells. If the
cells are cut into blocks and a mask picks d // 2 + 1 of them, every such partner differs in at most one cell
in one of the picked blocks. So a block's content is the key, together with all contents that lack one of its
cells: contents that differ in one cell share the smaller one. A block holds about nine set cells whatever the
size of the mask, which makes chance matches rare; the emptiest blocks are the ones that are not picked.

A block takes whole orbits of cells, so no symmetry moves a cell out of it and the smallest code of its eight turned contents
stands for all of them: neither mask of a pair is turned. Size classes with more blocks than orbits cut them, and
there the larger mask asks in all eight positions. The larger mask of a pair picks the blocks. They depend on its
size class, so the smaller one has keys for its own class and the next. The sparser of the two
masks (fails or passes) is searched; where both are about equal, both are, since partners may disagree.

A key carries the counts of its mask in groups of orbits. No symmetry changes them and a cell changes one count by one, so masks whose counts
lie further apart than they may differ are no candidates, before any mask is read. The keys of many maps are met some blocks at a time (`PASS`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diegrid.constants import FINGERPRINT_SIZE
from diegrid.operators.grids import Wafers, per_wafer, resampled
from diegrid.sources.tables import stored

S = FINGERPRINT_SIZE
CELLS = S * S
_SPARE = 2                               # blocks beyond those that a mask must pick, so that empty ones can be left out
_RANDOM = np.random.default_rng(20)
_CODE = _RANDOM.integers(0, 2 ** 63, CELLS, np.uint64)           # a content is the exclusive or of its cells' codes
_RANK = _RANDOM.permutation(CELLS)                               # blocks take cells from all over the map
PASS = 1 << 16                           # maps, about, whose keys are on disk at once
GROUPS = 32                              # groups of orbits whose counts a key carries, four bits each in two words


def turns(bits: np.ndarray) -> np.ndarray:
    """(maps, S, S) -> (8, maps, S, S): rotations and mirrors, in the order of `symmetric_cells`."""
    t = bits.transpose(0, 2, 1)
    return np.stack([bits, np.rot90(bits, -1, (1, 2)), bits[:, ::-1, ::-1], np.rot90(bits, 1, (1, 2)), bits[:, :, ::-1], t, bits[:, ::-1], t[:, ::-1, ::-1]])


_CELL = turns(np.arange(CELLS).reshape(1, S, S)).reshape(8, CELLS)       # the cell that each position of a turned map shows
_PLACE = np.argsort(_CELL, axis=1)                               # where a turn puts each cell
_CODES = _CODE[_PLACE]
_ORBIT = np.unique(_PLACE.min(axis=0), return_inverse=True)[1]   # cells that symmetries put on one another
ORBITS = int(_ORBIT.max()) + 1
_ORBIT_RANK = _RANDOM.permutation(ORBITS)[_ORBIT]
_GROUP = (_RANDOM.permutation(ORBITS) % GROUPS)[_ORBIT]


def unpacked(masks: list[bytes] | pa.Array) -> np.ndarray:
    """(maps, 2, S, S) fails and passes of packed masks."""
    data = np.frombuffer(b"".join(m.as_py() if isinstance(m, pa.Scalar) else m for m in masks), np.uint8)
    return np.unpackbits(data.reshape(-1, 2, CELLS // 8), axis=2, bitorder="little").reshape(-1, 2, S, S)


def packed(words: DataFrame) -> DataFrame:
    """words(wafer_id, y, fail_word, pass_word) -> wafer_id, canon: the smallest of the eight variants of fails
    and passes as 2 x S x S bits. Maps without fails or without passes are left out."""
    rows = words.groupBy("wafer_id").agg(F.collect_list(F.struct("y", "fail_word", "pass_word")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            owner = np.repeat(np.arange(n), batch.column(1).value_lengths().to_numpy())
            flat = batch.column(1).flatten()
            grid = np.zeros((n, 2, S), np.uint32)
            for side, name in enumerate(("fail_word", "pass_word")):
                grid[owner, side, flat.field("y").to_numpy()] = flat.field(name).to_numpy().astype(np.uint64).astype(np.uint32)
            bits = np.unpackbits(grid.view(np.uint8), axis=2, bitorder="little").reshape(n, 2, S, S)
            some, canon = _smallest(bits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(canon, pa.binary())], ["wafer_id", "canon"])

    return rows.mapInArrow(run, "wafer_id long, canon binary")


def _smallest(bits: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which maps have both fails and passes, and the smallest variant of each of them."""
    some = np.flatnonzero(bits.any(axis=(2, 3)).all(axis=1))
    both = np.stack([turns(bits[some, side]) for side in (0, 1)], axis=2)
    code = np.packbits(both.reshape(8, len(some), 2, CELLS), axis=3, bitorder="little").reshape(8, len(some), CELLS // 4)
    return some, [min(code[v, i].tobytes() for v in range(8)) for i in range(len(some))]


def packed_dies(dies: DataFrame) -> DataFrame:
    """`packed` fingerprints of dies(wafer_id, r, c, state): each map is resampled and packed where its dies meet, so
    no row of a cell is made."""
    def body(wafers: Wafers) -> Iterator[pa.RecordBatch]:
        for part, s, on, bad in resampled(wafers, S):        # cells of twice the model grid's side: four of its cells each
            fail, full = bad > s * s / 2, on > s * s / 2
            some, canon = _smallest(np.stack([fail, full & ~fail], axis=1).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(wafers.ids[part[some]]), pa.array(canon, pa.binary())], ["wafer_id", "canon"])

    return per_wafer(dies.select("wafer_id", "r", "c", "state"), body, "wafer_id long, canon binary")


def _differ(size: np.ndarray | float, threshold: float) -> np.ndarray:
    """Most cells in which a mask of this size and one that is not larger can differ."""
    return np.floor((1 - threshold) / (1 + threshold) * 2 * size + 1e-9).astype(np.int64)


def _keys(bits: np.ndarray, level: int, n_blocks: int, picked: np.ndarray, which: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, lacking) of the fullest `picked` blocks of each mask that belong to one of `parts` passes."""
    row, cell = np.nonzero(bits)
    whole_orbits = n_blocks <= ORBITS
    block = _ORBIT_RANK * n_blocks // ORBITS if whole_orbits else _RANK * n_blocks // CELLS
    codes = _CODES if whole_orbits else _CODE[None]
    slot = row * n_blocks + block[cell]
    count = np.bincount(slot, minlength=len(bits) * n_blocks).reshape(len(bits), n_blocks)
    place = np.empty_like(count)
    np.put_along_axis(place, np.argsort(-count, axis=1, kind="stable"), np.arange(n_blocks)[None, :], axis=1)
    use = ((place < picked[:, None]) & ((np.arange(n_blocks) + level) % parts == part)[None, :]).ravel()
    mine = np.flatnonzero(use[slot])
    mine = mine[np.argsort(slot[mine], kind="stable")]
    row, cell, slot = row[mine], cell[mine], slot[mine]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    content = np.zeros((len(codes), len(use)), np.uint64)
    if len(slot):
        content[:, slot[first]] = np.bitwise_xor.reduceat(codes[:, cell], first, axis=1)
    at = np.arange(len(use))
    salt = np.uint64(0x9E3779B97F4A7C15) * (np.uint64((level * 2 + which) * CELLS) + (at % n_blocks).astype(np.uint64) + np.uint64(1))
    whole = np.flatnonzero(use)
    key = np.concatenate([content[:, whole].min(axis=0) ^ salt[whole], (content[:, slot] ^ codes[:, cell]).min(axis=0) ^ salt[slot]])
    return np.concatenate([whole // n_blocks, row]), key.view(np.int64), np.repeat([False, True], [len(whole), len(row)])


def _counts(bits: np.ndarray, size: float) -> np.ndarray:
    """Set cells of each group, four bits each, counted from below what a mask of `size` cells has."""
    row, cell = np.nonzero(bits)
    n = np.bincount(row * GROUPS + _GROUP[cell], minlength=len(bits) * GROUPS).reshape(len(bits), GROUPS)
    n = np.clip(n - max(0, int(size / GROUPS) - 8), 0, 15).astype(np.uint64).reshape(len(bits), -1, 16)
    return np.bitwise_or.reduce(n << (4 * np.arange(16, dtype=np.uint64)), axis=2).view(np.int64)


def _near(threshold: float):
    """Of rows (a, b, sum of their sizes, counts of both) those whose counts lie no further apart than such masks may differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.stack([batch.column(i).to_numpy() for i in at], axis=1).view(np.uint8) for at in ((3, 4), (5, 6)))
            apart = sum(np.abs((x >> h & 15).astype(np.int8) - (y >> h & 15).astype(np.int8)).sum(axis=1) for h in (0, 4))
            kept = pa.array(np.flatnonzero(apart <= _differ(batch.column(2).to_numpy() / 2, threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])
    return run


def _level(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.floor(np.log(size) / math.log(1 / max(min(threshold, 0.99), 0.05)) + 1e-9).astype(np.int64)


def _size(level: int, threshold: float) -> float:
    """The least size of a class of sizes."""
    return math.exp(level * math.log(1 / max(min(threshold, 0.99), 0.05)))


def _blocks(level: int, threshold: float) -> int:
    top = min(CELLS, _size(level + 1, threshold))
    return int(min(CELLS, _differ(top, threshold) // 2 + 1 + _SPARE))


def search_keys(reps: DataFrame, threshold: float, asks: bool, part: int = 0, parts: int = 1) -> DataFrame:
    """reps(rep, canon) -> key, lacking, rep, size, other, counts0, counts1: of the larger mask of a pair, which asks, or of the smaller one;
    the blocks of one of `parts` passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, bits = batch.column(0).slice(at, 256).to_numpy(), unpacked(batch.column(1).slice(at, 256))
                sizes = bits.sum(axis=(2, 3), dtype=np.int64)
                for which in (0, 1):
                    size, other = sizes[:, which], sizes[:, 1 - which]
                    used = size * threshold <= other * (1 + 1e-9)
                    level = _level(size, threshold)
                    for lv in np.unique(np.concatenate([level[used], level[used] + 1])):
                        n_blocks = _blocks(int(lv), threshold)
                        rows = np.flatnonzero(used & ((level == lv) | ((level == lv - 1) & (not asks))))
                        if not len(rows):
                            continue
                        if asks and n_blocks > ORBITS:       # equal variants of one map are asked once
                            grids = turns(bits[rows, which]).transpose(1, 0, 2, 3).reshape(-1, CELLS)
                            owner = np.repeat(rows, 8)
                            packed_ = np.concatenate([owner[:, None].astype(">i8").view(np.uint8).reshape(-1, 8), np.packbits(grids, axis=1)], axis=1)
                            once = np.sort(np.unique(packed_, axis=0, return_index=True)[1])
                            grids, owner = grids[once], owner[once]
                        else:
                            grids, owner = bits[rows, which].reshape(-1, CELLS), rows
                        picked = np.minimum(_differ(size[owner], threshold) // 2 + 1, n_blocks) if asks else np.full(len(rows), n_blocks)
                        row, key, lacking = _keys(grids, int(lv), n_blocks, picked, which, part, parts)
                        o, counts = owner[row], _counts(grids, _size(int(lv), threshold))
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lacking), pa.array(ids[o]), pa.array(size[o].astype(np.int16)), pa.array(other[o].astype(np.int16)), pa.array(counts[row, 0]), pa.array(counts[row, 1])],
                                                         ["key", "lacking", "rep", "size", "other", "counts0", "counts1"])

    return reps.select("rep", "canon").mapInArrow(run, "key long, lacking boolean, rep long, size short, other short, counts0 long, counts1 long")


def candidate_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of reps(rep, canon) that can reach the threshold; no pair that does is missed.

    Every pass meets the keys of some blocks and stores what they find; then its keys leave the disks."""
    maps = reps.count()
    passes = -(-maps // PASS) if maps else 1
    larger = (F.col("sy") < F.col("sx")) | ((F.col("sy") == F.col("sx")) & (F.col("x") < F.col("y")))
    close = (F.col("sy") >= threshold * F.col("sx") - 1e-9) & (F.least("ox", "oy") >= threshold * F.greatest("ox", "oy") - 1e-9)
    tasks = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), maps // (passes * 4_000))       # a map has some 600 keys: so many rows a task
    found = []
    for k in range(passes):
        a, b = (search_keys(reps, threshold, asks, k, passes).toDF("key", f"l{v}", v, f"s{v}", f"o{v}", f"c{v}0", f"c{v}1") for asks, v in ((True, "x"), (False, "y")))
        met = a.repartition(tasks, "key").join(b.repartition(tasks, "key"), "key").where(~(F.col("lx") & F.col("ly")) & larger & close)
        met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("sx").cast("int") + F.col("sy"), "cx0", "cx1", "cy0", "cy1")
        found.append(met.mapInArrow(_near(threshold), "a long, b long").distinct())
        if passes > 1:
            found[-1] = stored(found[-1], "candidates")
    return reduce(DataFrame.union, found).distinct() if passes > 1 else found[0]


def similar_pairs(candidates: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """candidates(a, b) -> a, b, sim: largest over the variants of min(IoU of fails, IoU of passes), if it reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                a, b = unpacked(part.column(2)), unpacked(part.column(3))
                sims = []
                for side in (0, 1):
                    left = np.packbits(turns(a[:, side]).reshape(8, -1, CELLS), axis=2).view(np.uint64)
                    right = np.packbits(b[:, side].reshape(-1, CELLS), axis=1).view(np.uint64)
                    both = np.bitwise_count(left & right).sum(axis=2, dtype=np.int64)
                    sims.append(both / np.maximum(np.bitwise_count(left | right).sum(axis=2, dtype=np.int64), 1))
                sim = np.minimum(*sims).max(axis=0)
                kept = pa.array(np.flatnonzero(sim >= threshold))
                yield pa.RecordBatch.from_arrays([part.column(0).take(kept), part.column(1).take(kept), pa.array(sim).take(kept)], ["a", "b", "sim"])

    mask = [reps.select(F.col("rep").alias(k), F.col("canon").alias(f"m{k}")) for k in "ab"]
    return candidates.join(mask[0], "a").join(mask[1], "b").select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long, sim double")
