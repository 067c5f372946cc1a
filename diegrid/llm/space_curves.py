"""Approximate nearest neighbours by shifted space-filling curves.

For each of `CURVES` orderings, vectors on the unit sphere are projected to a few dimensions, shifted, and
put in the order of a Hilbert curve; orderings take their dimensions from a common rotation in turn, so
together they see all of them. Rows are cut into ranges of `RANGE` rows in that order; a query meets
the rows within `reach` places of its own on every curve, by a product of one-byte codes. The best of all windows
are merged by code, and the best of these ranked by the exact measure on original vectors.

Equal vectors are one row of the index with their smallest ids, so a vector that very many rows share
costs no more than others. A range is held once by a task and its queries stream past it, so memory
does not depend on their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diegrid.llm.store import written

CURVES, DIMS, BITS = 40, 6, 10
RANGE, RANGES = 16_384, 20_000           # rows of a range, about; most ranges, whose bounds are broadcast (6 MB)
TOGETHER = 32                            # queries, neighbours on the curve, that one product scores
REACH, LEAST = 0.01, 24                  # share of the rows on either side that a query meets on each curve; rows at least
MORE = 16                                # rows beyond k that are ranked again on original vectors


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned integer coordinates below 2 ** bits (Skilling, 2004)."""
    x = x.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def orderings(width: int, curves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and shift of each curve. A random rotation serves as many curves as it has groups of `DIMS` directions."""
    dims = min(DIMS, width)
    per, found = width // dims, []
    for c in range(curves):
        if c % per == 0:
            turn = np.linalg.qr(np.random.default_rng(1000 + c).normal(size=(width, width)))[0]
        found.append((turn[:, c % per * dims:(c % per + 1) * dims], np.random.default_rng(1_000_000 + c).random(dims)))
    return found


def curve_keys(unit: np.ndarray, basis: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Coordinates spread over the grid by the normal law that projections of high-dimensional directions follow about."""
    spread = 1 / (1 + np.exp(-1.702 * (unit @ basis) * np.sqrt(unit.shape[1])))
    return hilbert(np.clip(((0.75 * spread + 0.25 * shift) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def codes(v: np.ndarray) -> np.ndarray:
    """Components in 127ths of the largest one. Vectors of one direction have one code."""
    return np.rint(v / np.abs(v).max(axis=1, keepdims=True) * 127).astype(np.int8)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    v = v.where("exists(v, x -> x <> 0)")
    length = v.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if length["least"] == length["most"]:
        return v
    return v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(length["most"]) - F.size("v"))))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: sums of squares neither vanish
    nor overflow, and cosines keep their last bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, ids, qv, v) -> query, ids, score in double precision."""
    for batch in batches:
        if batch.num_rows:
            a, b = _scaled(_matrix(batch.column(2))), _scaled(_matrix(batch.column(3)))
            score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "ids", "score"])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _distinct(usable: DataFrame, k: int) -> DataFrame:
    """Each distinct vector once, with its k + 1 smallest ids; partitions reduce their rows first."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) + 0.0 if batch.num_rows else []):
                ids = seen.setdefault(row.tobytes(), [])
                ids.append(i)
                if len(ids) > 2 * k + 16:
                    ids[:] = sorted(set(ids))[:k + 1]
        keys = list(seen)
        for at in range(0, len(keys), 4096):
            part = keys[at:at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(seen[b]))[:k + 1] for b in part], pa.list_(pa.int64())),
                                              pa.array([np.frombuffer(b) for b in part], pa.list_(pa.float64()))], ["ids", "v"])

    rows = usable.mapInArrow(local, "ids array<long>, v array<double>")
    merged = rows.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return merged.select("v", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"))


def _keyed(index: DataFrame, curves: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                turns = turns or orderings(unit.shape[1], curves)
                for c, (basis, shift) in enumerate(turns):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(unit), c, np.int32)), pa.array(curve_keys(unit, basis, shift))], ["row", "curve", "key"])

    return index.select("row", "v").mapInArrow(run, "row long, curve int, key long")


def _coded(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` with a code of vector v."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c.tobytes() for c in codes(_matrix(batch.column(len(names))))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*names, "code"])

    return rows.select(*names, "v").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", code binary")


def _decoded(column: pa.Array) -> np.ndarray:
    """Codes as floats of length 1."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _windows(take: int):
    """A sorted partition holds, range by range, rows in their order (kind 0) and then queries in theirs (kind 1). Each
    query keeps the `take` rows of its window with the best codes, ties by smallest id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            curve, part, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(curve) | np.diff(part) | np.diff(kind)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                if (curve[lo], part[lo]) != current:
                    current, held = (curve[lo], part[lo]), []
                piece = batch.slice(lo, hi - lo)
                place, low, high, ids, first = (piece.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8))
                code = _decoded(piece.column(8))
                if kind[lo] == 0:
                    held.append((place, ids, first, code))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                if not held:
                    continue
                (places, rows, firsts, known), out = held[0], []
                for at in range(0, len(ids), TOGETHER):
                    some = slice(at, at + TOGETHER)
                    a, b = np.searchsorted(places, low[some]), np.searchsorted(places, high[some], "right")
                    base = a.min()
                    score = code[some] @ known[base:b.max()].T
                    for i, (x, y) in enumerate(zip(a - base, b - base)):
                        s = score[i, x:y]
                        good = np.flatnonzero(s >= np.partition(s, len(s) - take)[len(s) - take]) if len(s) > take else np.arange(len(s))
                        good = good[np.lexsort((firsts[base + x + good], -s[good]))[:take]]
                        out.append((np.full(len(good), ids[at + i]), rows[base + x + good], firsts[base + x + good], s[good]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query", "row", "first", "near"])
    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = CURVES, reach: float = REACH) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found of every row whose id is
    divisible by `every`, by cosine in double precision, ties to smaller ids, the query's own id left out.

    Null, zero, null-holding and non-finite vectors take no part, nor do rows without id. Rows that repeat an
    id with another vector are further candidates under that id, which is listed once, and such a query has
    its smallest vector. Shorter vectors go on with zeros. Any finite size of components is right. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors)
    index = written(_distinct(usable, k).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = index.count()
    queries = usable.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(queries.select(F.col("vec_id").alias("query"), "v"), "queries")
    at = written(_coded(queries.join(index.select("v", "row"), "v"), ["query", "row"]), "query_rows")

    ranges = min(RANGES, max(1, -(-total // RANGE)))
    keys = written(_keyed(index, curves), "keys")
    cuts = {r["curve"]: np.unique(np.array(r["cuts"], np.int64)) for r in keys.groupBy("curve").agg(
        F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("cuts")).collect()}
    held_cuts = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curve, key, part = batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for c in np.unique(curve):
                part[curve == c] = np.searchsorted(held_cuts.value[c], key[curve == c])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["row", "curve", "key", "part"])

    keyed = keys.mapInArrow(place, "row long, curve int, key long, part int")
    counts = keyed.groupBy("curve", "part").count()
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = written(ahead, "ranges")
    starts: dict[int, list[tuple[int, int]]] = {}
    for r in ahead.sort("curve", "part").collect():          # at most RANGES for each curve
        starts.setdefault(r["curve"], []).append((r["ahead"] + 1, r["part"]))
    held_starts = spark.sparkContext.broadcast({c: np.array(x, np.int64).T for c, x in starts.items()})
    ranked = keyed.withColumn("place", F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "row")))
    ranked = written(ranked.join(F.broadcast(ahead.select("curve", "part", "ahead")), ["curve", "part"])
                     .select("curve", "part", "row", (F.col("place") + F.col("ahead")).alias("place")), "places")
    near = max(k + 1, LEAST, int(reach * total))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranges that the window of a query touches, one row each."""
        for batch in batches:
            curve, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first, last = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for c in np.unique(curve):
                start, mine = held_starts.value[c][0], curve == c
                first[mine] = np.maximum(np.searchsorted(start, places[mine] - near, "right") - 1, 0)
                last[mine] = np.searchsorted(start, places[mine] + near, "right") - 1
            times = last - first + 1
            source = np.repeat(np.arange(batch.num_rows), times)
            step = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times) + first[source]
            part = np.array([held_starts.value[c][1][i] for c, i in zip(curve[source], step)], np.int32)
            more = batch.take(pa.array(source))
            yield pa.RecordBatch.from_arrays([more.column(0), pa.array(part), *more.columns[1:]], ["curve", "part", "place", "query", "code"])

    asked = ranked.join(at, "row").select("curve", "place", "query", "code").mapInArrow(reached, "curve int, part int, place long, query long, code binary")
    asked = asked.select("curve", "part", F.lit(1).alias("kind"), "place", (F.col("place") - near).alias("low"), (F.col("place") + near).alias("high"),
                         F.col("query").alias("id"), F.lit(0).cast("long").alias("first"), "code")
    coded = _coded(index.select("row", F.col("ids")[0].alias("first"), "v"), ["row", "first"])
    rows = ranked.join(coded, "row").select("curve", "part", F.lit(0).alias("kind"), "place", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"),
                                            F.col("row").alias("id"), "first", "code")
    met = (rows.unionByName(asked).repartition("curve", "part").sortWithinPartitions("curve", "part", "kind", "place")
           .mapInArrow(_windows(k + MORE), "query long, row long, first long, near float"))
    met = met.groupBy("query", "row").agg(F.min("first").alias("first"), F.max("near").alias("near"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "first"))
    met = written(met.withColumn("place", best).where(F.col("place") <= k + MORE).select("query", "row"), "met")

    pairs = met.join(queries.select("query", F.col("v").alias("qv")), "query").join(index.select("row", "ids", "v"), "row")
    scored = pairs.select("query", "ids", "qv", "v").mapInArrow(_cosines, "query long, ids array<long>, score double")
    found = scored.select("query", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.select(F.col("query").alias("query_id"), rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
