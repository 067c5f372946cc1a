"""Hard negatives by Four-Russians scoring: exact integer inner products from tables of subset sums.

Components are whole numbers. The eight dimensions of a group have 256 subsets, so the sums of an anchor's
components over each of them are one table of 256 entries. A candidate's components are cut into bit planes
(two's complement), eight dimensions to a byte: its byte of a plane and group is the place in the table.
A score is the sum over planes of what the tables give, shifted by the plane; the highest plane counts negative.

Candidates are dealt to parts of bounded size. Each part is one run of a sorted partition: first its rows,
which the task keeps packed, then the anchors in a stream of batches. So a candidate is shuffled once, and a
task holds one part and one batch of anchors whatever the numbers of both are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diegrid.llm.store import written

PART = 1 << 17                           # most candidates of a part, about; a task packs them, a bit for each plane and dimension
ANCHORS = 128                            # anchors scored at once: the tables of a group take 128 x 256 sums
ROWS = 4_096                             # candidates scored at once


def quantised(vectors: DataFrame, scale: float = 256.0, changed: int = 7, labels: int = 10) -> DataFrame:
    """vectors(vec_id, embedding, label) -> id, label, v: floor(scale * x) of each component; where `changed`
    divides the id, the label first becomes (label + 1) % labels.

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Of rows that repeat an
    id, the one with the smallest label, then vector, stays. An empty vector has no components: its products are 0."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where("id is not null and label is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    if changed:
        rows = rows.withColumn("label", F.when(F.col("id") % changed == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    rows = rows.select("id", "label", F.transform("e", lambda x: F.floor(x * F.lit(scale))).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), max(width, int(length.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = flat
    return out


def bit_planes(v: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of whole numbers in two's complement; the last plane is the sign."""
    most = max(int(v.max(initial=0)), -1 - int(v.min(initial=0)), 0)
    groups = -(-v.shape[1] // 8)
    v = np.pad(v, ((0, 0), (0, 8 * groups - v.shape[1])))
    planes = [np.packbits(((v >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(most.bit_length() + 1)]
    return np.stack(planes)


def subset_sums(anchors: np.ndarray, groups: int, kind: type) -> np.ndarray:
    """(groups, 256, anchors): sums of each anchor's components over every subset of eight dimensions, each
    subset from the one without its highest member."""
    a = np.zeros((8 * groups, len(anchors)), kind)
    width = min(anchors.shape[1], 8 * groups)
    a[:width] = anchors[:, :width].T
    a = a.reshape(groups, 8, len(anchors))
    table = np.zeros((groups, 256, len(anchors)), kind)
    for bit in range(8):
        table[:, 1 << bit:2 << bit] = table[:, :1 << bit] + a[:, bit:bit + 1]
    return table


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products, by look-ups and shifted additions from the sign plane down."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    step = np.empty_like(total)
    for p in range(len(planes) - 1, -1, -1):
        total <<= 1
        for g in range(len(tables)):
            np.take(tables[g], planes[p, g], axis=0, out=step, mode="clip")
            (np.subtract if p == len(planes) - 1 else np.add)(total, step, out=total)
    return total


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the first k of their group by falling score, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.searchsorted(g, g)
    return order[np.arange(len(g)) - start < k]


def _leading(score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Which allowed entries of a column are at least its k-th largest one: all that can be among the first k."""
    if len(score) <= k:
        return allowed
    least = np.iinfo(score.dtype).min
    held = np.where(allowed, score, least).T.copy()
    return allowed & (score >= np.partition(held, len(score) - k, axis=1)[:, len(score) - k])


class _Part:
    """Packed candidates of one part."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.most = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        self.most = max(self.most, int(v.max(initial=0)), -int(v.min(initial=0)))
        self.rows.append((ids, labels, bit_planes(v)))

    def close(self) -> None:
        """One array of planes: fewer planes are continued by the sign, fewer groups by zeros."""
        deep, wide = (max((r[2].shape[i] for r in self.rows), default=1) for i in (0, 1))
        planes = [np.concatenate([r[2], np.repeat(r[2][-1:], deep - len(r[2]), axis=0)]) for r in self.rows]
        self.planes = np.ascontiguousarray(np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]), (0, 0))) for p in planes], axis=2))
        self.ids, self.labels = (np.concatenate([r[i] for r in self.rows]) for i in (0, 1))
        self.rows = []

    def blocks(self, anchors: np.ndarray, at_once: int) -> Iterator[tuple[int, np.ndarray]]:
        groups = self.planes.shape[1]
        bound = 8 * max(groups, 1) * max(self.most, 1) * 2 * (int(np.abs(anchors).max(initial=0)) + 1)
        if bound >= 1 << 63:
            raise ValueError("inner products of these vectors leave 64 bits")
        tables = subset_sums(anchors, groups, np.int32 if bound < 1 << 31 else np.int64)
        for at in range(0, len(self.ids), at_once):
            yield at, scores(tables, self.planes[:, :, at:at + at_once])


def _stream(pick: Callable, extra: list[str], out: pa.Schema, at_once: int):
    """Runs of a sorted partition: the candidates of a part (kind 0), then anchors (kind 1) in batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, _Part()
        for batch in batches:
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(parts) | np.diff(kinds)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                if parts[lo] != part:
                    part, held = parts[lo], _Part()
                piece = batch.slice(lo, hi - lo)
                ids, labels, v = piece.column(2).to_numpy(), piece.column(3).to_numpy(), matrix(piece.column(4))
                if kinds[lo] == 0:
                    held.add(ids, labels, v)
                    continue
                if held.rows:
                    held.close()
                if not hasattr(held, "planes"):      # a part may be empty
                    continue
                for a in range(0, len(ids), at_once):
                    some = slice(a, a + at_once)
                    more = [piece.column(piece.schema.get_field_index(x)).slice(a, at_once) for x in extra]
                    columns = pick(held, ids[some], labels[some], v[some], *more)
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
    return run


def _positives(k: int, at_once: int):
    def pick(part: _Part, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        best = [np.zeros(0, np.int64)] * 3
        for at, s in part.blocks(v, at_once):
            same = (part.labels[at:at + len(s), None] == labels[None, :]) & (part.ids[at:at + len(s), None] != ids[None, :])
            row, anchor = np.nonzero(_leading(s, same, k))
            found = anchor, s[row, anchor].astype(np.int64), part.ids[at + row]
            best = [np.concatenate(x) for x in zip(best, found)]
            kept = _first(*best, k)
            best = [x[kept] for x in best]
        return [ids[best[0]], best[1], best[2]]
    return pick


def _negatives(k: int, low: int, high: int, at_once: int):
    """For each anchor and positive the first k rows of other labels with low * p <= high * s <= high * p."""
    def pick(part: _Part, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, positive: pa.Array) -> list[np.ndarray]:
        count = positive.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = positive.flatten()
        pid, top = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        owner = np.repeat(np.arange(len(ids)), count)
        floor_ = np.array([-(-low * int(p) // high) for p in top], np.int64)
        least, most = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.iinfo(np.int64).min)
        np.minimum.at(least, owner, floor_)
        np.maximum.at(most, owner, top)
        best = [np.zeros(0, np.int64)] * 3
        for at, s in part.blocks(v, at_once):
            near = (s >= least) & (s <= most) & (part.labels[at:at + len(s), None] != labels[None, :])
            row, anchor = np.nonzero(near)
            order = np.argsort(anchor, kind="stable")
            row, anchor = row[order], anchor[order]
            score = s[row, anchor].astype(np.int64)
            bounds = np.searchsorted(anchor, np.arange(len(ids) + 1))
            group = []
            for o, t, f in zip(owner, top, floor_):
                own = score[bounds[o]:bounds[o + 1]]
                own = np.where((own <= t) & (own >= f), own, np.iinfo(np.int64).min)
                cut = max(f, np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else f
                group.append(np.flatnonzero(own >= cut) + bounds[o])
            if not group:
                continue
            which, hit = np.repeat(np.arange(len(group)), [len(g) for g in group]), np.concatenate(group)
            best = [np.concatenate(x) for x in zip(best, (which, score[hit], part.ids[at + row[hit]]))]
            kept = _first(*best, k)
            best = [x[kept] for x in best]
        return [ids[owner[best[0]]], pid[best[0]], top[best[0]], best[1], best[2]]
    return pick


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   part: int = PART, anchors_at_once: int = ANCHORS, rows_at_once: int = ROWS) -> DataFrame:
    """rows(id, label, v: array of whole numbers) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id `every` divides; scores are exact inner products, higher first, ties by smaller id.
    An anchor's positives are its first rows of the same label; for each, the first rows of other labels whose score s
    fulfils low * p <= high * s <= high * p for its score p. Ids are unique (`quantised` sees to it). Vectors
    of different lengths meet as if the shorter one went on with zeros. A score that could leave 64 bits is an error.
    Anchors without positives, and positives without negatives, give no rows; nor does an empty table."""
    rows = written(rows.select("id", "label", "v"), "vectors")
    total, tasks = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-total // part), min(2 * tasks, -(-total // rows_at_once)))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "label", "v")
    anchors = rows.where(F.col("id") % every == 0)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")

    def met(asked: DataFrame, pick: Callable, extra: list[str], schema: str, out: pa.Schema) -> DataFrame:
        both = held.unionByName(asked.select(everywhere, F.lit(1).alias("kind"), "*"), allowMissingColumns=True)
        return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "id").mapInArrow(_stream(pick, extra, out, anchors_at_once), schema)

    long = pa.int64()
    found = met(anchors, _positives(positives, rows_at_once), [], "anchor long, score long, id long",
                pa.schema([("anchor", long), ("score", long), ("id", long)]))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    first = found.select("*", rank.alias("rank")).where(F.col("rank") <= positives)
    lists = first.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positive"))
    asked = written(anchors.join(lists.withColumnRenamed("anchor", "id"), "id").select("id", "label", "v", "positive"), "anchors")
    near = met(asked, _negatives(negatives, low, high, rows_at_once), ["positive"], "anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long",
               pa.schema([(x, long) for x in ("anchor_id", "positive_id", "positive_score", "negative_score", "negative_id")]))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return (near.select("*", rank.alias("rank")).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
