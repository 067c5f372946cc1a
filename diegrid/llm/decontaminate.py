"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so MinHash would miss it.
Items are partitioned by size, and for each size class (at most L shingles) documents are cut into
windows of 2 L shingles every L shingles: a passage as long as the item lies whole in one window, and the
similarity with it is at least t * q / (2 L + (1 - t) * q), about 0.2 for t = 0.8 and q > L / 2.
With bands of one row, `BANDS` functions miss such a window with a chance of about 0.8 ** BANDS (1e-6).
One minimum per block of `UNIT` shingles serves all classes: a window's minimum is that of its blocks.
Candidates are verified by exact containment: the distinct shingles of the item that the document has.
Items of at most `SHORT` shingles would be a small share of the least window, so they are not sketched: all their
shingles are keys that every shingle of every document is looked up in, and the distinct keys found are counted.

Items are few beside the corpus, but nothing bounds their table: they are searched in blocks of
`ITEMS`, and only one block is broadcast at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diegrid.llm.words import ALNUM, LOWER, mix, runs_of_rows, shingle_hashes, utf8, word_bounds, word_hashes

BANDS, UNIT, ITEMS = 64, 16, 20_000
SHORT = UNIT // 2                        # items up to this size are found by all their shingles
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


class _Block:
    """One block of items, by shingle width: their shingles, minima by size class and band, and the keys of short items."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.ids, self.sets, self.classes, self.short = [i for i, _ in items], [], {}, {}
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        low = LOWER[data]
        starts, ends, first = word_bounds(low, offsets, ALNUM)
        words = word_hashes(low, starts, ends)
        for k in range(len(items)):
            w = min(width, int(first[k + 1] - first[k]))
            s = np.unique(shingle_hashes(words[first[k]:first[k + 1]], np.array([0, first[k + 1] - first[k]]), w)[0]) if w else np.zeros(0, np.uint64)
            self.sets.append(s)
            if w and len(s) <= SHORT:
                self.short.setdefault(w, []).append(k)
            elif w:
                units = 1 << max(0, int(np.ceil(np.log2(len(s) / UNIT))))
                self.classes.setdefault(w, {}).setdefault(units, []).append(k)
        for w, by in self.classes.items():
            for units, members in by.items():
                tables = []
                for a in _SEEDS:
                    lows = np.array([(self.sets[k] * a).min() for k in members], np.uint64)
                    order = np.argsort(lows, kind="stable")
                    tables.append((lows[order], np.array(members)[order]))
                by[units] = tables
        for w, members in self.short.items():
            of = np.repeat(np.array(members), [len(self.sets[k]) for k in members])
            every = np.concatenate([self.sets[k] for k in members])
            order = np.argsort(every, kind="stable")
            keys, first = np.unique(every[order], return_index=True)
            self.short[w] = keys, np.append(first, len(every)), of[order]

    def counted(self, hashes: np.ndarray, at: np.ndarray, w: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, common shingles) of every short item that a row shares a shingle with."""
        keys, first, members = self.short[w]
        place = np.searchsorted(keys, hashes)
        hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == hashes)
        rows = np.searchsorted(at, hit, side="right") - 1
        row, key = np.divmod(np.unique(rows * len(keys) + place[hit]), len(keys))
        n = first[key + 1] - first[key]
        items = members[np.repeat(first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs, common = np.unique(np.repeat(row, n) * len(self.ids) + items, return_counts=True)
        for pair, c in zip(pairs.tolist(), common.tolist()):
            yield *divmod(pair, len(self.ids)), c

    def candidates(self, hashes: np.ndarray, at: np.ndarray, by: dict) -> set[tuple[int, int]]:
        """(row, item) pairs with a window whose minimum equals the item's in one band."""
        n_blocks = -(-np.diff(at) // UNIT)
        rows = np.repeat(np.arange(len(n_blocks)), n_blocks)
        if not len(rows):
            return set()
        before = np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        place = np.arange(len(rows)) - before
        starts = np.repeat(at[:-1], n_blocks) + place * UNIT
        windows = {units: np.flatnonzero(place % units == 0) for units in by}
        found: set[tuple[int, int]] = set()
        for band, a in enumerate(_SEEDS):
            lows, span = np.minimum.reduceat(hashes * a, starts), 1
            for units in sorted(by):
                while span < 2 * units:                           # doubles the window, inside each row
                    far = np.minimum(np.arange(len(rows)) + span, len(rows) - 1)
                    lows = np.where(rows[far] == rows, np.minimum(lows, lows[far]), lows)
                    span *= 2
                table, members = by[units][band]
                seen = lows[windows[units]]
                left = np.searchsorted(table, seen)
                hit = np.flatnonzero(table[np.minimum(left, len(table) - 1)] == seen)
                right = np.searchsorted(table, seen[hit], side="right")
                for w, i, j in zip(windows[units][hit], left[hit], right):
                    found.update((int(rows[w]), int(k)) for k in members[i:j])
        return found

    def search(self, column: pa.Array, num: int, den: int) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, common shingles, shingles of the item) of every verified pair."""
        data, offsets = utf8(column)
        for i, j in runs_of_rows(offsets):
            low = LOWER[data[offsets[i]:offsets[j]]]
            starts, ends, first = word_bounds(low, offsets[i:j + 1] - offsets[i], ALNUM)
            words = word_hashes(low, starts, ends)
            for w in sorted({*self.classes, *self.short}):
                hashes, at = shingle_hashes(words, first, w)
                for r, k, common in self.counted(hashes, at, w) if w in self.short else ():
                    if common * den >= len(self.sets[k]) * num:
                        yield i + r, k, common, len(self.sets[k])
                for r, k in sorted(self.candidates(hashes, at, self.classes[w])) if w in self.classes else ():
                    common = int(np.isin(self.sets[k], hashes[at[r]:at[r + 1]]).sum())
                    if common * den >= len(self.sets[k]) * num:
                        yield i + r, k, common, len(self.sets[k])


def contaminated(docs: DataFrame, items: DataFrame, keep: list[str], width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs(text, *keep), items(item_id, text) -> *keep, item_id, common, item_size, containment of all pairs
    where the document has at least num / den of the item's distinct shingles.

    Words are runs of letters and digits, A-Z lower-cased, so case and punctuation do not hide a copy.
    An item of fewer words than `width` is one shingle of all its words. Null texts, texts without words
    and items without id give nothing. Repeated rows give repeated results, an empty table none.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    count = items.count()
    blocks = max(1, -(-count // ITEMS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    texts = docs.select(*keep, F.col("text"))
    fields = [f for f in texts.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in ("item_id", "common", "item_size")])
    names = [f.name for f in schema]

    def found(block: int) -> DataFrame:
        rows = [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == block).sort("item_id", "text").collect()]
        held = spark.sparkContext.broadcast(_Block(rows, width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(held.value.search(batch.column(len(keep)), num, den))
                take = pa.array([h[0] for h in hits], pa.int64())
                columns = [batch.column(c).take(take) for c in range(len(keep))]
                columns += [pa.array([held.value.ids[h[1]] for h in hits], pa.int64())] + [pa.array([h[c] for h in hits], pa.int64()) for c in (2, 3)]
                yield pa.RecordBatch.from_arrays(columns, names)

        return texts.mapInArrow(run, schema)

    return reduce(DataFrame.union, [found(b) for b in range(blocks)]).withColumn("containment", F.col("common") / F.col("item_size"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept, that hold no item. Rows are told apart by their whole content
    where doc_id repeats or is null: only rows with a contaminated text go."""
    bad = contaminated(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), items, ["doc_id", "text_hash"], **options)
    bad = bad.select("doc_id", "text_hash").distinct().alias("b")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("text_hash")).alias("d")
    kept = rows.join(bad, F.col("d.key").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash")), "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
