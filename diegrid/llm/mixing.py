"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in an order by hash, are one line cut into blocks. A source's quota is so many
blocks that their words reach its target. The tree starts with all quotas and the range of output shards; a node
draws how many of its blocks of each source go to its left half, which is a multivariate-hypergeometric law given the
half's capacity, and leaves are shards. So quotas are met exactly, and a shard is a uniformly random sample of the mix.

A keyed permutation puts the blocks of a source in a random order. The leaf that holds draws i to j of a source
takes the blocks at these places: leaves take disjoint blocks without knowing of each other. A second round over
a source has a permutation of its own. Inside a shard blocks are put in the order of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diegrid.functions.prefix import dense_ids
from diegrid.llm.store import written
from diegrid.llm.words import SPACES, mix, runs_of_rows, utf8, word_bounds

BLOCK = 256                              # words of a block; only a source's last one and its last draw are shorter
SHARD = 4_096                            # blocks of an output shard, about
CELL = 1 << 22                           # words of a cell, about: documents are put in order within cells
FEW_SOURCES = 1 << 14                    # up to here the table of sources is broadcast
SUBTREES = 1_024                         # nodes at which the tree is dealt to tasks
_SMALL = 500_000_000                     # numbers up to which numpy draws the law


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, size): words of each text, and a hash of id and text that orders documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            size = np.zeros(batch.num_rows, np.int64)
            for i, j in runs_of_rows(offsets, 1 << 22):
                size[i:j] = np.diff(word_bounds(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], SPACES)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size)], ["doc_id", "source", "h", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, h long, size long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sources(number, words) -> also target: `share` times all words dealt by weight, none above `most` times its
    words; what is cut off is dealt again by weight until none is above. Weights repeat along `number`."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    held = sources.withColumn("weight", w)
    budget = share * (held.agg(F.sum("words")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:                                          # few rounds: each one caps a further source
        full = F.col("words") * most <= level * F.col("weight") if capped >= 0 else F.lit(False)
        got = held.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("words") * most)), F.lit(0)).alias("filled"),
                       F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w")).first()
        if got["n"] == capped or not got["w"]:
            break
        level, capped = (budget - got["filled"]) / got["w"], got["n"]
    return held.withColumn("target", F.least((F.col("words") * most).cast("double"), F.lit(level) * F.col("weight")))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of x in a keyed permutation of range(n): a Feistel network over the next power of four,
    walked until it falls below n."""
    half = np.array([(int(m - 1).bit_length() + 1) // 2 for m in np.unique(n)], np.uint64)[np.searchsorted(np.unique(n), n)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right + key[todo] + np.uint64(r << 58)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _place(number: np.ndarray, epoch: np.ndarray, block: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    key = mix(mix(number.astype(np.uint64) + np.uint64(seed)) + epoch.astype(np.uint64) + np.uint64(1))
    return epoch * n + permuted(block, n, key)


def _before(draw: np.ndarray, block: int, tail: np.ndarray, short: list[np.ndarray]) -> np.ndarray:
    """Words of all draws before this one; `short` are the draws that hold the source's last block."""
    return draw * block - (block - tail) * sum((draw > j).astype(np.int64) for j in short)


def _quotas(block: int, most: int, seed: int):
    """Blocks of each source and draws that reach its target; the last draw is cut to meet it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, words, goal = (batch.column(i).to_numpy() for i in range(3))
            goal = np.minimum(np.floor(goal + 0.5).astype(np.int64), most * words)
            n = np.maximum(-(-words // block), 1)
            tail = words - (n - 1) * block
            short = [_place(number, np.full(len(n), e), n - 1, n, seed) for e in range(most)]
            draws = most * n
            for c in range(most, -1, -1):
                some = -(-(goal + c * (block - tail)) // block)
                draws = np.where(_before(some, block, tail, short) >= goal, np.minimum(draws, some), draws)
            last = goal - _before(draws - 1, block, tail, short)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(draws), pa.array(np.where(draws > 0, last, 0))], ["number", "n", "draws", "last"])
    return run


def hypergeometric(good: int, bad: int, sample: int, random: np.random.Generator) -> int:
    """How many of `sample` draws without replacement are good, for numbers of any size: the inverse of
    the distribution, searched from the mode outwards."""
    if good <= _SMALL and bad <= _SMALL:
        return int(random.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, sample - mode) - log_choose(good + bad, sample))
    u, down, up, p_down, p_up = random.random() - p, mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up, u = up + 1, u - p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down, u = down - 1, u - p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def halved(quotas: np.ndarray, sample: int, random: np.random.Generator) -> np.ndarray:
    """How many of `sample` draws from all blocks fall to each source, by its marginals one after another."""
    out, left = np.zeros_like(quotas), int(quotas.sum())
    if left <= _SMALL:
        return random.multivariate_hypergeometric(quotas, sample, method="marginals")
    for i, q in enumerate(quotas.tolist()):
        left -= q
        out[i] = hypergeometric(q, left, sample, random) if sample else 0
        sample -= int(out[i])
    return out


def _tree(shards: int, total: int, seed: int, stop: int):
    """Splits nodes (lo, hi: shards; number, quota, first: sources with blocks left) until they have at most
    `stop` shards. `first` is the number of a source's draws in shards to the left."""
    def capacity(lo: int, hi: int) -> int:
        return (hi - lo) * (total // shards) + min(hi, total % shards) - min(lo, total % shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                todo = [(row["lo"], row["hi"], *(np.array(row[c], np.int64) for c in ("number", "quota", "first")))]
                while todo:
                    lo, hi, number, quota, first = todo.pop()
                    if hi - lo <= stop:
                        yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([hi], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in (number, quota, first)]],
                                                         ["lo", "hi", "number", "quota", "first"])
                        continue
                    mid = (lo + hi) // 2
                    part = halved(quota, capacity(lo, mid), np.random.default_rng([seed, lo, hi]))
                    for a, b, q, f in ((mid, hi, quota - part, first + part), (lo, mid, part, first)):
                        some = q > 0
                        todo.append((a, b, number[some], q[some], f[some]))
    return run


def leaves(quotas: DataFrame, shards: int, total: int, seed: int) -> DataFrame:
    """quotas(number, draws) -> shard, number, first, count: which draws of each source a shard takes."""
    schema = "lo long, hi long, number array<long>, quota array<long>, first array<long>"
    root = quotas.where("draws > 0").agg(F.array_sort(F.collect_list(F.struct("number", "draws"))).alias("s"))       # one entry for each source
    root = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("s.number").alias("number"), F.col("s.draws").alias("quota"),
                       F.transform("s", lambda _: F.lit(0).cast("long")).alias("first"))
    top = written(root.mapInArrow(_tree(shards, total, seed, -(-shards // SUBTREES)), schema), "subtrees")
    nodes = top.repartition(min(SUBTREES, shards), "lo").mapInArrow(_tree(shards, total, seed, 1), schema)
    return nodes.select(F.col("lo").alias("shard"), F.inline(F.arrays_zip("number", "quota", "first"))).select("shard", "number", "first", F.col("quota").alias("count"))


def _spans(block: int, most: int, seed: int):
    """The drawn pieces of each document: (its row, number, draw, first word, words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, start, size, n, draws, last = (batch.column(i).to_numpy() for i in range(1, 7))
            low, high = start // block, (start + size - 1) // block
            count = np.where(size > 0, high - low + 1, 0)
            at = 0
            while at < len(count):                       # about a million blocks at once
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(count[at:]), 1 << 20, side="right")))
                row = np.repeat(np.arange(at, end), count[at:end])
                b = np.arange(len(row)) - np.repeat(np.cumsum(count[at:end]) - count[at:end], count[at:end]) + low[row]
                for epoch in range(most):
                    draw = _place(number[row], np.full(len(row), epoch), b, n[row], seed)
                    upto = (b + 1) * block
                    upto = np.where(draw == draws[row] - 1, np.minimum(upto, b * block + last[row]), upto)
                    first, stop = np.maximum(start[row], b * block) - start[row], np.minimum(start[row] + size[row], upto) - start[row]
                    kept = np.flatnonzero((draw < draws[row]) & (stop > first))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[kept])), *[pa.array(x[kept], pa.int64()) for x in (number[row], start[row], draw, first, stop - first)]],
                                                     ["doc", "number", "start", "draw", "first_word", "n_words"])
                at = end
    return run


def _ahead(rows: DataFrame) -> DataFrame:
    """rows(number, cell, words) -> number, cell, ahead: words of the source's cells before this one. Cells are
    summed in groups of 1,024 first, so that no window holds all cells of a large source."""
    group, before = F.expr("cell div 1024"), (Window.unboundedPreceding, -1)
    rows = rows.withColumn("group", group)
    sums = rows.groupBy("number", "group").agg(F.sum("words").alias("w"))
    sums = sums.select("number", "group", F.coalesce(F.sum("w").over(Window.partitionBy("number").orderBy("group").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("words").over(Window.partitionBy("number", "group").orderBy("cell").rowsBetween(*before)), F.lit(0))
    return rows.withColumn("inside", inside).join(sums, ["number", "group"]).select("number", "cell", (F.col("inside") + F.col("base")).alias("ahead"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text) -> (spans, rows).

    rows: doc_id, h, size, number (of the source), start (place in its line), source_size, target. spans: shard, place, doc (doc_id, h),
    number, start, draw, first_word, n_words: a training order by shard and place, of pieces of documents.

    Sources come by code point, null last; `weights` repeat along them. The mix has `share` times all words; a source
    gives at most `most` times its own, whole rounds first, so no document gives more either. Each source gives its
    target to the word, rounded. Null and empty texts have no words; rows that repeat an id each have a place; a null id is
    a row like others. The same rows give the same mix, whatever the partitions. An empty table gives no rows."""
    sizes = written(_rows(docs), "sizes")
    known = sizes.groupBy("source").agg(F.sum("size").alias("words")).withColumn("key", F.struct(F.col("source").isNull().alias("last"), "source"))
    known = written(known.join(dense_ids(known, "key", "number"), "key").select("number", "source", "words"), "sources")
    aimed = written(targets(known, weights, share, most), "targets")
    quotas = written(aimed.select("number", "words", "target").mapInArrow(_quotas(BLOCK, most, seed), "number long, n long, draws long, last long"), "quotas")
    sources = aimed.join(quotas, "number")
    got = quotas.agg(F.count("*").alias("n"), F.coalesce(F.sum("draws"), F.lit(0)).alias("draws")).first()
    total, shards = got["draws"], max(1, -(-got["draws"] // SHARD))
    cells = max(1, -(-(aimed.agg(F.sum("words")).first()[0] or 0) // CELL))

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if got["n"] <= FEW_SOURCES else df

    rows = sizes.join(near(sources.select("source", "number")), sizes["source"].eqNullSafe(sources["source"])).select("doc_id", "h", "size", "number", F.pmod("h", F.lit(cells)).alias("cell"))
    order = Window.partitionBy("number", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(order))
    rows = rows.join(_ahead(rows.groupBy("number", "cell").agg(F.sum("size").alias("words"))), ["number", "cell"])
    rows = rows.select("doc_id", "h", "size", "number", (F.col("ahead") + F.col("upto") - F.col("size")).alias("start"))
    rows = written(rows, "rows")

    drawn = rows.where("size > 0").join(near(quotas), "number").select(F.struct("doc_id", "h").alias("doc"), "number", "start", "size", "n", "draws", "last")
    spans = drawn.mapInArrow(_spans(BLOCK, most, seed), "doc struct<doc_id: long, h: long>, number long, start long, draw long, first_word long, n_words long")
    # a leaf holds about draws / shards of a source; chunks of that width meet about two leaves
    width = near(quotas.select("number", F.greatest(F.expr(f"draws div {shards}"), F.lit(1)).alias("width")))
    held = leaves(quotas, shards, total, seed).join(width, "number")
    held = held.select("number", "shard", "first", "count", F.explode(F.sequence(F.expr("first div width"), F.expr("(first + count - 1) div width"))).alias("chunk"))
    spans = spans.join(width, "number").withColumn("chunk", F.expr("draw div width")).drop("width")
    spans = spans.join(held, ["number", "chunk"]).where("draw >= first and draw < first + count")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "number", "draw"), "number", "draw", "start")
    spans = spans.select("shard", F.row_number().over(local).alias("place"), "doc", "number", "start", "draw", "first_word", "n_words")
    return spans, rows.join(near(aimed.select("number", F.col("words").alias("source_size"), "target")), "number")


def digest(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of its pieces in the mix) for every row of docs."""
    spans, rows = mixed(docs, **settings)
    taken = spans.groupBy("number", "start").agg(F.sum("n_words").alias("taken"))
    empty = F.col("size") == 0                           # shares its place with the next document
    held = rows.where(~empty).join(taken, ["number", "start"], "left").unionByName(rows.where(empty).withColumn("taken", F.lit(0).cast("long")))
    return held.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with docs(doc_id, text) -> shard, place, text: the pieces themselves, from their first to their last word."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            out = []
            for i, (first, n) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                text = data[offsets[i]:offsets[i + 1]]
                starts, ends, _ = word_bounds(text, np.array([0, len(text)]), SPACES)
                out.append(text[starts[first]:ends[first + n - 1]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["shard", "place", "text"])

    def key(d: Column) -> Column:
        return F.struct(d["doc_id"].cast("long").alias("doc_id"), F.xxhash64(d["doc_id"], d["text"]).alias("h"))

    held = docs.select(key(docs).alias("doc"), "text").dropDuplicates(["doc"])
    same = spans["doc"].eqNullSafe(held["doc"])
    return spans.join(held, same).select("shard", "place", "text", "first_word", "n_words").mapInArrow(cut, "shard long, place int, text string")
