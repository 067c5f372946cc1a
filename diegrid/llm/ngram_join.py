"""Jaccard self-join of documents on word n-grams by token-combination prefixes.

Tokens are the hashed n-grams of a document, each document a set of them. Two sets that link share
all but a few tokens, so under one global order of tokens they share one among the first few of both
(prefix filter). The order puts frequent tokens last. Rare tokens of the prefix are indexed singly.
Where a prefix reaches into the frequent class, it is extended and pairs of neighbouring tokens are
indexed instead of single ones:

* D tokens at most lie in only one of two linking sets of sizes a <= b: D <= (1 - t) / t * a;
* between the first D + 2 common tokens there are D + 1 gaps, and each differing token falls into
  one gap at most, so in one gap there is none: these two common tokens are neighbours in both sets;
* at most n - ceil(t * n) tokens of a set of n are not common, so all of this happens within the first
  D + 2 + n - ceil(t * n) tokens.

Where the first n - ceil(t * n) + l tokens of a set are all rare, it shares the l first common tokens with any
set that it links with, and candidates have to share that many entries.

Tokens are counted by slot, over all documents, in the same pass that takes the identity of every set:
the frequent class is all tokens of the fuller slots. No link is lost for any choice of this class, which
only steers the cost. Equal sets collapse to one before the index is built. Index buckets of up to
`BUCKET` sets make pairs, larger ones are groups named by their smallest id.

Every set has a sketch: one bit for each slot of its tokens, set where their number is odd. Two sketches
differ in no more bits than their sets in tokens, so the sketches of a link differ in few. Pairs and groups
are held against this bound; of a group, what leaves the task is a forest that connects the pairs within it.
Every link lies in one component of these edges, a bundle. Documents that share a passage and little
else are not drawn together by it. The whole sets of a bundle are verified in blocks, of which a forest of links
leaves a task, so no pair of a large group of near copies is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diegrid.llm.store import text_batches, written
from diegrid.llm.words import SPACES, mix, shingle_sets
from diegrid.operators.components import connected_nodes

BUCKET = 32              # all pairs are compared in buckets up to this size
SLOT_BITS = 22           # tokens are counted by their leading bits; the frequent slots are broadcast (4 MB)
SLOTS, STRIPE = 1 << SLOT_BITS, 1 << 14
HEAVY_LEAST = 32         # a frequent slot has more tokens than that,
HEAVY_LOADS = 8          # and than so many times the mean of all slots
BLOCK = 1024             # sets of a block
MASS = 1 << 22           # and tokens of a block, about
LOT = 256                # sets of small groups that share a task's turn
SKETCH_BITS = 1 << 16    # widest sketch, of sets beyond 32,768 tokens: looser there, and still a bound
PAIRED = 64              # in a block, tokens of up to so many sets are counted pair by pair, others by matrix products
SHARE = 24               # 1 + n // SHARE common tokens are asked for
IDS = 1 << 20            # most places (lot, blocks, id) that are broadcast (about 64 MB) to read their texts; more are joined by a shuffle


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _ceil_share(n, num: int, den: int):
    return (n * num + den - 1) // den


def _asked(n: int, num: int, den: int) -> int:
    """Entries that a linking set shares at least, where its prefix is rare."""
    return min(1 + n // SHARE, _ceil_share(n, num, den))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(docs: DataFrame, width: int, kind: np.ndarray, emit, schema: str) -> DataFrame:
    """docs(id, text) -> rows that `emit(ids, sets)` makes of every batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield emit(part.column(0), list(shingle_sets(part.column(1), width, kind)))

    return docs.mapInArrow(run, schema)


def _digest(docs: DataFrame, width: int, kind: np.ndarray) -> DataFrame:
    """docs(id, text) -> one row for each row: size and 128-bit identity of its set; and each task's counts of
    tokens by slot, in rows of `STRIPE` slots that carry their number as `stripe`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = list(shingle_sets(part.column(1), width, kind))
                np.add.at(load, _slot(np.concatenate(sets)), 1)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else 0 for s in sets], np.uint64)
                h2 = np.array([np.add.reduce(mix(s ^ np.uint64(0x5DEECE66D))) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                                                  pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        for at in range(0, SLOTS, STRIPE):
            if load[at:at + STRIPE].any():
                void = [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*void, pa.array([at // STRIPE], pa.int32()), pa.array([load[at:at + STRIPE].tobytes()], pa.binary())], names)

    names = ["id", "n", "h1", "h2", "stripe", "load"]
    return docs.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, stripe int, load binary")


def _frequent_slots(loads: DataFrame, least: int) -> np.ndarray:
    """Which slots hold more than `least` tokens, from rows (stripe, load) of all tasks. `SLOTS` bits reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, load in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = total.setdefault(stripe, np.zeros(STRIPE, np.int64))
                held += np.frombuffer(load.as_buffer(), np.uint32)
        rows = [(stripe, np.packbits(load > least).tobytes()) for stripe, load in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["stripe", "bits"])

    out = np.zeros(SLOTS, bool)
    for row in loads.repartition("stripe").mapInArrow(run, "stripe int, bits binary").collect():
        out[row["stripe"] * STRIPE:(row["stripe"] + 1) * STRIPE] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
    return out


def _signatures(num: int, den: int, heavy):
    """Index entries of every set: single rare tokens, or neighbouring pairs where the prefix is frequent."""
    def one(s: np.ndarray) -> tuple[bool, np.ndarray]:
        n, common = len(s), heavy.value
        spread = n * (den - num) // num                                     # D: 0 means that only equal sets link
        if not spread:
            return True, np.zeros(0, np.uint64)
        frequent = common[_slot(s)]
        light, free = s[~frequent], n - _ceil_share(n, num, den)
        rare = light[:free + _asked(n, num, den)]
        if len(light) > free:
            return len(rare) == free + _asked(n, num, den), rare
        order = np.concatenate([light, s[frequent]])[:spread + 2 + free]
        return False, np.concatenate([light, mix(order[:-1] * np.uint64(3) + mix(order[1:]))])

    def emit(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        pure, sigs = zip(*map(one, sets)) if sets else ((), ())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(pure, pa.bool_()), _lists(list(sigs)),
                                           pa.array([_sketch(s) for s in sets], pa.binary())], ["id", "n", "pure", "sigs", "sketch"])
    return emit


def _sketch(s: np.ndarray) -> bytes:
    """A power of two of bits, at least two for each token: the parity of the tokens that fall on each."""
    width = min(SKETCH_BITS, 1 << max(9, (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _words(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of `width` bytes or more, wider ones folded to it, as rows of 64-bit words."""
    out = np.empty((len(sketches), width // 8), np.uint64)
    for i, sketch in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, width // 8), axis=0)
    return out


def _most_apart(x, y, num: int, den: int):
    """Tokens that lie in only one of two linking sets of sizes x and y, at most."""
    return x + y - 2 * _ceil_share(x + y, num, num + den)


def _forest(n: int, meetings: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges that connect what all edges (i, each of js) connect, fewer than n."""
    label, kept = np.arange(n), []
    for i, js in meetings:
        js = js[label[js] != label[i]]
        if len(js):
            others, at = np.unique(label[js], return_index=True)
            kept += [(i, int(j)) for j in js[at]]
            label[np.isin(label, others)] = label[i]
    return kept


def _near(num: int, den: int):
    """Sizes na, nb that can reach the threshold at all."""
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.col("a") != F.col("b"))


def _enough(entries, num: int, den: int):
    """Whether a pair of sizes na, nb with rare prefixes pa, pb shares as many entries as a link has to."""
    least = F.least(F.expr(f"1 + least(na, nb) div {SHARE}"), F.expr(f"(least(na, nb) * {num} + {den - 1}) div {den}"))
    return (entries >= least) | ~(F.col("pa") | F.col("pb"))


def _met(rows: DataFrame, on: str) -> DataFrame:
    """Both members' columns for all pairs a < b of one list of members."""
    x = rows.select(F.explode(on).alias("x"), on).select("x", F.explode(on).alias("y")).where("x.id < y.id")
    return x.select(*[F.col(f"{m}.{c}").alias(name) for m, c, name in (("x", "id", "a"), ("y", "id", "b"), ("x", "n", "na"), ("y", "n", "nb"), ("x", "pure", "pa"), ("y", "pure", "pb"))])


def _block_links(num: int, den: int):
    """Links between two blocks of sets, or within one, by the common tokens of all pairs."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        tokens = table["tokens"].combine_chunks()
        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        sizes = tokens.value_lengths().to_numpy().astype(np.int64)
        _, column, times = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(column, kind="stable")
        order = order[times[column[order]] > 1]
        column, row = column[order], row[order]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        place = np.zeros(len(ids), np.int64)
        place[left] = np.arange(len(left))
        place[right] = np.arange(len(right))
        common = np.zeros((len(left), len(right)), np.float32)
        few = times[column] <= PAIRED
        c, r = column[few], row[few]
        for step in range(1, PAIRED):                       # tokens of few sets: their pairs, counted at once
            at = np.flatnonzero(c[step:] == c[:-step])
            if not len(at):
                break
            for x, y in ((r[at], r[at + step]), (r[at + step], r[at])):
                meet = (block[x] == lo) & (block[y] == hi)
                np.add.at(common, (place[x[meet]], place[y[meet]]), 1)
        column, row = np.unique(column[~few], return_inverse=True)[1], row[~few]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):     # the others: products of incidence matrices
            cut = slice(*np.searchsorted(column, [first, first + 8192]))
            both = []
            for side, number in ((left, lo), (right, hi)):
                m, at = np.zeros((len(side), 8192), np.float32), block[row[cut]] == number
                m[place[row[cut][at]], column[cut][at] - first] = 1
                both.append(m)
            common += both[0] @ both[1].T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        x, y = np.nonzero((common * den >= union * num) & (ids[left][:, None] != ids[right][None, :]))
        return pa.table({"a": ids[left][x], "b": ids[right][y]})
    return run


EDGES = "a bigint, b bigint"


def _edges(ids: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    x, y = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.table({"a": ids[x], "b": ids[y]})


def _sketch_forest(num: int, den: int):
    """Edges that connect the sets of a group, or of two blocks of it, whose sketches are close enough for a link."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        ids, n, raw = table["id"].to_numpy(), table["n"].to_numpy(), table["sketch"].to_pylist()
        width = np.array([len(x) for x in raw], np.int64)
        pairs: list[tuple[int, int]] = []
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            wider = np.flatnonzero((width > w) & (n * num <= n[own].max() * den))
            rows = np.concatenate([own, wider])            # sizes rise with the width, so rows stay in order of size
            m = _words([raw[i] for i in rows], int(w))
            size = n[rows]
            last = np.searchsorted(size, size * den // num, side="right")

            def close() -> Iterator[tuple[int, np.ndarray]]:
                for i in range(len(own)):
                    j = np.arange(i + 1, last[i])
                    if len(j):
                        apart = np.bitwise_count(m[i + 1:last[i]] ^ m[i]).sum(axis=1, dtype=np.int64)
                        yield i, j[apart <= _most_apart(size[i], size[j], num, den)]

            pairs += [(int(rows[x]), int(rows[y])) for x, y in _forest(len(rows), close())]
        return _edges(ids, [(x, y) for x, y in pairs if ids[x] != ids[y]])
    return run


def _close_pairs(num: int, den: int):
    """Of pairs with sketches, those close enough for a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            most = _most_apart(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), num, den)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = x.as_py(), y.as_py()
                x, y = _words([x, y], min(len(x), len(y)))
                keep[i] = np.bitwise_count(x ^ y).sum() <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _link_forest(width: int, kind: np.ndarray, num: int, den: int):
    """Edges that connect what the links of a group, or between two blocks of it, connect; whole texts are read."""
    links = _block_links(num, den)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tokens = [x for batch in table.combine_chunks().to_batches() for x in shingle_sets(batch.column("text"), width, kind)]
        found = links(key, pa.table({"id": table["id"], "block": table["block"], "tokens": _lists(tokens)}))
        ids, at = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
        x, y = at.reshape(2, -1)
        order = np.argsort(x, kind="stable")
        first, cuts = np.unique(x[order], return_index=True)
        return _edges(ids, _forest(len(ids), zip(first.tolist(), np.split(y[order], cuts[1:]))))
    return run


def _dealt(groups: DataFrame, name: str) -> DataFrame:
    """groups(root, id, n) -> (lot, lo, hi, block, id), the comparisons that cover all pairs of each group.

    A group is dealt to blocks of about `BLOCK` sets and `MASS` tokens, each two of which meet once. Groups of one
    block share lots by hash, about `LOT` sets in each."""
    sized = groups.groupBy("root").agg(F.expr(f"greatest((count(*) + {BLOCK - 1}) div {BLOCK}, (sum(n) + {MASS - 1}) div {MASS})").alias("blocks"), F.count("*").alias("c"), F.sum("n").alias("mass"))
    sized = written(sized, name)
    c, mass = sized.where("blocks = 1").agg(F.sum("c"), F.sum("mass")).first()
    lots = max((c or 0) // LOT, (mass or 0) // (MASS // 4)) + 1
    lot = F.when(F.col("blocks") == 1, F.concat(F.lit("lot"), F.pmod(F.xxhash64("root"), F.lit(lots)))).otherwise(F.concat(F.lit("group"), "root"))
    placed = groups.join(sized.drop("c", "mass"), "root").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    return (placed.select(lot.alias("lot"), "id", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
            .select("lot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id").distinct())


def _bundles(signs: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """(root, id, n): groups that hold every link, from index entries (id, n, pure, sig, c) and sketches of all sets."""
    large = shared.where(F.col("c") > BUCKET)
    crowded = written(large.groupBy("id").agg(F.count("*").alias("entries")), "crowded")
    few = _met(shared.where(F.col("c") <= BUCKET).groupBy("sig").agg(F.collect_list(F.struct("id", "n", "pure")).alias("m")), "m").where(_near(num, den))
    few = written(few.groupBy("a", "b", "na", "nb", "pa", "pb").agg(F.count("*").alias("entries")), "few")
    more = few.join(crowded.select(F.col("id").alias("a"), F.col("entries").alias("ma")), "a", "left").join(crowded.select(F.col("id").alias("b"), F.col("entries").alias("mb")), "b", "left")
    likely = more.where(_enough(F.col("entries") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))), num, den)).select("a", "b", "na", "nb")
    likely = likely.join(signs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), ["a", "na"])
    likely = likely.join(signs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), ["b", "nb"])
    pairs = likely.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_close_pairs(num, den), EDGES)

    low = large.groupBy("sig").agg(F.min("id").alias("root"))
    groups = written(large.join(low, "sig").select("root", "id", "n").distinct(), "groups")
    rows = _dealt(groups, "group_sizes").join(signs.select("id", "n", "sketch"), "id")
    near = rows.select("lot", "lo", "hi", "id", "n", "sketch").groupBy("lot", "lo", "hi").applyInArrow(_sketch_forest(num, den), EDGES)
    with text_batches(signs.sparkSession):
        edges = written(pairs.union(near).distinct(), "edges")
    nodes = connected_nodes(edges).withColumnRenamed("node", "id")
    return written(nodes.join(signs.groupBy("id").agg(F.sum("n").alias("n")), "id"), "bundles")


def _links(docs: DataFrame, bundles: DataFrame, width: int, kind: np.ndarray, num: int, den: int) -> DataFrame:
    dealt = written(_dealt(bundles, "bundle_sizes"), "dealt")
    wanted = F.broadcast(dealt) if dealt.count() <= IDS else dealt
    return docs.join(wanted, "id").groupBy("lot", "lo", "hi").applyInArrow(_link_forest(width, kind, num, den), EDGES)


def components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, kind: np.ndarray = SPACES) -> DataFrame:
    """docs(id BIGINT, text) -> one row for each row of docs: id, n (distinct shingles), root.

    Two documents link when den * |common| >= num * |union|; root is the smallest id that links reach.
    Text that is null or has no words has n = 0 and links with nothing. Fewer words than `width` make
    one shingle. Rows that repeat an id count as one document for links and keep a row each; rows
    without id have no root. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("id", "text")
    with text_batches(spark):
        scanned = written(_digest(docs, width, kind), "digest")
    digest = scanned.where("stripe is null").select("id", "n", "h1", "h2")
    least = max(HEAVY_LEAST, HEAVY_LOADS * (digest.agg(F.sum("n")).first()[0] or 0) // SLOTS)
    heavy = spark.sparkContext.broadcast(_frequent_slots(scanned.where("stripe is not null").select("stripe", "load"), least))

    first = digest.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    first = written(first, "first")
    members = written(digest.select("id", "n", "h1", "h2").join(first, ["h1", "h2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), "members")
    several = members.where("rep is not null").groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top")
    same = members.join(several, "id").where("rep > b").select(F.col("rep").alias("a"), "b").distinct()
    signs = _sets(docs, width, kind, _signatures(num, den, heavy), "id bigint, n bigint, pure boolean, sigs array<bigint>, sketch binary")
    with text_batches(spark):
        signs = written(signs.join(first.select(F.col("rep").alias("id"), "n"), ["id", "n"], "left_semi"), "signs")
    index = signs.select("id", "n", "pure", F.explode("sigs").alias("sig"))
    shared = written(index.join(index.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "sig"), "shared")
    bundles = _bundles(signs, shared, num, den)
    with text_batches(spark):
        links = written(_links(docs, bundles, width, kind, num, den).union(same), "links")
    roots = connected_nodes(links)

    out = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("id", "n", F.coalesce("root", "rep", "id").alias("root"))
