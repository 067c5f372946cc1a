"""Collocations of two and three words by level-wise mining with double-array tries.

1. One pass counts words exactly. The frequent ones, sorted and cut into blocks of bounded size, become tries that are broadcast. 2. All word
positions of a text walk them at once, a byte a level; the state in which a word ends is its number. Texts are written once as numbers,
0 for words that are not frequent and between pieces: no phrase with such a word can be frequent. 3. Pairs of numbers are counted exactly; the
frequent ones set bits that are broadcast. 4. Triples whose two pairs have their bits are counted exactly. A triple is never more frequent than
its pairs, so no frequent phrase is lost; bits that pairs share cost rows, not results.

Counts travel as packed runs, sorted by a bijection of their numbers and dealt to parts of about a million words of text each, and are summed
a part at a time. The texts are read twice and their numbers twice (words of more than `tries` blocks: once more for each `tries`
blocks), whatever the number of candidates, so the time is in proportion to the texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diegrid.functions.prefix import dense_ids
from diegrid.llm.double_array import Trie, build
from diegrid.llm.store import text_batches, written
from diegrid.llm.words import LOWER, mix, runs_of_rows, utf8, word_bounds

PART = 20                                # a part has the phrases of about 2 ** PART words of text
ROW = 2_048                              # words of a text that a row of numbers begins; two more follow
HOT, SALTS = 4_096, 64                   # a phrase with more than 1 / HOT of all words is looked up under SALTS keys


@dataclass(frozen=True)
class Limits:
    """What tasks hold at once. Results do not depend on it."""

    slot_bits: int = 27                  # 2 ** 27 bits of frequent pairs: 16 MB, which are broadcast
    held: int = 1 << 22                  # phrases or words that a task holds before it gives them out or adds them up
    block: int = 1 << 18                 # words of a trie, 20 to 40 MB
    tries: int = 4                       # tries of one pass over the texts; more words take more passes
    run: int = 1 << 21                   # bytes of text at once, about; longer texts are cut at separators
    key_bits: int = 64                   # triples whose numbers have more bits have two keys


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~SEPARATOR
WORD[[0x20, 0x09]] = False
_PLAIN = bytes(0x0A if SEPARATOR[c] else 0x20 if c == 0x09 else int(LOWER[c]) for c in range(256))
_END = b"\xff"                           # stands in no UTF-8 text
_COUNTED = "part int, key binary, last binary, n binary"
_MIXED = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _Words:
    """The words of a run of texts: places, language and which follow one another within a piece."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.buf = buf
        self.starts, self.ends, first = word_bounds(buf, offsets, WORD)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.lang = langs[self.row]
        piece = np.searchsorted(np.flatnonzero(SEPARATOR[buf]), self.starts)
        self.joined = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])

def _pieces(data: np.ndarray, offsets: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long texts cut behind separators, and each part's text. Empty texts have no part."""
    cuts = [offsets]
    for i in np.flatnonzero(np.diff(offsets) > 2 * run):
        ends = np.flatnonzero(SEPARATOR[data[offsets[i]:offsets[i + 1]]]) + offsets[i] + 1
        cuts.append(ends[np.minimum(np.searchsorted(ends, np.arange(offsets[i] + run, offsets[i + 1], run)), len(ends) - 1)] if len(ends) else ends)
    parts = np.unique(np.concatenate(cuts))
    return parts, np.searchsorted(offsets, parts[:-1], side="right") - 1


def _runs_of_texts(batch: pa.RecordBatch, known: dict[str, int], run: int) -> Iterator[tuple[_Words, np.ndarray]]:
    """Words of the texts of a batch (lang, text, ..), some megabytes at a time; `known` numbers the languages. With the
    place in the batch of the text that each part of a run is of."""
    langs = batch.column(0).dictionary_encode()
    numbers = np.array([known.setdefault(x, len(known)) for x in langs.dictionary.to_pylist()] or [0], np.int64)[langs.indices.to_numpy()]
    data, offsets = utf8(batch.column(1))
    parts, text = _pieces(data, offsets, run)
    for i, j in runs_of_rows(parts, run):
        yield _Words(LOWER[data[parts[i]:parts[j]]], parts[i:j + 1] - parts[i], numbers[text[i:j]]), text[i:j]


def _runs(batch: pa.RecordBatch, known: dict[str, int], run: int) -> Iterator[_Words]:
    for words, _ in _runs_of_texts(batch, known, run):
        yield words


def _unmixed(x: np.ndarray) -> np.ndarray:
    """What `mix` made these words of."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(_MIXED[1], -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(_MIXED[0], -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _count_words(lim: Limits):
    """Exact counts of words, and the number of words (word null) of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, totals = {}, defaultdict(Counter), Counter()

        def given() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())], ["lang", "word", "f"])
            counts.clear()

        for batch in batches:
            for words in _runs(batch, known, lim.run):
                names = list(known)
                data, cuts = words.buf.tobytes(), np.flatnonzero(np.diff(words.row)) + 1
                for i, j in zip([0, *cuts], [*cuts, len(words.row)]):
                    if j > i:
                        found = data[words.starts[i]:words.ends[j - 1]].translate(_PLAIN).split()
                        lang = names[words.lang[i]]
                        counts[lang].update(found)
                        totals[lang] += len(found)
                if sum(map(len, counts.values())) > lim.held // 8:
                    yield from given()
        yield from given()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals.values(), pa.int64())], ["lang", "word", "f"])
    return run


def _trie(key: tuple, rows: pa.Table) -> pa.Table:
    keys = rows.sort_by("at")["key"].to_pylist()
    trie, ends = build(keys)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "trie": pa.array([trie.tobytes()], pa.binary()), "ends": pa.array([ends.astype(np.int32).tobytes()], pa.binary())})


def _numbers(words: _Words, known: dict[str, int], tries: list[tuple[Trie, np.ndarray]]) -> np.ndarray:
    """The number of each word that is in a trie, 0 of others; all positions walk a trie at once."""
    out = np.zeros(len(words.starts), np.int32)
    for trie, number in tries:
        roots = np.array([trie.walk(x.encode() + _END) for x in known], np.int64)
        who = np.flatnonzero(roots[words.lang] >= 0)
        state, pos, end = roots[words.lang[who]], words.starts[who], words.ends[who]
        while len(who):
            state = trie.step(state, words.buf[pos])
            pos = pos + 1
            alive = state >= 0
            if not alive.all():
                state, pos, who, end = state[alive], pos[alive], who[alive], end[alive]
            ended = pos == end
            if ended.any():
                out[who[ended]] = np.maximum(out[who[ended]], number[state[ended]])     # a word of one trie can begin one of the next
                go = ~ended
                state, pos, who, end = state[go], pos[go], who[go], end[go]
    return out


def _packed(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of these numbers of bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(data)]).cast(pa.binary())


def _left(words: _Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words, each with a separator behind it, and how many each word has."""
    sizes = words.ends[some] - words.starts[some] + 1
    behind = np.cumsum(sizes)
    out = words.buf[np.minimum(np.arange(sizes.sum()) + np.repeat(words.starts[some] - behind + sizes, sizes), max(len(words.buf) - 1, 0))]
    out[behind - 1] = 0x0A
    return out, sizes


def _encode(lim: Limits, tries: list[tuple[int, object, object]], last: bool):
    """Texts (lang, text, ids) as numbers of words, each piece with a 0 behind it: rows of bounded length in the last pass over all
    tries. Passes before it give the numbers so far, -1 for words that have none yet, and as text what these words are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for block, data, ends in tries:
            trie, ends = Trie.frombytes(data.value), np.frombuffer(ends.value, np.int32)
            number = np.zeros(len(trie.base), np.int32)
            number[ends] = block * lim.block + np.arange(len(ends)) + 1
            held.append((trie, number))
        known: dict[str, int] = {}

        def rows(ids: np.ndarray) -> pa.RecordBatch:
            ids = np.maximum(ids, 0)
            return pa.RecordBatch.from_arrays([pa.array([ids[i:i + ROW + 2].tobytes() for i in range(0, len(ids), ROW)], pa.binary())], ["ids"])

        for batch in batches:
            again = batch.column(2).null_count == 0      # the numbers of a pass before
            before = [x or b"" for x in batch.column(2).to_pylist()]
            sizes, left_sizes = np.array([len(x) for x in before], np.int64), np.zeros(batch.num_rows, np.int64)
            before = np.frombuffer(b"".join(before), np.int32).copy()
            open_, at, parts, left = np.flatnonzero(before < 0), 0, [], []
            for words, texts in _runs_of_texts(batch, known, lim.run):
                n, numbers = len(words.starts), _numbers(words, known, held)
                numbers[numbers == 0] = -1
                if again:
                    before[open_[at:at + n]] = numbers
                    at += n
                else:
                    place = np.arange(n)
                    place[1:] += np.cumsum(~words.joined)
                    ids = np.zeros(int(place[-1]) + 2 if n else 0, np.int32)
                    ids[place] = numbers
                    if last:
                        yield rows(ids)
                        continue
                    parts.append(ids)
                    closed = np.append(~words.joined, True) if n else np.zeros(0, bool)
                    sizes += 4 * (np.bincount(texts[words.row], minlength=len(sizes)) + np.bincount(texts[words.row[closed]], minlength=len(sizes)))
                if not last:
                    some = np.flatnonzero(numbers < 0)
                    data, lengths = _left(words, some)
                    left.append(data)
                    np.add.at(left_sizes, texts[words.row[some]], lengths)
            if not last:
                ids = before if again else np.concatenate([np.zeros(0, np.int32), *parts])
                text = _packed(np.concatenate([np.zeros(0, np.uint8), *left]), left_sizes).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), text, _packed(ids, sizes)], ["lang", "text", "ids"])
            elif again:
                yield rows(before)
    return run


def _tallied(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if n is None and len(keys) == 1:
        keys = [np.sort(keys[0])]
    else:
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        keys, n = [k[order] for k in keys], None if n is None else n[order]
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.diff(np.append(first, len(new))) if n is None else np.add.reduceat(n, first) if len(first) else n


def _bit(key: np.ndarray, slot_bits: int) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - slot_bits)).astype(np.int64)


def _phrases(lim: Limits, bits: int, part_bits: int, pairs_: object | None):
    """Counts of all pairs of numbers, or with the bits of frequent pairs of all triples whose pairs have them, as packed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            keys, n = _tallied([np.concatenate([w[i] for w in waiting]) for i in range(len(waiting[0]))])
            part = (keys[0] >> np.uint64(63 - part_bits)) >> np.uint64(1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
            last, n = keys[1] if len(keys) > 1 else None, n.astype(np.uint32)
            spans = list(zip(cuts, cuts[1:]))
            for at in range(0, len(spans), 1_024):
                some = spans[at:at + 1_024]
                yield pa.RecordBatch.from_arrays([pa.array(part[[i for i, _ in some]].astype(np.int32)), pa.array([keys[0][i:j].tobytes() for i, j in some], pa.binary()),
                                                  pa.array([None if last is None else last[i:j].tobytes() for i, j in some], pa.binary()), pa.array([n[i:j].tobytes() for i, j in some], pa.binary())], ["part", "key", "last", "n"])

        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] // 4
            ids = np.frombuffer(column.buffers()[2] or b"", np.int32)[offsets[0]:offsets[-1]].astype(np.uint64)
            offsets = offsets - offsets[0]
            inside = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets)) < ROW
            follows = np.ones(len(ids), bool)            # whether the next number is of the same row
            follows[offsets[1:][np.diff(offsets) > 0] - 1] = False
            some = ids > 0
            two = np.flatnonzero(some[:-1] & some[1:] & follows[:-1])
            pair = ids[two] << np.uint64(bits) | ids[two + 1]
            if pairs_ is None:
                keys = [mix(pair[inside[two]])]
            else:
                slots = _bit(pair, lim.slot_bits)
                often = (pairs_.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
                kept = np.zeros(len(ids) + 1, bool)
                kept[two[often]] = True
                three = np.flatnonzero(kept[:-1] & kept[1:] & inside)
                pair, third = ids[three] << np.uint64(bits) | ids[three + 1], ids[three + 2]
                keys = [mix(pair << np.uint64(bits) | third)] if 3 * bits <= lim.key_bits else [mix(pair), third.astype(np.uint32)]
            waiting.append(keys)
            size += len(keys[0])
            if size > lim.held:
                yield from given()
                waiting, size = [], 0
        if size:
            yield from given()
    return run


def _frequent(rows: DataFrame, least: int, lim: Limits, bits: int, width: int) -> DataFrame:
    """Sums packed runs in a stream of each part's rows -> frequent phrases as numbers w1 to w`width`, and f."""
    names = [f"w{i + 1}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def summed() -> tuple[list[np.ndarray], np.ndarray]:
            columns = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
            return _tallied(columns[:-1], columns[-1])

        def result() -> pa.RecordBatch:
            keys, n = summed()
            often = n >= least
            key, mask = _unmixed(keys[0][often]), np.uint64((1 << bits) - 1)
            ids = [keys[1][often]] if len(keys) > 1 else []
            while len(ids) < width:
                ids.insert(0, key & mask)
                key = key >> np.uint64(bits)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*ids, n[often])], [*names, "f"])

        for batch in batches:
            for part, *packed in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
                if part != now and held:
                    yield result()
                    held, size = [], 0
                now = part
                key, last, n = (np.frombuffer(x.as_buffer(), kind) if x.is_valid else None for x, kind in zip(packed, (np.uint64, np.uint32, np.uint32)))
                held.append([key, *([] if last is None else [last]), n.astype(np.int64)])
                size += len(key)
                if size > lim.held and len(held) > 1:
                    keys, n = summed()
                    held, size = [[*keys, n]], len(n) // 2      # merged again when as many have come
        if held:
            yield result()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "f"]))


def _pair_bits(pairs: DataFrame, lim: Limits, bits: int) -> np.ndarray:
    """Bits of the frequent pairs; four bytes of each pair reach the driver, some at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_numpy().astype(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([_bit(one << np.uint64(bits) | two, lim.slot_bits).astype(np.int32).tobytes()], pa.binary())], ["slots"])

    out = np.zeros(1 << (lim.slot_bits - 3), np.uint8)
    for r in pairs.select("w1", "w2").mapInArrow(run, "slots binary").toLocalIterator():
        slots = np.frombuffer(r["slots"], np.int32)
        np.bitwise_or.at(out, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))
    return out


def _key(lang: str, phrase: str) -> Column:
    return F.concat(F.encode(lang, "UTF-8"), F.lit(_END), F.encode(phrase, "UTF-8"))


def supports(docs: DataFrame, least: int = 10, width: int = 3, lim: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """docs(lang, text) -> frequent phrases (lang, phrase, size, f) of 1 to `width` words (2 or 3), and (lang, n)."""
    with text_batches(docs.sparkSession):
        return _mined(docs, least, width, lim)


def _mined(docs: DataFrame, least: int, width: int, lim: Limits) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    counts = docs.mapInArrow(_count_words(lim), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counts = written(counts.where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    listed = counts.where("word is not null").withColumn("key", _key("lang", "word"))
    listed = written(listed.join(dense_ids(listed, "key", "at"), "key").select("lang", "word", "f", "key", "at"), "numbered")
    n, total = listed.count(), counts.where("word is null").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    bits, part_bits = max(1, n.bit_length()), max(6, (total >> PART).bit_length())
    made = written(listed.select(F.expr(f"at div {lim.block}").alias("block"), "at", "key").groupBy("block").applyInArrow(_trie, "block long, trie binary, ends binary"), "tries")
    texts = docs.withColumn("ids", F.lit(None).cast("binary"))
    for at in range(0, max(1, -(-n // lim.block)), lim.tries):       # one pass over the texts for each `tries` blocks of words
        tries = []
        for r in made.where(F.col("block").between(at, at + lim.tries - 1)).orderBy("block").toLocalIterator():
            tries.append((r["block"], spark.sparkContext.broadcast(bytes(r["trie"])), spark.sparkContext.broadcast(bytes(r["ends"]))))
        last = (at + lim.tries) * lim.block >= n
        texts = written(texts.mapInArrow(_encode(lim, tries, last), "ids binary" if last else "lang string, text string, ids binary"), "numbers")
        for _, *held in tries:
            for b in held:
                b.unpersist()
    found = [written(_frequent(texts.mapInArrow(_phrases(lim, bits, part_bits, None), _COUNTED), least, lim, bits, 2), "pairs")]
    if width > 2:
        shared = spark.sparkContext.broadcast(_pair_bits(found[0], lim, bits))
        found.append(written(_frequent(texts.mapInArrow(_phrases(lim, bits, part_bits, shared), _COUNTED), least, lim, bits, 3), "triples"))
        shared.unpersist()
    word = listed.select((F.col("at") + 1).alias("w"), "lang", "word")
    frequent = [listed.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")]
    for size, rows in enumerate(found, 2):
        for i in range(1, size + 1):
            rows = rows.join(word.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"t{i}"), *(["lang"] if i == 1 else [])), f"w{i}")
        frequent.append(rows.select("lang", F.concat_ws(" ", *[f"t{i}" for i in range(1, size + 1)]).alias("phrase"), F.lit(size).alias("size"), "f"))
    return written(reduce(DataFrame.union, frequent), "frequent"), counts.where("word is null").select("lang", F.col("f").alias("n"))


def _looked_up(cuts: DataFrame, frequent: DataFrame, part: str, name: str, total: int) -> DataFrame:
    """Joins the support of a part; very frequent parts stand in many phrases, so they are dealt over SALTS keys."""
    hot = F.col("f") * HOT >= total                      # at most HOT x width phrases
    keys = frequent.where(hot).select("lang", F.col("phrase").alias(part), F.lit(True).alias("hot"))
    salted = cuts.join(F.broadcast(keys), ["lang", part], "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hot")
    held = frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name), F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(held, ["lang", part, "salt"]).drop("salt")


def collocations(docs: DataFrame, least: int = 10, top: int = 2_000, share: int = 50, width: int = 3, lim: Limits = Limits()) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score: for each language its first `top` phrases of 2 to
    `width` words (at most 3) that occur at least `least` times, by the lowest score floor(10^6 a^2 / (l r)) of their cuts.

    A phrase inside a longer candidate that occurs in at least `share` percent of its places is left out. A null
    language is `und`, a null text is empty; repeated rows count each time; words hold any bytes but blanks and separators.
    An empty table gives no rows. Products are decimals of up to 38 digits: exact for counts below 10^14."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    frequent, totals = supports(rows, least, width, lim)
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    longer = frequent.where("size > 1")
    parts = F.split("phrase", " ")
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("left_part"),
        F.array_join(F.slice(parts, k + 1, F.col("size")), " ").alias("right_part")))
    cuts = longer.select("lang", "phrase", "size", F.col("f").alias("a"), F.inline(cut))
    cuts = _looked_up(_looked_up(cuts, frequent, "left_part", "l", total), frequent, "right_part", "r", total)
    score = F.expr("(CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score"))
    inner = longer.where("size = 3").select("lang", F.col("f").alias("most"), F.explode(F.array(
        F.array_join(F.slice(parts, 1, 2), " "), F.array_join(F.slice(parts, 2, 2), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {share} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)       # a language can hold nearly all rows
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
