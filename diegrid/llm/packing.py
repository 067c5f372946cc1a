"""Best-fit packing of token sequences, improved by swap-based local search.

Pieces are dealt by hash to blocks of about `BLOCK` pieces, each packed in one task: best fit by falling
length, then local search between underfull bins. Every underfull bin, the emptiest first, gives one or two
documents to any other one for none, one or two of its, always by the exchange that raises the sum of squared
fills most. The search ends when a pass over all bins finds no such exchange: squares are whole numbers and
bounded, so it does. Bins at most `POOLED` full are pooled over all blocks and packed again, until one block
holds the pool or the pool no longer shrinks by a quarter.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diegrid.llm.store import written
from diegrid.llm.tokens import word_encoder

BLOCK = 16_000           # pieces packed by one task
POOLED = 15 / 16         # share of a bin


class Packer:
    """Bins of one block; `docs[b]` are indices of pieces, `left[b]` the free room of bin b."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = [int(x) for x in lengths], size
        self.docs: list[list[int]] = []
        self.left: list[int] = []
        rooms: list[list[int]] = [[] for _ in range(size + 1)]
        free = 0                                                   # bit r: a bin has room r
        for d in sorted(range(len(self.lengths)), key=lambda d: -self.lengths[d]):
            need = self.lengths[d]
            above = free >> need
            if above:
                room = need + (above & -above).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    free ^= 1 << room
                self.docs[b].append(d)
            else:
                b, room = len(self.docs), size
                self.docs.append([d])
                self.left.append(size)
            self.left[b] = room - need
            rooms[room - need].append(b)
            free |= 1 << (room - need)

    def search(self) -> None:
        """Exchanges between underfull bins, the emptiest giving first, until a pass over all of them finds none
        that raises the sum of squared fills or the fewest possible bins are left."""
        fewest = -(-sum(self.lengths) // self.size)
        used = sum(1 for ds in self.docs if ds)
        if used <= fewest:
            return
        self.held, self.room, self.bin, self.kind = (np.zeros(1 << 10, t) for t in (np.int64, np.int64, np.int32, np.int8))
        self.end, self.slots = 0, {}
        for b in self._underfull():
            self._enter(b)
        moved = True
        while moved and used > fewest:
            moved = False
            for a in self._underfull():
                while self.docs[a] and self.left[a] and self._give(a):
                    moved = True
                if not self.docs[a]:
                    used -= 1
                    if used <= fewest:
                        return

    def _underfull(self) -> list[int]:
        """The emptiest first."""
        return sorted((b for b in range(len(self.docs)) if self.left[b] > 0 and self.docs[b]), key=lambda b: (-self.left[b], b))

    def _enter(self, b: int) -> None:
        """Rows of what bin b can hand back for a document: nothing, one or two of its own, by total length."""
        ls = sorted({self.lengths[d] for d in self.docs[b]})
        rows = [(0, 0), *((x, 1) for x in ls), *((s, 2) for s in {self.lengths[d] + self.lengths[e] for i, d in enumerate(self.docs[b]) for e in self.docs[b][:i]} if s < self.size)]
        if self.end + len(rows) > len(self.held):
            self._compact(len(rows))
        at = self.slots[b] = slice(self.end, self.end + len(rows))
        self.held[at], self.kind[at] = zip(*rows)
        self.room[at], self.bin[at], self.end = self.left[b], b, at.stop

    def _leave(self, b: int) -> None:
        self.room[self.slots.pop(b)] = -1

    def _compact(self, more: int) -> None:
        """Drops rows of bins that have left, and doubles the columns where that gains too little."""
        live = np.flatnonzero(self.room[:self.end] >= 0)
        size = max(len(self.held), 2 * (len(live) + more))
        self.held, self.room, self.bin, self.kind = (np.concatenate([x[live], np.zeros(size - len(live), x.dtype)]) for x in (self.held, self.room, self.bin, self.kind))
        self.end, at = len(live), 0
        for b, n in sorted(((b, x.stop - x.start) for b, x in self.slots.items()), key=lambda p: self.slots[p[0]].start):
            self.slots[b] = slice(at, at + n)
            at += n

    def _give(self, a: int) -> bool:
        """The exchange with any other underfull bin that raises the squares most: bin a gives one or two documents
        of total L for documents of total S of a bin with room r, where 0 < L - S <= r. The squares grow by
        twice (L - S) times what a's room exceeds the room left there by."""
        self._leave(a)
        held, room, kind = self.held[:self.end], self.room[:self.end], self.kind[:self.end]
        ds, most, chosen = self.docs[a], 0, None
        offers = {self.lengths[d]: (d,) for d in ds}
        offers = [*offers.items(), *{self.lengths[d] + self.lengths[e]: (d, e) for i, d in enumerate(ds) for e in ds[:i]}.items()]
        for length, mine in offers:
            moved = length - held
            after = room - moved                                       # room left there
            gain = np.where((moved > 0) & (after >= 0) & (room >= 0), moved * (self.left[a] - after), 0)
            if len(mine) == 2:
                gain[kind == 2] = 0
            i = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[i] > most:
                most, chosen = int(gain[i]), (mine, i, int(moved[i]))
        if chosen is None:
            self._enter(a)
            return False
        mine, i, moved = chosen
        b, own, s = int(self.bin[i]), self.docs[int(self.bin[i])], int(held[i])
        theirs: list[int] = []
        if kind[i] == 1:
            theirs = [next(d for d in own if self.lengths[d] == s)]
        elif kind[i] == 2:
            theirs = next([x, y] for j, x in enumerate(own) for y in own[:j] if self.lengths[x] + self.lengths[y] == s)
        self._leave(b)
        self.docs[a] = [d for d in ds if d not in mine] + theirs
        self.docs[b] = [d for d in own if d not in theirs] + list(mine)
        self.left[a] += moved
        self.left[b] -= moved
        if self.docs[a]:
            self._enter(a)
        if self.left[b]:
            self._enter(b)
        return True


def _pack_block(size: int, first: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, lengths = table["piece_id"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(ids, kind="stable")
        packer = Packer(lengths[order], size)
        packer.search()
        rows = [(ids[order[d]], packer.lengths[d], first + key[0].as_py(), b, sum(packer.lengths[x] for x in ds[:i]), size - packer.left[b])
                for b, ds in enumerate(packer.docs) for i, d in enumerate(ds)]
        columns = list(zip(*rows))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("piece_id", "length", "block", "bin", "offset", "fill"), columns)})
    return run


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """pieces(piece_id, length), ids unique, 1 <= length <= size -> piece_id, sequence_id, offset.

    Every piece is placed once, offsets in a sequence have no gaps. An empty table gives no rows.
    """
    full = pieces.where(F.col("length") == size).select("piece_id", (F.col("piece_id") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, first = pieces.where(F.col("length") < size).select("piece_id", "length"), [full], 0
    before = None
    for round_ in itertools.count():
        count = rest.count()
        if not count:
            break
        blocks = -(-count // BLOCK)
        packed = (rest.withColumn("block", F.pmod(F.xxhash64("piece_id", F.lit(round_)), F.lit(blocks))).groupBy("block")
                  .applyInArrow(_pack_block(size, first), "piece_id long, length long, block long, bin long, offset long, fill long"))
        packed = written(packed, "packed")
        last = blocks == 1 or before is not None and 4 * blocks > 3 * before
        done.append(packed.where("true" if last else f"fill > {int(size * POOLED)}")
                    .select("piece_id", ((F.col("block") * (1 << 24) + F.col("bin")) * 2).alias("sequence_id"), "offset"))
        if last:
            break
        rest, first, before = packed.where(f"fill <= {int(size * POOLED)}").select("piece_id", "length"), first + blocks, blocks
    return reduce(DataFrame.union, done)


def encoded_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id") -> DataFrame:
    """docs(id, text) -> piece_id, doc_id, piece, start, length, ids_crc32: every text encoded, `end_id`
    added, and cut into pieces of `size` ids where it is longer. A null text is empty and gives the end alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, row = word_encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    out.append((row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    row += 1
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["piece_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), "text").mapInArrow(run, "piece_id long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row a piece."""
    pieces = written(encoded_pieces(docs, path, size, end_id), "pieces")
    return pieces.join(pack(pieces, size), "piece_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
