"""Token-id files of independent zstandard frames with a trailing seek table.

A file is a run of frames of about `FRAME` ids, each compressed on its own with a content checksum, then two
skippable frames: the document index, and the seek table of the public seekable format. A reader fetches the
file's end, then only the frames that hold the documents it wants, and checks each frame.

    frames | 0x184D2A5D, size, documents, zlib(doc_id, start, n_tokens) | 0x184D2A5E, size, (compressed, raw, crc32) x frames, frames, flags, 0x8F92EAB1

Files lie in the shared folder and are written through its own file system under a name of the attempt that
wrote them; the manifest lists the files of the attempts that counted, so a lost executor leaves nothing but
files that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diegrid.llm.store import written
from diegrid.llm.tokens import word_encoder
from diegrid.sources.tables import shared_path

FRAME = 1 << 16                          # ids in a frame, about; a longer document has several frames
FILE = 1 << 26                           # ids in a file, about
_INDEX, _SEEK, _FOOT = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<i8"), ("n", "<i8")])


class Writer:
    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        self.out = system.open_output_stream(path)
        self.press, self.frames, self.docs, self.ids, self.held = zstandard.ZstdCompressor(level=1, write_checksum=True), [], [], 0, []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.ids, len(ids) // 4))
        self.ids += len(ids) // 4
        for at in range(0, len(ids), 4 * FRAME):
            self.held.append(ids[at:at + 4 * FRAME])
            self.waiting += len(self.held[-1])
            if self.waiting >= 4 * FRAME:
                self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.press.compress(raw)
        self.frames.append((len(packed), len(raw), zlib.crc32(raw)))
        self.out.write(packed)
        self.held, self.waiting = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = zlib.compress(np.array(self.docs, _DOC).tobytes(), 1)
        self.out.write(struct.pack("<IIQ", _INDEX, len(index) + 8, len(self.docs)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", _SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, _FOOT))
        self.out.close()


class Reader:
    """Random access to one file: `docs` is its index, `read(k)` the ids of its k-th document."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _FOOT:
            raise ValueError(f"{uri} has no seek table")
        self.frames = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        end = int(self.places[-1])
        magic, length, n = struct.unpack("<IIQ", self.file.read_at(16, end))
        if magic != _INDEX:
            raise ValueError(f"{uri} has no document index")
        self.docs = np.frombuffer(zlib.decompress(self.file.read_at(length - 8, end + 16)), _DOC, count=n)
        self.press, self.kept = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, f: int) -> bytes:
        if self.kept[0] != f:
            size, raw, crc = (int(x) for x in self.frames[f])
            data = self.press.decompress(self.file.read_at(size, int(self.places[f])), max_output_size=raw)
            if len(data) != raw or zlib.crc32(data) != crc:
                raise ValueError(f"frame {f} is damaged")
            self.kept = (f, data)
        return self.kept[1]

    def read(self, k: int) -> bytes:
        start, end = 4 * int(self.docs[k]["start"]), 4 * int(self.docs[k]["start"] + self.docs[k]["n"])
        out, f = [], int(np.searchsorted(self.raw, start, side="right")) - 1
        while start < end:
            low = int(self.raw[f])
            out.append(self.frame(f)[start - low:end - low])
            start, f = int(self.raw[f + 1]), f + 1
        return b"".join(out)


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str, encoder=word_encoder) -> DataFrame:
    """docs(doc_id, text) -> the manifest, one row a file: part, seq, uri, first id, n_docs, n_ids.

    Documents are range-partitioned and sorted by doc_id (null first; rows that repeat an id lie together in
    any order), so files in the order of (part, seq) hold them in ascending order. A null text is empty and
    has its end id alone. An empty table has no files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encode, end, part = encoder(path).encode, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        writer, rows = None, []

        def finish() -> None:
            writer.close()
            rows.append((part, len(rows), uri, len(writer.docs), writer.ids))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    uri = f"{folder}/{part:06d}-{len(rows):04d}-{uuid.uuid4().hex[:12]}.ids"
                    writer = Writer(uri)
                writer.add(doc, encode(text.as_py() or "") + end)
                if writer.ids >= FILE:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(columns)], ["part", "seq", "uri", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return written(ordered.mapInArrow(run, "part long, seq long, uri string, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Where each file starts follows from the manifest, whose length is that of the files, not of the documents.
    """
    spark, at, starts = manifest.sparkSession, 0, []
    for r in manifest.select("part", "seq", "uri", "n_ids").sort("part", "seq").collect():
        starts.append((r["uri"], at))
        at += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(uri)
                ids = pa.array([int(d["doc_id"]) if d["known"] else None for d in reader.docs], pa.int64())
                crc = [zlib.crc32(reader.read(k)) for k in range(len(reader.docs))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(reader.docs["start"] + first), pa.array(reader.docs["n"].copy()), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(starts, "uri string, first long").repartition(max(1, len(starts)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes docs(doc_id, text) as token-id files in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    uri = system.makeQualified(hadoop).toString()
    return read_token_files(write_token_files(docs, path, end_id, uri if "://" in uri else uri.replace("file:/", "file:///", 1)))
