"""Token counts of whole texts; huge documents are encoded in overlapping chunks over many tasks.

A chunk reaches `OVERLAP` characters into the one after it. Both are encoded with offsets. They are spliced
at a token boundary that both encodings have and that is proven stable: no vocabulary piece contains the two
characters around it in a row, so no merge can span it, whatever stands elsewhere in the text. If an overlap
holds no such place, both chunks are encoded again with an overlap four times as wide, in the end up to the
whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diegrid.llm.store import written
from diegrid.llm.tokens import piece_encoder

CHUNK, OVERLAP = 32_768, 256             # characters
BATCH = 64                               # texts given to the library at once


def _small(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            for i in range(0, batch.num_rows, BATCH):
                counts += piece_encoder(path).counts(batch.column(2).slice(i, BATCH).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _encode_chunks(chunks: DataFrame, path: str, chunk: int) -> DataFrame:
    """chunks(row, k, reach, text) -> row, k, reach, head, tail: proven places in the overlaps, as (offset in
    the document, tokens of this chunk before it); total: the tokens of this chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        kind = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))
        for batch in batches:
            heads, tails, totals = [], [], []
            for k, reach, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                bounds, base = encoder.boundaries(text), k * chunk

                def places(low: int, high: int) -> list[dict]:
                    near = np.flatnonzero((bounds > low) & (bounds < high) & (np.diff(bounds, append=bounds[-1] + 1) > 0))    # after all bytes of a character
                    return [{"at": base + int(bounds[i]), "tokens": int(i)} for i in near if encoder.apart(text, int(bounds[i]))]

                heads.append(places(0, reach) if k else [])
                tails.append(places(chunk, len(text)))
                totals.append(len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, kind), pa.array(tails, kind), pa.array(totals, pa.int64())],
                                             ["row", "k", "reach", "head", "tail", "total"])

    places = "array<struct<at:bigint,tokens:bigint>>"
    return chunks.select("row", "k", "reach", "text").mapInArrow(run, f"row long, k long, reach long, head {places}, tail {places}, total long")


def _cut(texts: DataFrame, chunk: int) -> DataFrame:
    """texts(row, ks: array of (k, reach), text) -> row, k, reach, text of the chunk. A text is read once, so
    cutting takes time in proportion to it, and yields `BATCH` chunks at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row, ks, text = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                for i in range(0, len(ks), BATCH):
                    rows = [(row, x["k"], x["reach"], text[x["k"] * chunk:(x["k"] + 1) * chunk + x["reach"]]) for x in ks[i:i + BATCH]]
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["row", "k", "reach", "text"])

    return texts.select("row", "ks", "text").mapInArrow(run, "row long, k long, reach long, text string")


def _huge(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """docs(row, doc_id, n_bytes, text) of more than one chunk -> doc_id, n_bytes, n_tokens."""
    docs = written(docs.withColumn("chars", F.length("text").cast("long")), "huge")

    def encoded(keys: DataFrame) -> DataFrame:
        texts = docs.join(keys.groupBy("row").agg(F.collect_list(F.struct("k", "reach")).alias("ks")), "row")
        return written(_encode_chunks(_cut(texts, chunk).repartition("row", "k"), path, chunk), "chunks")

    count = F.expr(f"int((chars + {chunk} - 1) div {chunk})")
    keys = docs.select("row", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).alias("k")).withColumn("reach", F.lit(overlap).cast("long"))
    done, whole = encoded(keys), []
    while True:
        following = done.select("row", (F.col("k") - 1).alias("k"), F.col("head").alias("next_head"))
        common = F.expr("filter(tail, x -> exists(next_head, y -> y.at = x.at))")
        joined = done.join(following, ["row", "k"], "left").withColumn("common", common)
        joined = joined.withColumn("splice", F.expr("get(common, 0)"))
        joined = joined.withColumn("tokens_before", F.expr("get(filter(next_head, y -> y.at = splice.at), 0).tokens"))
        open_ = written(joined.where("next_head is not null and splice is null").select("row", "k", (F.col("reach") * 4).alias("reach")), "open")
        if open_.isEmpty():
            break
        given_up = written(open_.join(docs.select("row", "chars"), "row").where("reach > chars").select("row").distinct(), "whole")
        whole.append(given_up)
        open_ = open_.join(given_up, "row", "left_anti")
        wider = open_.union(open_.withColumn("k", F.col("k") + 1)).groupBy("row", "k").agg(F.max("reach").alias("reach"))
        done = done.join(given_up, "row", "left_anti").join(wider.select("row", "k"), ["row", "k"], "left_anti").union(encoded(wider))
    # up to its splice a chunk counts its own tokens; those of the next one before that place do not count
    parts = joined.select("row", F.coalesce("splice.tokens", "total").alias("own"), F.coalesce("tokens_before", F.lit(0)).alias("before"))
    sums = parts.groupBy("row").agg((F.sum("own") - F.sum("before")).alias("n_tokens"))
    out = docs.select("row", "doc_id", "n_bytes").join(sums, "row").select("doc_id", "n_bytes", "n_tokens")
    for rows in whole:
        out = out.union(_small(docs.join(rows, "row", "left_semi"), path))
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); one row for each row.

    A null text is empty. Repeated and null ids keep their rows. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = F.length("text") <= chunk + overlap
    out = _small(docs.where(short), path)
    huge = docs.where(~short).withColumn("row", F.monotonically_increasing_id())
    if not huge.isEmpty():
        out = out.union(_huge(huge, path, chunk, overlap))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
