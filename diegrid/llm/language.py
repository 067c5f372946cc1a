"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from hashed byte trigrams. Every label of the table is a class, fitted on a bounded sample of
its own distinct texts, so neither the table's size nor other labels decide what exists. A first pass over all rows gives each a posterior from its text alone; grouped sums of these posteriors make host priors,
smoothed by those of the domain and of all rows, and the reliability of each declared markup language and
address suffix. The posterior of a row fuses all of them, its own share left out of what its host says.
The class `und` has the uniform law over trigrams: text that no language explains better is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diegrid.llm.store import text_batches, written
from diegrid.llm.words import LOWER, runs_of_rows, utf8

SAMPLE = 1_000                           # distinct texts of each label that the text model is fitted on, about
BUCKETS = 1 << 16
WEIGHT = 100.0                           # trigrams that the text counts as, at most: neighbouring ones depend on each other
HOST, RELIABLE, UND_PRIOR = 10.0, 5.0, 0.01
ROWS = 512                               # rows that go back from Python at once, with their documents
UND = "und"
DOUBLES = T.ArrayType(T.DoubleType())

_FOLD = LOWER.copy()
_FOLD[0x30:0x3A] = 0x30                  # digits are alike
_FOLD[0x09:0x0E] = 0x20


def _codes(data: np.ndarray) -> np.ndarray:
    low = _FOLD[data].astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _counts(docs: DataFrame) -> DataFrame:
    """docs(label, text) -> label, bucket, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for r, label in enumerate(batch.column(0).to_pylist()):
                part = data[offsets[r]:offsets[r + 1]]
                if len(part) > 2:
                    bucket, n = np.unique(_codes(part), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(n)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], ["label", "bucket", "n"])

    return docs.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class TextModel:
    """Log-probabilities of trigram buckets by language; the last class is `und`."""

    def __init__(self, labels: list[str], counts: np.ndarray):
        self.labels = [*labels, UND]
        shared = counts.sum(axis=0) + 0.5
        shared /= shared.sum()
        law = counts + 2_000 * 0.2 * shared + 0.02
        law /= law.sum(axis=1, keepdims=True)
        self.table = np.log(np.vstack([law, np.full((1, BUCKETS), 1 / BUCKETS)])).astype(np.float32)

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities by row and class over the whole text, and trigrams of the row."""
        data, offsets = utf8(column)
        out, n = np.zeros((len(column), len(self.labels))), np.maximum(np.diff(offsets) - 2, 0)
        for i, j in runs_of_rows(offsets, 1 << 18):
            for at in range(int(offsets[i]), int(offsets[j]), 1 << 20):       # a very long text in pieces
                end = min(int(offsets[j]), at + (1 << 20) + 2)
                if end - at < 3:
                    continue
                code = _codes(data[at:end])
                row = np.searchsorted(offsets[i:j + 1], np.arange(at, at + len(code)), side="right") - 1 if j - i > 1 else np.zeros(len(code), np.int64)
                inside = np.arange(at, at + len(code)) + 2 < offsets[i:j + 1][row + 1]
                row, code = row[inside], code[inside]
                for c in range(len(self.labels)):
                    out[i:j, c] += np.bincount(row, self.table[c].take(code), minlength=j - i)
        return out, n

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods by row and class, weighed as at most `WEIGHT` trigrams, and trigrams of the row."""
        logs, n = self.scores(column)
        return logs * (np.minimum(n, WEIGHT) / np.maximum(n, 1))[:, None], n.astype(np.int64)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> TextModel:
    """labelled(label, text): a class for each label but `und` and blank ones, from its distinct texts. Where a label
    has more than `sample`, those whose hash is in the first share of `sample` to their number are taken."""
    rows = labelled.where((F.trim("label") != "") & (F.col("label") != UND) & F.col("text").isNotNull()).select("label", "text", F.xxhash64("text").alias("h"))
    sizes = rows.select("label", "h").distinct().groupBy("label").count().collect()
    if not sizes:
        return TextModel([], np.zeros((0, BUCKETS)))
    labels = sorted(r["label"] for r in sizes)
    counts, at = np.zeros((len(labels), BUCKETS)), {k: i for i, k in enumerate(labels)}
    last = [(r["label"], -(1 << 63) + min((1 << 64) - 1, (sample << 64) // r["count"])) for r in sizes]
    ends = labelled.sparkSession.createDataFrame(last, "label string, last long")
    drawn = rows.join(F.broadcast(ends), "label").where("h <= last").dropDuplicates(["h", "label"]).select("label", "text")     # one row per label
    for r in _counts(drawn).toArrow().to_batches():
        for label, bucket, n in zip(*(r.column(c).to_pylist() for c in range(3))):
            counts[at[label], bucket] = n
    return TextModel(labels, counts)


def scored(rows: DataFrame, model: TextModel) -> DataFrame:
    """Every column of rows, with `evidence`: log-likelihoods of the text by class, and `n_trigrams`."""
    held, names = rows.sparkSession.sparkContext.broadcast(model), rows.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, n = held.value.evidence(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(evidence), pa.array(n, pa.int64())], [*names, "evidence", "n_trigrams"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("evidence", DOUBLES), T.StructField("n_trigrams", T.LongType())]))


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _alone(evidence: np.ndarray) -> np.ndarray:
    """Posteriors from the text and the prior of `und`, the last class, alone."""
    logs = evidence.copy()
    logs[:, -1] += np.log(UND_PRIOR)
    return _softmax(logs)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Rows of n doubles; zeros for null lists."""
    out = np.zeros((len(column), n))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def fuse(evidence: np.ndarray, sums: dict[str, np.ndarray], given: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Posteriors of rows by class. sums: weights of the classes under each row's host, domain, declared language and
    suffix, over all rows; given: whether a row has the declaration or suffix; everything: weights over all rows.
    A row's own share is left out under its keys."""
    alone, total = _alone(evidence), everything.sum() + 1.0
    own = {k: np.maximum(x - alone, 0.0) for k, x in sums.items()}
    count = {k: np.maximum(x.sum(axis=1, keepdims=True) - 1.0, 0.0) for k, x in sums.items()}
    everywhere = (everything + 1.0 / len(everything)) / total
    by_domain = (own["domain"] + HOST * everywhere) / (count["domain"] + HOST)
    logs = evidence + np.log((own["host"] + HOST * by_domain) / (count["host"] + HOST))
    for key, has in given.items():                                   # P(key | class) / P(key): 1 where nothing is declared
        share = (count[key] + RELIABLE) / (total + RELIABLE)
        logs += np.where(has[:, None], np.log((own[key] + RELIABLE * share) / (everything + RELIABLE) / share), 0.0)
    return _softmax(logs)


KEYS = ("host", "domain", "declared", "suffix")


class Priors:
    """Grouped sums of the text posteriors of all rows, by host, domain, declared language and suffix."""

    def __init__(self, rows: DataFrame, model: TextModel, from_text: bool = False):
        """rows(host, declared, suffix, evidence), any of the first three may be null; with `from_text` they hold `text`
        instead of evidence, which is scored in the same worker: a second one behind it would double what a task holds in
        Python. Each Arrow batch is summed by key before the shuffle, so a host with a third of all rows is a row a batch."""
        self.model, n = model, len(model.labels)
        held = rows.sparkSession.sparkContext.broadcast(model) if from_text else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = batch.column(len(KEYS))
                alone = _alone(_matrix(given, n) if held is None else held.value.evidence(given)[0])
                for i, kind in enumerate(KEYS):
                    codes = batch.column(i).dictionary_encode()
                    valid = codes.indices.is_valid().to_numpy(zero_copy_only=False)
                    at, names = codes.indices.drop_null().to_numpy(zero_copy_only=False), codes.dictionary
                    if not len(names):
                        continue
                    sums = np.stack([np.bincount(at, alone[valid, c], minlength=len(names)) for c in range(n)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.string()), names, _lists(sums)], ["kind", "key", "sums"])
                yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([None], pa.string()), _lists(alone.sum(axis=0)[None, :])], ["kind", "key", "sums"])

        parts = rows.select("host", domain(F.col("host")).alias("domain"), "declared", "suffix", "text" if from_text else "evidence").mapInArrow(run, "kind string, key string, sums array<double>")
        with text_batches(rows.sparkSession):
            sums = written(parts.groupBy("kind", "key").agg(F.array(*[F.sum(F.col("sums")[c]) for c in range(n)]).alias("sums")), "priors")
        whole = sums.where("kind = 'all'").first()
        self.all = np.array(whole["sums"] if whole else [0.0] * n)
        self.tables = {k: written(sums.where(F.col("kind") == k).select(F.col("key").alias(k), F.col("sums").alias(f"{k}_n")), f"by-{k}") for k in KEYS}

    def fused(self, rows: DataFrame, from_text: bool = False) -> DataFrame:
        """rows(host, declared, suffix, evidence, ...) -> the same, and `posterior` by class. With `from_text` rows
        hold `text` instead of evidence, which is scored in the same batch and left out of the result; `n_trigrams` is added.
        Rows without a column `text` hold it in their struct `doc`, and it goes to Python once."""
        model, everything, n = self.model, self.all, len(self.model.labels)
        held = rows.sparkSession.sparkContext.broadcast(model) if from_text else None
        names = [c for c in rows.columns if not (from_text and c == "text")]
        sources = [*names, "text"] if from_text and "text" in rows.columns else names
        joined = rows.withColumn("domain", domain(F.col("host")))
        for key, table in self.tables.items():
            joined = joined.join(table, key, "left")
        sums = [f"{k}_n" for k in KEYS]
        added = ["n_trigrams", "posterior"] if from_text else ["posterior"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    column = dict(zip([*sources, *sums], batch.slice(at, ROWS).columns))
                    if held is None:
                        evidence, new = _matrix(column["evidence"], n), []
                    else:
                        evidence, trigrams = held.value.evidence(column["text"] if "text" in column else column["doc"].field("text"))
                        new = [pa.array(trigrams, pa.int64())]
                    given = {k: column[k].is_valid().to_numpy(zero_copy_only=False) for k in ("declared", "suffix")}
                    posterior = fuse(evidence, {k: _matrix(column[f"{k}_n"], n) for k in KEYS}, given, everything)
                    yield pa.RecordBatch.from_arrays([*(column[c] for c in names), *new, _lists(posterior)], [*names, *added])

        types = {"n_trigrams": T.LongType(), "posterior": DOUBLES}
        return joined.select(*sources, *sums).mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), *(T.StructField(c, types[c]) for c in added)]))


def domain(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own domain."""
    return F.substring_index(host, ".", -2)


def decided(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows(posterior, n_trigrams, declared, ...) -> language, confidence, keep; text under three bytes has no language.

    Text that no class explains is taken at its word where it declares a language that is no class. Without any
    class nothing can be judged: all text is kept."""
    names = F.array(*[F.lit(x) for x in model.labels])
    best = F.array_max("posterior")
    language = F.when(F.col("n_trigrams") > 0, names[F.array_position("posterior", best).cast("int") - 1]).otherwise(F.lit(UND))
    unmodelled = (F.trim("declared") != "") & ~F.col("declared").isin(model.labels) & (F.col("n_trigrams") > 0)
    language = F.when((language == UND) & unmodelled, F.col("declared")).otherwise(language)
    keep = F.col("language") != UND if len(model.labels) > 1 else F.col("n_trigrams") > 0
    return rows.withColumn("language", language).withColumn("confidence", F.when(F.col("n_trigrams") > 0, best).otherwise(F.lit(0.0))).withColumn("keep", keep)


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, text, host, declared, suffix. The text is what is left of the markup;
    the suffix is the two-letter first segment of the path, else the last label of the host."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z]{1,8};", " ")
    host = F.lower(F.nullif(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))
    declared = F.lower(F.nullif(F.regexp_extract(html, "(?i)<html\\b[^>]*\\slang=[\"']?([A-Za-z]{2,3})", 1), F.lit("")))
    segment = F.nullif(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:/|$)", 1), F.lit(""))
    label = F.when(host.contains("."), F.substring_index(host, ".", -1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("text"), host.alias("host"), declared.alias("declared"), F.coalesce(segment, label).alias("suffix"))


def documents_as_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, lang, source, ...): lang is what is declared, source the host."""
    return docs.select(*keep, F.col("lang").alias("declared"), F.col("source").alias("host"),
                       F.when(F.col("source").contains("."), F.substring_index("source", ".", -1)).alias("suffix"))


def languages(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """rows(text, host, declared, suffix, *keys) -> *keys, language, confidence, keep; one row for each row.

    A null or empty text is rejected (`und`, confidence 0). A missing host, declaration or suffix is no
    evidence. Repeated rows keep a row each; an empty table gives none.
    """
    evidence = written(scored(rows.select(*keys, "text", "host", "declared", "suffix"), model).drop("text"), "evidence")
    return decided(Priors(evidence, model).fused(evidence), model).select(*keys, "language", "confidence", "keep")


def identified(docs: DataFrame) -> DataFrame:
    """documents without those that no language explains, `lang` set to the language found; all columns stay.

    The text model is fitted on the rows' own declared languages. Texts are scored twice instead of
    being carried through the grouping.
    """
    model = fit(docs.select(F.col("lang").alias("label"), "text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("lang").alias("declared"), F.col("source").alias("host"),
                         F.when(F.col("source").contains("."), F.substring_index("source", ".", -1)).alias("suffix"))
    priors = Priors(documents_as_rows(docs, ["text"]), model, from_text=True)
    kept = decided(priors.fused(packed, from_text=True), model).where("keep")
    return kept.select(*[(F.col("language") if c == "lang" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
