"""Learned models on tables (MLlib), Monte-Carlo dropout, and the per-wafer result documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from diegrid.sources.tables import ensure_checkpoint_dir


def _out_of_fold(rows: DataFrame, estimator, n_folds: int, keep: list[str]) -> DataFrame:
    """One fit per fold on the other folds; every row is scored by the model that did not see it."""
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()                            # iterative fits read the features many times
    out = None
    for k in range(n_folds):
        train, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        part = estimator.fit(train).transform(held).select(*keep, F.col("prediction").cast("int").alias("pred"), vector_to_array("probability").alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def morphology_oof(rows: DataFrame, feature_cols: list[str], n_folds: int, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """rows(wafer_id, y, fold, features..) -> out-of-fold class probabilities of a tree ensemble."""
    data = VectorAssembler(inputCols=feature_cols, outputCol="features").transform(rows).select("wafer_id", F.col("y").cast("double").alias("label"), "fold", "features")
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    return _out_of_fold(data, rf, n_folds, ["wafer_id", "fold", "label"])


def _meta_model(n: int) -> LogisticRegression:
    """Multinomial logistic regression with an L2 penalty of strength 1 on the summed loss."""
    return LogisticRegression(family="multinomial", maxIter=100, regParam=1.0 / max(n, 1), standardization=False)


def stacker_oof(rows: DataFrame, n_folds: int, key: str) -> DataFrame:
    """rows(key, y, fold, meta ARRAY) -> out-of-fold probabilities of the stacking model."""
    data = rows.select(key, F.col("y").cast("double").alias("label"), "fold", array_to_vector("meta").alias("features"))
    return _out_of_fold(data, _meta_model(rows.count()), n_folds, [key, "fold", "label"])


def meta_weight_share(rows: DataFrame, blocks: dict[str, int]) -> DataFrame:
    """Mean |coefficient| per block of meta features, normalised: how much each base model counts."""
    data = rows.select(F.col("y").cast("double").alias("label"), array_to_vector("meta").alias("features"))
    w = np.abs(_meta_model(rows.count()).fit(data).coefficientMatrix.toArray())
    at, share = 0, []
    for name, size in blocks.items():
        share.append((name, float(w[:, at:at + size].mean())))
        at += size
    total = sum(v for _, v in share)
    return rows.sparkSession.createDataFrame([(n, v / total) for n, v in share], "base_model string, share double")


def mc_dropout(rows: DataFrame, key: str, weights: np.ndarray, bias: np.ndarray, drop: float, samples: int = 30, seed: int = 0) -> DataFrame:
    """rows(key, g ARRAY) -> mean probabilities, their entropy, mutual information and largest
    standard deviation over `samples` dropout masks of the pooled features.

    The masks are a portable hash of (seed, sample, unit), so they are the same in every task; a
    batch is one matrix product per sample. weights is one classifier head, classes x units.
    """
    units = weights.shape[1]
    x = np.arange(samples * units, dtype=np.int64)
    a = (x * 2654435761 + seed * 40503) % 4294967296
    h = (a % 65536 * 48271 + a // 65536 * 69621) % 2147483647
    masks = (h / 2147483647.0 >= drop).reshape(samples, units) / (1.0 - drop)

    def ent(p: np.ndarray) -> np.ndarray:
        return -(p * np.log(np.clip(p, 1e-12, 1))).sum(-1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            g = np.stack(pdf["g"].to_numpy()).astype(float)
            z = np.stack([(g * m) @ weights.T + bias for m in masks])
            e = np.exp(z - z.max(-1, keepdims=True))
            p = e / e.sum(-1, keepdims=True)
            mean = p.mean(0)
            yield pd.DataFrame({key: pdf[key], "p": list(mean), "entropy": ent(mean), "mutual_info": ent(mean) - ent(p).mean(0), "std": p.std(0).max(-1)})

    return rows.select(key, F.col("g").cast("array<double>").alias("g")).mapInPandas(run, f"{key} bigint, p array<double>, entropy double, mutual_info double, std double")


def batch_rows(summary: DataFrame, area: DataFrame, decisions: DataFrame, batches: DataFrame) -> DataFrame:
    """Report row per wafer, and per row the number of its batch's wafers sent to human review. A
    wafer without a name is called after its `position` in the request, where batches has one."""
    rows = (batches.join(summary.select("wafer_id", "fail_pct"), "wafer_id").join(area.select("wafer_id", "affected_pct", "area_mm2"), "wafer_id")
            .join(decisions.select("wafer_id", "final", "confidence", "action", "status"), "wafer_id"))
    review = rows.groupBy("batch").agg(F.count_if(F.col("action") == "human_review").alias("human_review"))
    name = F.col("wafer_id").cast("string")
    if "name" in batches.columns and "position" in batches.columns:
        name = F.coalesce("name", F.concat(F.lit("#"), F.col("position").cast("string")))
    return rows.join(review, "batch").select(name.alias("wafer_id"), "batch", "final", "confidence", "action", F.col("status").alias("verification"),
                                             "fail_pct", "affected_pct", "area_mm2", "human_review")


def result_json(decisions: DataFrame, summary: DataFrame, area: DataFrame, centroid: DataFrame) -> DataFrame:
    """One nested document per wafer: prediction, verification, decision, quantification."""
    j = (decisions.join(summary, "wafer_id").join(area.drop("wilson_lo", "wilson_hi", "clean_pct"), "wafer_id").join(centroid, "wafer_id", "left"))
    doc = F.struct(
        F.struct("final", F.col("top").alias("model_top_class"), "confidence", "p", F.array("top", "second").alias("top2")).alias("prediction"),
        F.struct("status", "second_status").alias("verification"), F.struct("action", "note").alias("decision"),
        F.struct(F.struct("dies_total", "dies_failed", "fail_pct", "clean_pct", F.array("wilson_lo", "wilson_hi").alias("wilson95")).alias("wafer"),
                 F.struct("dies", "affected_pct", "area_mm2", "background_fail_dies", F.array("row_mean", "col_mean").alias("centroid_die"),
                          F.array("x_mm", "y_mm").alias("centroid_mm"), "radius_norm", "angle_deg").alias("pattern")).alias("quantification"))
    return j.select("wafer_id", F.to_json(doc).alias("document"))
