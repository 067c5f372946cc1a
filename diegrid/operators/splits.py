"""Class caps, leakage-safe folds, oversampling, class weights and hold-out samples.

Randomness is a portable hash of the row id, so a split is the same on every run and engine. A
class may hold most rows: ranks within a class come from global_row_number, never from one
window over the class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from diegrid.functions.numeric import mix
from diegrid.functions.prefix import dense_ids, global_row_number


def factorize(df: DataFrame, column: str) -> DataFrame:
    """Adds `code`, a dense integer per distinct value in sort order."""
    return df.join(dense_ids(df, column, "code"), column)


def class_cap(df: DataFrame, cls: str, capped: str, cap: int, row_id: str, seed: int = 0) -> DataFrame:
    """Keeps `cap` hash-random rows of one class and all rows of the others."""
    some = df.where(F.col(cls) == capped).withColumn("_h", mix(F.col(row_id), seed))
    kept = global_row_number(some, [], "_h", row_id).where(F.col("rn") <= cap)
    return df.where(F.col(cls) != capped).unionByName(kept.select(*df.columns))


def dataset_audit(wafers: DataFrame) -> DataFrame:
    """Wafers and lots in total (cls NULL) and per class."""
    return wafers.rollup("cls").agg(F.count("*").alias("wafers"), F.count_distinct("lot_id").alias("lots"))


def group_kfold(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Folds (grp, fold) that never split a group and stay balanced by class and size: within each
    dominant class, groups are dealt out by size in a snake order. Groups are counted first, so
    only group rows are ranked."""
    per = df.groupBy("grp", "y").agg(F.count("*").alias("n"))
    groups = per.groupBy("grp").agg(F.sum("n").alias("size"), F.max(F.struct(F.col("n"), -F.col("y").cast("int"))).alias("m")).select(
        "grp", (-F.col("m")["col2"]).alias("dominant"), (mix(F.col("grp"), seed) / 2147483647.0 - F.col("size")).alias("order"))
    pos = ((F.col("rn") - 1) % (2 * k)).cast("int")
    return global_row_number(groups, ["dominant"], "order", "grp", buckets=16).select(
        "grp", F.when(pos < k, pos).otherwise(2 * k - 1 - pos).alias("fold"))


def random_kfold(df: DataFrame, k: int, row_id: str, seed: int = 0) -> DataFrame:
    """Stratified folds that ignore groups: the leaky protocol, for comparison."""
    ranked = global_row_number(df.withColumn("_h", mix(F.col(row_id), seed)), ["y"], "_h", row_id, buckets=16)
    return ranked.select(*df.columns, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def fold_leak_check(assigned: DataFrame) -> DataFrame:
    """Groups on both sides of some split (grp, folds); must be empty for a grouped split."""
    return assigned.groupBy("grp").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).where("lo <> hi").select("grp")


def leak_effect(preds: DataFrame, random: DataFrame, grouped: DataFrame, row_id: str, fold: int = 0) -> DataFrame:
    """Accuracy on one fold under both protocols."""
    hit = F.avg((F.col("y") == F.col("pred")).cast("int")).alias("accuracy")
    a = preds.join(random.where(F.col("fold") == fold).select(row_id), row_id, "left_semi").agg(hit).select(F.lit("random").alias("split"), "accuracy")
    b = preds.join(grouped.where(F.col("fold") == fold).select("grp"), "grp", "left_semi").agg(hit).select(F.lit("grouped").alias("split"), "accuracy")
    return a.union(b)


def oversample(df: DataFrame, target: int, row_id: str, n_classes: int, seed: int = 0) -> DataFrame:
    """All rows plus, for classes below target, members drawn with replacement up to target."""
    counts = df.groupBy("y").agg(F.count("*").alias("n"))
    index = global_row_number(df.select("y", row_id), ["y"], row_id, row_id, buckets=16)
    draws = (df.sparkSession.range(n_classes * target)
             .select(F.floor(F.col("id") / target).cast("int").alias("y"), (F.col("id") % target).alias("j"), "id")
             .join(F.broadcast(counts), "y").where(F.col("j") < target - F.col("n"))       # one row per class
             .select("y", (mix(F.col("id"), seed) % F.col("n") + 1).alias("rn")))
    extra = draws.join(index, ["y", "rn"]).select(row_id, "y")
    return df.select(row_id, "y").union(extra)


def class_weights(counts: DataFrame, beta: float = 0.999, floor: int = 1) -> DataFrame:
    """counts(y, n) -> class-balanced weights that sum to the number of classes."""
    n = F.greatest(F.col("n"), F.lit(floor), F.lit(1))
    w = counts.select("y", ((1 - beta) / (1 - F.pow(F.lit(beta), n.cast("double")))).alias("w"))
    every = Window.partitionBy(F.lit(0))                 # one row per class
    return w.select("y", (F.col("w") / F.sum("w").over(every) * F.count("*").over(every)).alias("weight"))


def holdout_complement(df: DataFrame, validation: DataFrame, row_id: str, size: int = 256, seed: int = 0) -> DataFrame:
    """A hash-random sample of the rows that are not in the validation set."""
    rest = df.join(validation.select(row_id), row_id, "left_anti")
    return rest.orderBy(mix(F.col(row_id), seed), row_id).limit(size)


def demo_sample(df: DataFrame, row_id: str, per_class: int = 4, seed: int = 0) -> DataFrame:
    """Up to `per_class` rows per class; the rank limit is applied before the shuffle."""
    order: list[Column] = [mix(F.col(row_id), seed), F.col(row_id)]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("y").orderBy(*order))).where(F.col("_r") <= per_class).drop("_r")
