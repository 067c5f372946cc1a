"""Classification metrics over predictions(by.., y, pred, conf, p ARRAY, grp).

`by` names columns (a model, a fold) that metrics are computed for side by side. Everything a
confusion matrix determines is computed from its at most C x C counts per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diegrid.functions.arrays import ranked
from diegrid.functions.numeric import mix, ratio
from diegrid.functions.prefix import running_totals


def confusion_counts(preds: DataFrame, by: list[str] = []) -> DataFrame:
    return preds.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, n_classes: int) -> DataFrame:
    """Dense C x C counts."""
    grid = preds.sparkSession.range(n_classes * n_classes).select(
        F.expr(f"CAST(id DIV {n_classes} AS INT)").alias("y"), F.expr(f"CAST(id % {n_classes} AS INT)").alias("pred"))
    return grid.join(confusion_counts(preds), ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(conf: DataFrame, by: list[str] = [], weight: str = "n") -> DataFrame:
    """tp, support, predicted, precision, recall, F1 per class that occurs in y or pred."""
    hit = F.when(F.col("y") == F.col("pred"), F.col(weight)).otherwise(F.lit(0))
    sides = conf.select(*by, F.inline(F.array(
        F.struct(F.col("y").alias("k"), hit.alias("tp"), F.col(weight).alias("sup"), F.lit(0).cast("long").alias("prd")),
        F.struct(F.col("pred").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), F.col(weight).alias("prd")))))
    g = sides.groupBy(*by, "k").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("prd").alias("predicted"))
    return g.select("*", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
                    ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def per_class_prf(preds: DataFrame, n_classes: int) -> DataFrame:
    """All labels, zero where undefined."""
    k = preds.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("k"))
    g = k.join(class_scores(confusion_counts(preds)), "k", "left")
    return g.select("k", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], F.coalesce("support", F.lit(0)).alias("support"))


def averaged_prf(conf: DataFrame, by: list[str] = []) -> DataFrame:
    """macro, micro and weighted averages over the labels present in y or pred."""
    g = class_scores(conf, by).groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        (F.sum("tp") / F.sum("support")).alias("micro"))
    rows = F.array(*[F.struct(F.lit(a).alias("average"), *[(F.col("micro") if a == "micro" else F.col(f"{a}_{m}")).alias(m)
                                                          for m in ("precision", "recall", "f1")]) for a in ("macro", "micro", "weighted")])
    return g.select(*by, F.inline(rows))


def accuracy_suite(preds: DataFrame, by: list[str] = []) -> DataFrame:
    """n, accuracy, balanced accuracy (mean recall of the classes in y), top-2 accuracy."""
    top2 = F.exists(F.slice(ranked(F.col("p")), 1, 2), lambda s: s["k"] == F.col("y"))
    per = preds.groupBy(*by, "y").agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("hit"), F.count_if(top2).alias("hit2"))
    return per.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"),
                                F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"), (F.sum("hit2") / F.sum("n")).alias("top2_accuracy"))


def kappa_mcc(conf: DataFrame, by: list[str] = []) -> DataFrame:
    """Cohen's kappa and the multiclass Matthews coefficient from the marginals."""
    d = class_scores(conf, by).groupBy(*by).agg(
        F.sum("support").cast("double").alias("s"), F.sum("tp").cast("double").alias("c"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"), F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"))
    s, c = F.col("s"), F.col("c")
    return d.select(*by, F.try_divide(c * s - F.col("tp"), s * s - F.col("tp")).alias("kappa"),
                    ratio(c * s - F.col("tp"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))).alias("mcc"))


def reliability_bins(preds: DataFrame, by: list[str] = [], bins: int = 15) -> DataFrame:
    """Non-empty bins (lo, hi] of the top confidence."""
    b = F.ceil(F.round(F.col("conf") * bins, 9)).cast("int")
    g = preds.select(*by, b.alias("bin"), "conf", (F.col("y") == F.col("pred")).cast("int").alias("hit")).where("bin > 0")
    return g.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("confidence")).select(
        *by, "bin", ((F.col("bin") - 1) / bins).alias("lo"), (F.col("bin") / bins).alias("hi"), "n", "accuracy", "confidence")


def ece(preds: DataFrame, by: list[str] = [], bins: int = 15) -> DataFrame:
    """Expected calibration error; all rows count, also those with confidence 0."""
    b = F.greatest(F.ceil(F.round(F.col("conf") * bins, 9)), F.lit(0)).cast("int")
    g = preds.select(*by, b.alias("bin"), "conf", (F.col("y") == F.col("pred")).cast("int").alias("hit")).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg("hit").alias("a"), F.avg("conf").alias("c"))
    return g.groupBy(*by).agg((F.sum(F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("a") - F.col("c"))).otherwise(F.lit(0.0))) / F.sum("n")).alias("ece"))


def score_table(preds: DataFrame, by: list[str] = []) -> DataFrame:
    """Positives and negatives per (class, distinct score): ties are one row from here on."""
    long = preds.select(*by, "y", F.posexplode("p").alias("k", "score"))
    return long.groupBy(*by, "k", "score").agg(F.count_if(F.col("y") == F.col("k")).alias("pos"), F.count_if(F.col("y") != F.col("k")).alias("neg"))


def auc_ovr(preds: DataFrame, by: list[str] = []) -> DataFrame:
    """One-vs-rest ROC AUC; NULL where a class is absent or the only one."""
    keys = [*by, "k"]
    r = running_totals(score_table(preds, by), keys, "score", ["pos", "neg"])
    below = F.col("run_neg") - F.col("neg")
    g = r.groupBy(*keys).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("u"), F.max("all_pos").alias("P"), F.max("all_neg").alias("N"))
    return g.select(*keys, F.try_divide(F.col("u"), (F.col("P") * F.col("N")).cast("double")).alias("auc"))


def youden_thresholds(preds: DataFrame, by: list[str] = []) -> DataFrame:
    """Score with the largest TPR - FPR, the highest on ties; 0.5 for a one-sided class. The
    difference is compared as the integer tp * N - fp * P."""
    keys = [*by, "k"]
    r = running_totals(score_table(preds, by), keys, "score", ["pos", "neg"], descending=True)
    j = F.col("run_pos") * F.col("all_neg") - F.col("run_neg") * F.col("all_pos")
    g = r.groupBy(*keys).agg(F.max(F.struct(j.alias("j"), F.col("score").alias("t"))).alias("best"),
                             F.max("all_pos").alias("P"), F.max("all_neg").alias("N"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best.t")))
    return g.select(*keys, F.when((F.col("P") == 0) | (F.col("N") == 0), 0.5).when(F.col("best.j") <= 0, 1.0).otherwise(t).alias("threshold"))


def pr_curve(preds: DataFrame) -> DataFrame:
    """Micro-averaged precision-recall curve over all (row, class) pairs, one point
    for each distinct score, with the average precision of the full curve."""
    flat = score_table(preds).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.lit(1).alias("one"))
    r = running_totals(flat, [], "score", ["pos", "neg", "one"], descending=True)
    c = r.select((F.col("all_one") - F.col("run_one")).alias("pos_asc"), F.col("all_one").alias("n"),
                 ratio(F.col("run_pos"), F.col("run_pos") + F.col("run_neg")).alias("precision"),
                 ratio(F.col("run_pos"), F.col("all_pos")).alias("recall"), ratio(F.col("pos"), F.col("all_pos")).alias("gain"))
    ap = c.agg(F.sum(F.col("gain") * F.col("precision"))).scalar()
    # ascending thresholds, then the end point (recall 0, precision 1) at position n
    end = c.groupBy().agg(F.max("n").alias("n")).select(F.col("n").alias("pos_asc"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return c.select("pos_asc", "precision", "recall").union(end).select("pos_asc", "precision", "recall", ap.alias("average_precision"))


def group_draws(groups: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(rep, idx, m): how often group idx is drawn in replicate rep, G draws with replacement each."""
    g = groups.count()                                 # one number
    d, rep = F.col("id") % g, F.floor(F.col("id") / g)
    return (groups.sparkSession.range(n_boot * g).select(rep.cast("int").alias("rep"), d.alias("d"))
            .select("rep", (mix(mix(F.col("d"), F.col("rep") + seed), F.col("rep") + 17) % g).alias("idx"))
            .groupBy("rep", "idx").agg(F.count("*").alias("m")))


def bootstrap_replicates(preds: DataFrame, n_boot: int = 300, seed: int = 0) -> DataFrame:
    """accuracy and macro F1 of every replicate that resamples groups.

    Groups are first reduced to their confusion counts, so a group with a third of the rows
    weighs no more than any other; only (replicate, group) counts are multiplied.
    """
    cells = preds.groupBy("grp", "y", "pred").agg(F.count("*").alias("n"))
    index = running_totals(cells.select("grp").distinct().withColumn("one", F.lit(1)), [], "grp", ["one"])
    index = index.select("grp", (F.col("run_one") - 1).cast("long").alias("idx"))
    drawn = (group_draws(cells.select("grp").distinct(), n_boot, seed).join(cells.join(index, "grp"), "idx")
             .groupBy("rep", "y", "pred").agg(F.sum(F.col("m") * F.col("n")).alias("n")))
    return class_scores(drawn, ["rep"]).groupBy("rep").agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def group_bootstrap_ci(preds: DataFrame, n_boot: int = 300, seed: int = 0) -> DataFrame:
    r = bootstrap_replicates(preds, n_boot, seed)
    q = F.array(F.lit(0.025), F.lit(0.975))
    g = r.agg(F.percentile("accuracy", q).alias("a"), F.percentile("macro_f1", q).alias("f"))
    return g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c)[0].alias("lo"), F.col(c)[1].alias("hi"))
                                       for n, c in (("accuracy", "a"), ("macro_f1", "f"))])))


def _long(df: DataFrame, by: list[str], section: str, label: Column, names: list[str]) -> DataFrame:
    return df.select(*by, F.inline(F.array(*[F.struct(F.lit(section).alias("section"), label.alias("label"), F.lit(n).alias("metric"),
                                                     F.col(n).cast("double").alias("value")) for n in names])))


def full_report(preds: DataFrame, by: list[str] = [], groups: bool = True) -> DataFrame:
    """Every metric as rows (section, label, metric, value)."""
    conf = confusion_counts(preds, by)
    none = F.lit("")
    parts = [
        _long(accuracy_suite(preds, by), by, "overall", none, ["n", "accuracy", "balanced_accuracy", "top2_accuracy"]),
        _long(kappa_mcc(conf, by), by, "overall", none, ["kappa", "mcc"]),
        _long(ece(preds, by), by, "overall", none, ["ece"]),
        _long(averaged_prf(conf, by), by, "average", F.col("average"), ["precision", "recall", "f1"]),
        _long(class_scores(conf, by), by, "class", F.col("k").cast("string"), ["precision", "recall", "f1", "support"]),
        _long(auc_ovr(preds, by), by, "class", F.col("k").cast("string"), ["auc"]),
        _long(youden_thresholds(preds, by), by, "class", F.col("k").cast("string"), ["threshold"]),
        _long(conf, by, "confusion", F.concat_ws(">", "y", "pred"), ["n"]),
        _long(reliability_bins(preds, by), by, "reliability", F.col("bin").cast("string"), ["n", "accuracy", "confidence"]),
    ]
    if groups and not by:
        parts.append(_long(group_bootstrap_ci(preds), by, "ci95", F.col("metric"), ["lo", "hi"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_comparison(preds: DataFrame, by: str = "model") -> DataFrame:
    """Headline metrics of several probability columns side by side, one row per model."""
    keys, conf = [by], confusion_counts(preds, [by])
    macro = averaged_prf(conf, keys).where("average = 'macro'").select(by, F.col("f1").alias("macro_f1"))
    return (accuracy_suite(preds, keys).join(kappa_mcc(conf, keys), by).join(ece(preds, keys), by).join(macro, by))
