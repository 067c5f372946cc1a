"""Calibration, uncertainty, morphology verification and auto-accept routing.

Cross-fitting is a key, not a loop: a row trains for every fold but its own, and the fitted
rules, thresholds and temperatures come back as small tables keyed by the held-out fold
(-1 is the deployed fit on all rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from diegrid.constants import FEATURE_LABELS
from diegrid.functions.arrays import clip, entropy, let, total
from diegrid.functions.prefix import exact_quantiles, running_totals
from diegrid.operators.metrics import youden_thresholds
from diegrid.sources.tables import stored

DEPLOYED = -1


def for_training(df: DataFrame, n_folds: int, deployed: bool = True) -> DataFrame:
    """One copy of each row per fit it may train: every held-out fold but its own, and the deployed fit."""
    held = F.array(*[F.lit(k) for k in ([DEPLOYED] if deployed else []) + list(range(n_folds))])
    return df.withColumn("held", F.explode(F.filter(held, lambda k: k != F.col("fold"))))


# ---------------------------------------------------------------- calibration
def _nll(z: Column, y: Column, t: Column) -> Column:
    """-ln softmax(z / e^t)[y], clipped."""
    scaled = F.transform(z, lambda x: x / F.exp(t))
    p = let(scaled, lambda v: let(F.array_max(v), lambda m: F.exp(F.get(v, y) - m) / total(F.transform(v, lambda x: F.exp(x - m)))))
    return -F.ln(clip(p, 1e-12, 1.0))


def fit_temperature(preds: DataFrame, by: list[str] = []) -> DataFrame:
    """Temperature e^t with the least mean NLL, t in [-4, 4], per key: three passes over a
    33-point grid, each 16 times finer. Only grid sums (keys x 33 numbers) reach the driver."""
    spark = preds.sparkSession
    centres: list[dict] | None = None
    for step in (1 / 4, 1 / 64, 1 / 1024):
        offsets = F.array(*[F.lit((i - 16) * step) for i in range(33)])
        if centres is None:
            rows = preds.withColumn("centre", F.lit(0.0))
        elif by:
            rows = preds.join(F.broadcast(spark.createDataFrame(centres, best.schema).select(*by, F.col("t").alias("centre"))), by)
        else:
            rows = preds.withColumn("centre", F.lit(centres[0]["t"]))
        grid = (rows.select(*by, "z", "y", F.explode(F.transform(offsets, lambda o: o + F.col("centre"))).alias("t")).where("t BETWEEN -4 AND 4")
                .groupBy(*by, "t").agg(F.avg(_nll(F.col("z"), F.col("y"), F.col("t"))).alias("nll")))
        best = grid.groupBy(*by).agg(F.min(F.struct("nll", "t")).alias("b")).select(*by, "b.t", "b.nll")
        centres = best.collect()
    fitted = spark.createDataFrame(centres, best.schema)
    return fitted.select(*by, F.exp("t").alias("temperature"), "nll")


# ---------------------------------------------------------------- uncertainty
def ensemble_disagreement(member_probs: DataFrame, key: str, n_classes: int) -> DataFrame:
    """Largest class standard deviation over members, and H(mean) - mean H. One shuffle."""
    g = member_probs.groupBy(key).agg(
        *[F.avg(F.col("p")[k]).alias(f"m{k}") for k in range(n_classes)], *[F.stddev_pop(F.col("p")[k]).alias(f"s{k}") for k in range(n_classes)],
        F.avg(entropy(F.col("p"))).alias("h"))
    mean = F.array(*[F.col(f"m{k}") for k in range(n_classes)])
    return g.select(key, F.greatest(*[F.col(f"s{k}") for k in range(n_classes)]).alias("ensemble_std"),
                    (entropy(mean) - F.col("h")).alias("mutual_info"), entropy(mean).alias("entropy"))


def tta_average(view_probs: DataFrame, key: str, n_classes: int) -> DataFrame:
    """Mean over input views, then over members."""
    cols = [F.avg(F.col("p")[k]).alias(f"m{k}") for k in range(n_classes)]
    per = view_probs.groupBy(key, "member").agg(*cols)
    return per.groupBy(key).agg(*[F.avg(f"m{k}").alias(f"m{k}") for k in range(n_classes)]).select(
        key, F.array(*[F.col(f"m{k}") for k in range(n_classes)]).alias("p"))


# ---------------------------------------------------------------- verification
def fit_verifier(long: DataFrame, by: list[str] = [], k: int = 4, lo: float = 0.01, hi: float = 0.99, min_rows: int = 10) -> DataFrame:
    """long(by.., cls, feature, value) -> rules(by.., cls, feature, lo, hi): per class the k features
    whose class mean is farthest from the mean of the rest, with the class's value range."""
    cls = long.groupBy(*by, "feature", "cls").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    tot = long.groupBy(*by, "feature").agg(F.count("*").alias("all_n"), F.sum("value").alias("all_s"), F.stddev_pop("value").alias("sd"))
    rest = (F.col("all_s") - F.col("s")) / F.when(F.col("all_n") > F.col("n"), F.col("all_n") - F.col("n"))
    gap = F.round(F.abs(F.col("s") / F.col("n") - rest) / (F.col("sd") + 1e-9), 9)
    w = Window.partitionBy(*by, "cls").orderBy(F.desc_nulls_last("gap"), "feature")
    chosen = (cls.where(F.col("n") >= min_rows).join(tot, [*by, "feature"]).select(*by, "cls", "feature", gap.alias("gap"))
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("gap"))
    values = long.join(F.broadcast(chosen), [*by, "cls", "feature"])       # at most k rules per class and fit
    return exact_quantiles(values, [*by, "cls", "feature"], "value", [lo, hi], buckets=16).select(
        *by, "cls", "feature", F.col("q0").alias("lo"), F.col("q1").alias("hi"))


def format_3g(v: Column) -> Column:
    """Three significant digits, trailing zeros dropped, as %.3g prints."""
    e = F.floor(F.log10(F.abs(v)))
    out = F.when(v == 0, "0")
    for k in range(-4, 3):
        out = out.when(e == k, F.regexp_replace(F.format_string(f"%.{2 - k}f", v), r"(\.\d*?)0+$", "$1"))
    sci = F.regexp_replace(F.format_string("%.2e", v), r"(\.\d*?)0+e", "$1e")
    return F.regexp_replace(out.otherwise(sci), r"\.($|e)", "$1")


def verify(df: DataFrame, rules: DataFrame, cls: str, by: list[str] = [], prefix: str = "") -> DataFrame:
    """Adds <prefix>status and <prefix>reasons for the class in column `cls`.

    df has `features`, a map from name to value. A class has at most k rules, so the rules travel
    as one array per class in a broadcast; rows are neither exploded nor shuffled.
    """
    packed = rules.groupBy(*by, F.col("cls").alias(cls)).agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi"))).alias("_rules"))
    label = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    joined = df.join(F.broadcast(packed), [*by, cls], "left")
    checked = F.transform(F.coalesce("_rules", F.array().cast("array<struct<feature:string,lo:double,hi:double>>")), lambda r: F.struct(
        r["feature"].alias("feature"), F.try_element_at("features", r["feature"]).alias("v"), r["lo"].alias("lo"), r["hi"].alias("hi")))
    margin = lambda r: 0.05 * (r["hi"] - r["lo"] + 1e-9)
    bad = F.filter(checked, lambda r: ~F.coalesce(r["v"].between(r["lo"] - margin(r), r["hi"] + margin(r)), F.lit(False)))      # a missing value fails
    out = joined.withColumn("_bad", bad)
    reasons = F.transform("_bad", lambda r: F.concat(
        F.coalesce(F.try_element_at(label, r["feature"]), r["feature"]), F.lit(" = "), F.when(r["v"].isNull(), F.lit("missing")).otherwise(format_3g(r["v"])), F.lit(", but "), F.col(cls),
        F.lit(" wafers here show "), format_3g(r["lo"]), F.lit("-"), format_3g(r["hi"])))
    status = F.when(F.size("_bad") == 0, "PASS").when(F.size("_bad") == 1, "WARN").otherwise("FAIL")
    return out.select(*df.columns, status.alias(f"{prefix}status"), reasons.alias(f"{prefix}reasons"))


def verification_checks(df: DataFrame, rules: DataFrame, cls: str, by: list[str] = []) -> DataFrame:
    """Adds `checks`: for every rule of the class in `cls` the feature, its value, the expected range and whether
    it is kept, as `verify` judges it; empty without rules."""
    packed = rules.groupBy(*by, F.col("cls").alias(cls)).agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi"))).alias("_rules"))
    margin = lambda r: 0.05 * (r["hi"] - r["lo"] + 1e-9)

    def check(r: Column) -> Column:
        v = F.try_element_at("features", r["feature"])
        return F.struct(r["feature"].alias("feature"), F.round(v, 4).alias("value"), F.round(r["lo"], 4).alias("lo"), F.round(r["hi"], 4).alias("hi"),
                        F.coalesce(v.between(r["lo"] - margin(r), r["hi"] + margin(r)), F.lit(False)).alias("ok"))

    joined = df.join(F.broadcast(packed), [*by, cls], "left")            # at most k rules per class and fit
    return joined.select(*df.columns, F.coalesce(F.transform("_rules", check), F.array().cast(
        "array<struct<feature:string,value:double,lo:double,hi:double,ok:boolean>>")).alias("checks"))


def write_policy(path: str, **tables: DataFrame) -> None:
    """Saves fitted tables (rules, thresholds, temperatures ..) by name, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_policy(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The saved tables of a policy; a name that was not saved is an error."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}


def verification_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


# ---------------------------------------------------------------- routing
def pick_thresholds(df: DataFrame, targets: list[float], by: list[str] = []) -> DataFrame:
    """df(by.., conf, correct): per target the lowest confidence whose accepted set {conf >= t}
    still reaches the target accuracy; (1.01, 0, NULL) if none does.

    Equal confidences are accepted together, as the threshold is applied. All targets share one
    running total.
    """
    t = df.groupBy(*by, "conf").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("ok"))
    r = running_totals(t, by, "conf", ["n", "ok"], descending=True)
    best = [F.max(F.when(F.col("run_ok") / F.col("run_n") >= tg, F.struct(
        F.col("run_n").alias("n"), F.col("conf").alias("t"), (F.col("run_ok") / F.col("run_n")).alias("a")))).alias(f"b{i}")
            for i, tg in enumerate(targets)]
    g = r.groupBy(*by).agg(F.max("all_n").alias("N"), *best)
    rows = F.array(*[F.struct(F.lit(float(tg)).alias("target"), F.coalesce(F.col(f"b{i}.t"), F.lit(1.01)).alias("threshold"),
                              F.coalesce(F.col(f"b{i}.n") / F.col("N"), F.lit(0.0)).alias("coverage"), F.col(f"b{i}.a").alias("accuracy"))
                     for i, tg in enumerate(targets)])
    return g.select(*by, F.inline(rows))


def decide(df: DataFrame, threshold: float | Column, auto_correct: bool = False, correct_min_prob: float = 0.2) -> DataFrame:
    """df(top, second, conf, p2, status, second_status) -> final class, action, confidence, note."""
    switch = F.lit(auto_correct) & (F.col("status") == "FAIL") & (F.col("second_status") == "PASS") & (F.col("p2") >= correct_min_prob)
    note = F.when(switch, F.concat(F.lit("top class "), F.col("top").cast("string"), F.lit(" failed morphology checks; runner-up "),
                                   F.col("second").cast("string"), F.lit(" passed")))
    conf = F.when(switch, F.col("p2")).otherwise(F.col("conf"))
    accept = (conf >= threshold) & (F.col("status") != "FAIL") & ~switch
    return df.select("*", F.when(switch, F.col("second")).otherwise(F.col("top")).alias("final"),
                     F.when(accept, "auto_accept").otherwise("human_review").alias("action"), conf.alias("confidence"), note.alias("note"))


def route_cascade(df: DataFrame, fast_threshold: float, full_threshold: float, mode: str = "auto") -> DataFrame:
    """df(fast_top, fast_conf, fast_status, top, conf, status): the fast path needs PASS, the full
    path only excludes FAIL."""
    fast_ok = (F.col("fast_conf") >= fast_threshold) & (F.col("fast_status") == "PASS")
    fast = F.lit(mode == "fast") | (F.lit(mode == "auto") & fast_ok)
    full_ok = (F.col("conf") >= full_threshold) & (F.col("status") != "FAIL")
    return df.select("*", F.lit(mode).alias("mode"), F.when(fast, "fast").otherwise("full").alias("path"),
                     F.when(fast, F.col("fast_top")).otherwise(F.col("top")).alias("final"),
                     F.when(F.when(fast, fast_ok).otherwise(full_ok), "auto_accept").otherwise("human_review").alias("action"))


def crossfit_thresholds(df: DataFrame, targets: list[float], n_folds: int) -> DataFrame:
    """`pick_thresholds` for every held-out fold and for deployment, from the eligible rows. One aggregate by
    confidence carries the counts of all folds; what a fold may learn from is the total without its own."""
    correct, own = F.col("correct").cast("long"), range(n_folds)
    t = df.where("eligible").groupBy("conf").agg(
        F.count("*").alias("n"), F.sum(correct).alias("ok"), *[F.count_if(F.col("fold") == k).alias(f"n{k}") for k in own],
        *[F.coalesce(F.sum(F.when(F.col("fold") == k, correct)), F.lit(0)).alias(f"ok{k}") for k in own])
    r = running_totals(t, [], "conf", ["n", "ok", *[f"{m}{k}" for k in own for m in ("n", "ok")]], descending=True)

    def sums(k: int) -> tuple[Column, Column, Column]:
        if k == DEPLOYED:
            return F.col("run_n"), F.col("run_ok"), F.col("all_n")
        return F.col("run_n") - F.col(f"run_n{k}"), F.col("run_ok") - F.col(f"run_ok{k}"), F.col("all_n") - F.col(f"all_n{k}")

    best, folds = [], [DEPLOYED, *own]
    for k in folds:
        n, ok, total_ = sums(k)
        best.append(F.max(total_).alias(f"N{k + 1}"))
        best += [F.max(F.when(F.try_divide(ok, n) >= tg, F.struct(n.alias("n"), F.col("conf").alias("t"), (ok / n).alias("a")))).alias(f"b{k + 1}_{i}") for i, tg in enumerate(targets)]
    rows = F.array(*[F.struct(F.lit(k).alias("held"), F.lit(float(tg)).alias("target"), F.coalesce(F.col(f"b{k + 1}_{i}.t"), F.lit(1.01)).alias("threshold"),
                              F.coalesce(F.try_divide(F.col(f"b{k + 1}_{i}.n"), F.col(f"N{k + 1}")), F.lit(0.0)).alias("coverage"), F.col(f"b{k + 1}_{i}.a").alias("accuracy"))
                     for k in folds for i, tg in enumerate(targets)])
    return r.agg(*best).select(F.inline(rows))


def crossfit_route(df: DataFrame, targets: list[float], n_folds: int) -> DataFrame:
    """df(.., fold, conf, correct, eligible) -> one row per row and target with the accept flag,
    judged by the threshold learned on the other folds."""
    t = crossfit_thresholds(df, targets, n_folds).select(F.col("held").alias("fold"), "target", "threshold")
    held = df.select("*", F.explode(F.array(*[F.lit(float(x)) for x in targets])).alias("target"))
    return (held.join(F.broadcast(t), ["fold", "target"], "left")
            .withColumn("accept", F.col("eligible") & (F.col("conf") >= F.coalesce("threshold", F.lit(1.01)))))


def cascade_report(df: DataFrame, by: list[str] = []) -> DataFrame:
    """df(by.., fast, full, sys_ok) -> coverage, accuracy on accepted, review share, errors caught / passed."""
    auto, ok = F.col("fast") | F.col("full"), F.col("sys_ok")
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(auto).alias("auto"), F.count_if(auto & ok).alias("auto_ok"),
                            F.count_if(~ok & ~auto).alias("errors_caught"), F.count_if(~ok & auto).alias("errors_passed"),
                            F.count_if("fast").alias("fast_accepted"))
    return g.select(*by, "n", (F.col("auto") / F.col("n")).alias("coverage"), F.try_divide("auto_ok", "auto").alias("accuracy"),
                    (1 - F.col("auto") / F.col("n")).alias("review"), "errors_caught", "errors_passed", "fast_accepted")


def cascade(fast: DataFrame, full: DataFrame, fast_target: float, targets: list[float], n_folds: int) -> DataFrame:
    """The whole auto cascade, cross-fitted, for several full-path targets.

    fast(vec_id, fold, conf, correct, status) is judged first; full(vec_id, conf, correct, status)
    only learns and judges what the fast path did not accept. Both are read for the thresholds and again for the
    routes, so each is stored once.
    """
    fast = stored(fast.select("vec_id", "fold", "conf", "correct", (F.col("status") == "PASS").alias("eligible")), "fast")
    f = crossfit_route(fast, [fast_target], n_folds)
    both = (f.select("vec_id", "fold", F.col("accept").alias("fast"), F.col("correct").alias("fast_ok"))
            .join(full.select("vec_id", "conf", "correct", "status"), "vec_id")
            .withColumn("eligible", ~F.col("fast") & (F.col("status") != "FAIL")))
    routed = crossfit_route(stored(both, "both"), targets, n_folds)
    return routed.select("vec_id", "target", "fast", F.col("accept").alias("full"),
                         F.when(F.col("fast"), F.col("fast_ok")).otherwise(F.col("correct")).alias("sys_ok"))


def secondary_alarm_rate(preds: DataFrame, n_folds: int, n_classes: int, baseline: int) -> DataFrame:
    """Mean number of other classes above their cross-fitted Youden threshold."""
    thr = youden_thresholds(for_training(preds, n_folds, deployed=False), ["held"])
    packed = thr.groupBy(F.col("held").alias("fold")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "threshold"))), lambda s: s["threshold"]).alias("thr"))
    hits = F.filter(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (
        F.get("p", k) >= F.get("thr", k)) & (k != F.col("pred")) & (k != baseline))
    return preds.join(F.broadcast(packed), "fold").agg(F.avg(F.size(hits)).alias("alarms_per_row"))


def auto_correct_test(df: DataFrame) -> DataFrame:
    """Does switching to the runner-up raise accuracy?"""
    d = decide(df, 1.01, auto_correct=True)
    return (d.agg(F.avg((F.col("top") == F.col("y")).cast("int")).alias("accuracy"), F.avg((F.col("final") == F.col("y")).cast("int")).alias("corrected"),
                  F.count_if(F.col("note").isNotNull()).alias("switched"))
            .withColumn("enable", F.col("corrected") > F.col("accuracy")))
