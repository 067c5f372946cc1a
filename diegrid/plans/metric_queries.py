"""Queries over predictions: evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.functions import arrays as A
from diegrid.operators import dies as D, metrics as E
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V

C = V.N_CLASSES

cte("v_conf", "SELECT y, pred, count(*) AS n FROM v_top GROUP BY 1, 2")


def scores_cte(name: str, conf: str, by: str = "") -> None:
    """Per-class scores of a table of confusion counts, classes present only."""
    b = by + ", " if by else ""
    cte(name, f"""
SELECT {b}k, sum(tp) AS tp, sum(sup) AS support, sum(prd) AS predicted, coalesce(sum(tp) / nullif(sum(prd), 0), 0) AS precision,
       coalesce(sum(tp) / nullif(sum(sup), 0), 0) AS recall, 2 * sum(tp) / (sum(sup) + sum(prd)) AS f1
FROM (SELECT {b}y AS k, CASE WHEN y = pred THEN n ELSE 0 END AS tp, n AS sup, 0 AS prd FROM {conf}
      UNION ALL SELECT {b}pred, 0, 0, n FROM {conf}) GROUP BY {b}k""")


scores_cte("v_cscore", "v_conf")


@query("confusion_matrix", f"""
SELECT CAST(a AS INT) AS y, CAST(b AS INT) AS pred, coalesce(n, 0) AS n
FROM (SELECT unnest(range({C})) AS a), (SELECT unnest(range({C})) AS b) LEFT JOIN v_conf ON y = a AND pred = b""")
def _(spark, sf):
    return E.confusion_matrix(V.probs(spark, sf), C)


@query("per_class_prf", f"""
SELECT CAST(a AS INT) AS k, {R('coalesce(precision, 0)')} AS precision, {R('coalesce(recall, 0)')} AS recall, {R('coalesce(f1, 0)')} AS f1,
       CAST(coalesce(support, 0) AS BIGINT) AS support FROM (SELECT unnest(range({C})) AS a) LEFT JOIN v_cscore ON k = a""")
def _(spark, sf):
    return D.rounded(E.per_class_prf(V.probs(spark, sf), C), "precision", "recall", "f1")


cte("v_avg", """
SELECT 'macro' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM v_cscore
UNION ALL SELECT 'micro', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support) FROM v_cscore
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM v_cscore""")


@query("averaged_prf", f"SELECT average, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1 FROM v_avg")
def _(spark, sf):
    return D.rounded(E.averaged_prf(E.confusion_counts(V.probs(spark, sf))), "precision", "recall", "f1")


cte("v_rank", "SELECT vec_id, y, k, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS rk FROM v_prob")
cte("v_acc", """
SELECT count(*) AS n, avg(CASE WHEN rk = 1 THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN rk <= 2 THEN 1.0 ELSE 0 END) AS top2_accuracy,
       (SELECT avg(a) FROM (SELECT y, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS a FROM v_top GROUP BY 1)) AS balanced_accuracy
FROM v_rank WHERE y = k""")


@query("accuracy_suite", f"""
SELECT n, {R('accuracy')} AS accuracy, {R('balanced_accuracy')} AS balanced_accuracy, {R('top2_accuracy')} AS top2_accuracy FROM v_acc""")
def _(spark, sf):
    return D.rounded(E.accuracy_suite(V.probs(spark, sf)), "accuracy", "balanced_accuracy", "top2_accuracy")


cte("v_kappa", """
SELECT (c * s - st) / (s * s - st) AS kappa, coalesce((c * s - st) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0) AS mcc
FROM (SELECT CAST(sum(support) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(support * predicted) AS DOUBLE) AS st,
             CAST(sum(support * support) AS DOUBLE) AS tt, CAST(sum(predicted * predicted) AS DOUBLE) AS pp FROM v_cscore)""")


@query("kappa_mcc", f"SELECT {R('kappa')} AS kappa, {R('mcc')} AS mcc FROM v_kappa")
def _(spark, sf):
    return D.rounded(E.kappa_mcc(E.confusion_counts(V.probs(spark, sf))), "kappa", "mcc")


cte("v_bin", """
SELECT CAST(ceil(round(conf * 15, 9)) AS INT) AS bin, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS accuracy, avg(conf) AS confidence
FROM v_top GROUP BY 1""")
cte("v_ece", "SELECT sum(n * abs(accuracy - confidence)) FILTER (bin > 0) / sum(n) AS ece FROM v_bin")


@query("ece", f"SELECT {R('ece')} AS ece FROM v_ece")
def _(spark, sf):
    return D.rounded(E.ece(V.probs(spark, sf)), "ece")


@query("reliability_bins", f"""
SELECT bin, {R('(bin - 1) / 15')} AS lo, {R('bin / 15')} AS hi, n, {R('accuracy')} AS accuracy, {R('confidence')} AS confidence FROM v_bin WHERE bin > 0""")
def _(spark, sf):
    return D.rounded(E.reliability_bins(V.probs(spark, sf)), "lo", "hi", "accuracy", "confidence")


cte("v_auc", """
SELECT k, (sum(rk) FILTER (y = k) - count(*) FILTER (y = k) * (count(*) FILTER (y = k) + 1) / 2)
          / nullif(count(*) FILTER (y = k) * count(*) FILTER (y <> k), 0) AS auc
FROM (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS rk FROM v_prob) GROUP BY 1""")


@query("auc_ovr", f"SELECT k, {R('auc')} AS auc FROM v_auc")
def _(spark, sf):
    return D.rounded(E.auc_ovr(V.probs(spark, sf)), "auc")


def youden_sql(source: str, by: str = "") -> str:
    """Threshold per class from source(by, k, y, p)."""
    b = by + ", " if by else ""
    return f"""
SELECT {b}k, CASE WHEN max(tot_p) = 0 OR max(tot_n) = 0 THEN 0.5 WHEN max(j) <= 0 THEN 1.0
       ELSE greatest(0, least(1, arg_max(p, (j, p)))) END AS threshold
FROM (SELECT {b}k, p, tot_p, tot_n, run_p * tot_n - run_n * tot_p AS j FROM (
  SELECT {b}k, p, sum(pos) OVER w AS run_p, sum(neg) OVER w AS run_n, sum(pos) OVER (PARTITION BY {b}k) AS tot_p, sum(neg) OVER (PARTITION BY {b}k) AS tot_n
  FROM (SELECT {b}k, p, count(*) FILTER (y = k) AS pos, count(*) FILTER (y <> k) AS neg FROM {source} GROUP BY {b}k, p)
  WINDOW w AS (PARTITION BY {b}k ORDER BY p DESC))) GROUP BY {b}k"""


cte("v_youden", youden_sql("v_prob"))


@query("youden_thresholds", f"SELECT k, {R('threshold')} AS threshold FROM v_youden")
def _(spark, sf):
    return D.rounded(E.youden_thresholds(V.probs(spark, sf)), "threshold")


@query("pr_curve", f"""
WITH c AS (
  SELECT row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n, sum(pos) OVER w / sum(pos + neg) OVER w AS prec,
         sum(pos) OVER w / sum(pos) OVER () AS rec, pos / sum(pos) OVER () AS gain
  FROM (SELECT p, count(*) FILTER (y = k) AS pos, count(*) FILTER (y <> k) AS neg FROM v_prob GROUP BY 1) WINDOW w AS (ORDER BY p DESC))
SELECT CAST(i AS BIGINT) AS pos_asc, {R('prec')} AS precision, {R('rec')} AS recall, {R('(SELECT sum(gain * prec) FROM c)')} AS average_precision
FROM (SELECT i, prec, rec FROM c UNION ALL SELECT max(n), 1, 0 FROM c)
""".replace("WITH c AS", "SELECT * FROM (WITH c AS").rstrip() + ")")
def _(spark, sf):
    return D.rounded(E.pr_curve(V.probs(spark, sf)), "precision", "recall", "average_precision")


def mix_sql(x: str, salt: str) -> str:
    a = f"((CAST({x} AS BIGINT) * 2654435761 + ({salt}) * 40503) % 4294967296)"
    return f"(({a} % 65536 * 48271 + ({a} // 65536) * 69621) % 2147483647)"


cte("v_gidx", "SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS g FROM (SELECT DISTINCT grp FROM v_top)")
cte("v_inner", f"SELECT rep, {mix_sql('idx', 'rep')} AS h, g FROM v_gidx, (SELECT unnest(range(300)) AS rep)")
cte("v_drawn", f"SELECT rep, {mix_sql('h', 'rep + 17')} % g AS idx, count(*) AS m FROM v_inner GROUP BY 1, 2")
cte("v_repconf", """
SELECT rep, y, pred, sum(m) AS n FROM v_drawn JOIN v_gidx USING (idx) JOIN v_top USING (grp) GROUP BY 1, 2, 3""")
scores_cte("v_repscore", "v_repconf", "rep")
cte("v_ci", """
SELECT 'accuracy' AS metric, quantile_cont(a, 0.025) AS lo, quantile_cont(a, 0.975) AS hi FROM (SELECT rep, sum(tp) / sum(support) AS a FROM v_repscore GROUP BY 1)
UNION ALL SELECT 'macro_f1', quantile_cont(f, 0.025), quantile_cont(f, 0.975) FROM (SELECT rep, avg(f1) AS f FROM v_repscore GROUP BY 1)""")


@query("group_bootstrap_ci", f"SELECT metric, {R('lo')} AS lo, {R('hi')} AS hi FROM v_ci")
def _(spark, sf):
    return D.rounded(E.group_bootstrap_ci(V.probs(spark, sf)), "lo", "hi")


def _long_sql(source: str, section: str, label: str, names: list[str]) -> list[str]:
    return [f"SELECT '{section}' AS section, {label} AS label, '{n}' AS metric, {R(n)} AS value FROM {source}" for n in names]


@query("full_report", "\nUNION ALL ".join(
    _long_sql("v_acc", "overall", "''", ["n", "accuracy", "balanced_accuracy", "top2_accuracy"])
    + _long_sql("v_kappa", "overall", "''", ["kappa", "mcc"]) + _long_sql("v_ece", "overall", "''", ["ece"])
    + _long_sql("v_avg", "average", "average", ["precision", "recall", "f1"])
    + _long_sql("v_cscore", "class", "CAST(k AS VARCHAR)", ["precision", "recall", "f1", "support"])
    + _long_sql("v_auc", "class", "CAST(k AS VARCHAR)", ["auc"]) + _long_sql("v_youden", "class", "CAST(k AS VARCHAR)", ["threshold"])
    + _long_sql("v_conf", "confusion", "y || '>' || pred", ["n"])
    + _long_sql("v_bin", "reliability", "CAST(bin AS VARCHAR)", ["n", "accuracy", "confidence"])
    + _long_sql("v_ci", "ci95", "metric", ["lo", "hi"])))
def _(spark, sf):
    return D.rounded(E.full_report(V.probs(spark, sf)), "value")


def models(spark, sf):
    """Three probability columns of the same logits as one table keyed by model."""
    z = F.col("z")
    options = {"softmax": A.softmax(z), "tempered": A.tempered_softmax(z, 0.5), "evidential": A.dirichlet(z)[0]}
    long = V.preds(spark, sf).select("vec_id", "y", "grp", "fold", F.explode(F.create_map(*[
        x for name, p in options.items() for x in (F.lit(name), F.transform(p, lambda v: F.round(v, 12)))])).alias("model", "p"))
    return long.select("*", A.argmax(F.col("p")).alias("pred"), F.array_max("p").alias("conf"))


cte("v_models", """
SELECT 'softmax' AS model, vec_id, y, k, p FROM v_prob
UNION ALL SELECT 'tempered', vec_id, y, k, round(e / sum(e) OVER (PARTITION BY vec_id), 12)
FROM (SELECT *, exp((z - max(z) OVER (PARTITION BY vec_id)) / 0.5) AS e FROM v_preds)
UNION ALL SELECT 'evidential', vec_id, y, k, round(a / sum(a) OVER (PARTITION BY vec_id), 12) FROM (SELECT *, ln(1 + exp(z)) + 1 AS a FROM v_preds)""")
cte("v_mtop", "SELECT model, vec_id, y, max(p) AS conf, arg_max(k, (p, -k)) AS pred FROM v_models GROUP BY 1, 2, 3")
cte("v_mconf", "SELECT model, y, pred, count(*) AS n FROM v_mtop GROUP BY 1, 2, 3")
scores_cte("v_mscore", "v_mconf", "model")


@query("model_comparison", f"""
SELECT model, n, {R('accuracy')} AS accuracy, {R('balanced_accuracy')} AS balanced_accuracy, {R('top2_accuracy')} AS top2_accuracy,
       {R('(c * s - st) / (s * s - st)')} AS kappa, {R('(c * s - st) / sqrt((s * s - pp) * (s * s - tt))')} AS mcc, {R('ece')} AS ece, {R('macro_f1')} AS macro_f1
FROM (SELECT model, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS accuracy FROM v_mtop GROUP BY 1)
JOIN (SELECT model, avg(a) AS balanced_accuracy FROM (SELECT model, y, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS a FROM v_mtop GROUP BY 1, 2) GROUP BY 1) USING (model)
JOIN (SELECT model, avg(CASE WHEN rk <= 2 THEN 1.0 ELSE 0 END) AS top2_accuracy FROM (
        SELECT model, y, k, row_number() OVER (PARTITION BY model, vec_id ORDER BY p DESC, k) AS rk FROM v_models) WHERE y = k GROUP BY 1) USING (model)
JOIN (SELECT model, CAST(sum(support) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(support * predicted) AS DOUBLE) AS st,
             CAST(sum(support * support) AS DOUBLE) AS tt, CAST(sum(predicted * predicted) AS DOUBLE) AS pp, avg(f1) AS macro_f1 FROM v_mscore GROUP BY 1) USING (model)
JOIN (SELECT model, sum(n * abs(a - c)) / sum(n) AS ece FROM (
        SELECT model, ceil(round(conf * 15, 9)) AS bin, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS a, avg(conf) AS c FROM v_mtop GROUP BY 1, 2)
      GROUP BY 1) USING (model)""")
def _(spark, sf):
    return D.rounded(E.model_comparison(models(spark, sf)), "accuracy", "balanced_accuracy", "top2_accuracy", "kappa", "mcc", "ece", "macro_f1")
