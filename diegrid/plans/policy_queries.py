"""Queries over calibration, uncertainty, verification and routing.

The 64 embedding values play the features; class k is named after its index.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.functions import arrays as A
from diegrid.functions.numeric import r6
from diegrid.operators import dies as D, policy as P
from diegrid.plans.metric_queries import youden_sql
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V
from diegrid.sources.tables import shared_path, stored

C, FOLDS = V.N_CLASSES, 5
FAST_TARGET, TARGETS = 0.6, [0.5, 0.6, 0.8]


# ---------------------------------------------------------------- calibration
def _nll_sql(t: str) -> str:
    return f"-ln(greatest(1e-12, least(1, exp((zy - mz) / exp({t})) / list_sum(list_transform(zs, lambda x: exp((x - mz) / exp({t})))))))"


cte("v_zrow", "SELECT vec_id, y, fold, list(z ORDER BY k) AS zs, max(z) AS mz, max(z) FILTER (k = y) AS zy FROM v_preds GROUP BY 1, 2, 3")
cte("v_zfit", "SELECT 'all' AS fit, * FROM v_zrow UNION ALL SELECT 'without ' || h, z.* FROM v_zrow z, (SELECT unnest(range(5)) AS h) WHERE h <> fold")
for _n, (_prev, _step) in enumerate((("(SELECT DISTINCT fit, 0.0 AS t FROM v_zfit)", "4"), ("v_temp1", "64"), ("v_temp2", "1024")), 1):
    cte(f"v_temp{_n}", f"""
SELECT fit, arg_min(t, (nll, t)) AS t, min(nll) AS nll FROM (
  SELECT fit, g.t, avg({_nll_sql('g.t')}) AS nll
  FROM v_zfit JOIN (SELECT fit, CAST(t AS DOUBLE) + (i - 16) / {_step}.0 AS t FROM {_prev}, (SELECT unnest(range(33)) AS i)) g USING (fit)
  WHERE g.t BETWEEN -4 AND 4 GROUP BY 1, 2) GROUP BY 1""")


@query("fit_temperature", f"SELECT {R('exp(t)')} AS temperature, {R('nll')} AS nll FROM v_temp3 WHERE fit = 'all'")
def _(spark, sf):
    return D.rounded(P.fit_temperature(V.preds(spark, sf)), "temperature", "nll")


@query("crossfit_temperature", f"""
SELECT vec_id, {R('exp(t)')} AS temperature, {R('exp((mz - mz) / exp(t)) / list_sum(list_transform(zs, lambda x: exp((x - mz) / exp(t))))')} AS conf
FROM v_zrow JOIN v_temp3 ON fit = 'without ' || fold""")
def _(spark, sf):
    preds = V.preds(spark, sf)
    t = P.fit_temperature(P.for_training(preds, FOLDS, deployed=False), ["held"]).withColumnRenamed("held", "fold")
    out = preds.join(F.broadcast(t), "fold").withColumn("conf", F.array_max(A.tempered_softmax(F.col("z"), F.col("temperature"))))
    return D.rounded(out.select("vec_id", "temperature", "conf"), "temperature", "conf")


# ---------------------------------------------------------------- uncertainty
cte("v_mcent", "SELECT m, y AS k, i, avg(v) AS c FROM v_vec, (SELECT unnest(range(5)) AS m) WHERE fold <> m GROUP BY 1, 2, 3")
cte("v_mprob", """
SELECT vec_id, y, fold, m, k, e / sum(e) OVER (PARTITION BY vec_id, m) AS p FROM (
  SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id, m)) AS e FROM (
    SELECT vec_id, y, fold, m, k, round(10 * sum(v * c), 9) AS z FROM v_vec JOIN v_mcent USING (i) GROUP BY 1, 2, 3, 4, 5))""")
cte("v_vprob", """
SELECT vec_id, m, t, k, e / sum(e) OVER (PARTITION BY vec_id, m, t) AS p FROM (
  SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id, m, t)) AS e FROM (
    SELECT vec_id, m, t, k, round(10 * sum(v * c), 9) AS z FROM v_vec JOIN v_mcent USING (i), (SELECT unnest(range(8)) AS t)
    WHERE i % 8 <> t GROUP BY 1, 2, 3, 4))""")


def member_probs(spark, sf, views=False):
    return V.member_preds(spark, sf, views).withColumn("p", A.softmax(F.col("z")))


def _h(p: str) -> str:
    return f"-sum({p} * ln(greatest(1e-12, least(1, {p}))))"


@query("ensemble_disagreement", f"""
SELECT vec_id, {R('s')} AS ensemble_std, {R('h - mh')} AS mutual_info, {R('h')} AS entropy
FROM (SELECT vec_id, max(s) AS s, {_h('a')} AS h FROM (SELECT vec_id, k, avg(p) AS a, stddev_pop(p) AS s FROM v_mprob GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT vec_id, avg(h) AS mh FROM (SELECT vec_id, m, {_h('p')} AS h FROM v_mprob GROUP BY 1, 2) GROUP BY 1) USING (vec_id)""")
def _(spark, sf):
    return D.rounded(P.ensemble_disagreement(member_probs(spark, sf), "vec_id", C), "ensemble_std", "mutual_info", "entropy")


@query("tta_average", f"""
SELECT vec_id, k, {R('avg(p)')} AS p FROM (SELECT vec_id, m, k, avg(p) AS p FROM v_vprob GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, sf):
    return D.rounded(P.tta_average(member_probs(spark, sf, True), "vec_id", C).select("vec_id", F.posexplode("p").alias("k", "p")), "p")


# ---------------------------------------------------------------- verification
def feature_rows(spark, sf):
    return V.embeddings(spark, sf, dealt=True).select("vec_id", "fold", F.col("y").cast("string").alias("cls"), F.posexplode("embedding").alias("i", "v")).select(
        "vec_id", "fold", "cls", F.concat(F.lit("e"), F.col("i").cast("string")).alias("feature"), F.col("v").cast("double").alias("value"))


def feature_map(spark, sf):
    names = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("e"), i.cast("string")))
    return V.embeddings(spark, sf, dealt=True).select("vec_id", F.map_from_arrays(names, F.col("embedding").cast("array<double>")).alias("features"))


cte("v_frow", "SELECT vec_id, fold, CAST(y AS VARCHAR) AS cls, 'e' || i AS feature, v AS value FROM v_vec")
cte("v_ftrain", "SELECT -1 AS held, * FROM v_frow UNION ALL SELECT CAST(h AS INT), v_frow.* FROM v_frow, (SELECT unnest(range(5)) AS h) WHERE h <> fold")
cte("v_rules", """
SELECT held, cls, feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM v_ftrain JOIN (
  SELECT held, cls, feature, row_number() OVER (PARTITION BY held, cls ORDER BY round(abs(s / n - (ts - s) / nullif(tn - n, 0)) / (sd + 1e-9), 9) DESC, feature) AS rk
  FROM (SELECT held, feature, cls, count(*) AS n, sum(value) AS s FROM v_ftrain GROUP BY 1, 2, 3 HAVING count(*) >= 10)
  JOIN (SELECT held, feature, count(*) AS tn, sum(value) AS ts, stddev_pop(value) AS sd FROM v_ftrain GROUP BY 1, 2) USING (held, feature)
) USING (held, cls, feature) WHERE rk <= 4 GROUP BY 1, 2, 3""")
cte("v_check", """
SELECT r.held, f.vec_id, r.cls, r.feature, f.value, r.lo, r.hi,
       NOT f.value BETWEEN r.lo - 0.05 * (r.hi - r.lo + 1e-9) AND r.hi + 0.05 * (r.hi - r.lo + 1e-9) AS bad
FROM v_rules r JOIN v_frow f USING (feature)""")
cte("v_status", """
SELECT held, vec_id, c AS cls, CASE WHEN coalesce(b, 0) = 0 THEN 'PASS' WHEN b = 1 THEN 'WARN' ELSE 'FAIL' END AS status
FROM (SELECT h AS held, vec_id, c FROM (SELECT unnest(range(-1, 5)) AS h), (SELECT CAST(unnest(range(10)) AS VARCHAR) AS c), (SELECT DISTINCT vec_id FROM v_vec))
LEFT JOIN (SELECT held, vec_id, cls AS c, count(*) FILTER (bad) AS b FROM v_check GROUP BY 1, 2, 3) USING (held, vec_id, c)""")


@query("fit_verifier", f"SELECT cls, feature, {R('lo')} AS lo, {R('hi')} AS hi FROM v_rules WHERE held = -1")
def _(spark, sf):
    return D.rounded(P.fit_verifier(feature_rows(spark, sf)), "lo", "hi")


@query("verify", """
SELECT t.vec_id, t.pred AS top, s.status, coalesce(reasons, '') AS reasons
FROM v_top t JOIN v_status s ON s.held = -1 AND s.vec_id = t.vec_id AND s.cls = CAST(t.pred AS VARCHAR)
LEFT JOIN (SELECT vec_id, cls, string_agg(format('{} = {:.3g}, but {} wafers here show {:.3g}-{:.3g}', feature, value, cls, lo, hi), '; ' ORDER BY feature) AS reasons
           FROM v_check WHERE held = -1 AND bad GROUP BY 1, 2) c ON c.vec_id = t.vec_id AND c.cls = CAST(t.pred AS VARCHAR)""")
def _(spark, sf):
    rows = V.probs(spark, sf).select("vec_id", "pred", F.col("pred").cast("string").alias("top")).join(feature_map(spark, sf), "vec_id")
    return P.verify(rows, P.fit_verifier(feature_rows(spark, sf)), "top").select(
        "vec_id", F.col("pred").alias("top"), "status", F.array_join("reasons", "; ").alias("reasons"))


@query("verification_checks", """
SELECT t.vec_id, feature, round(value, 4) AS value, round(lo, 4) AS lo, round(hi, 4) AS hi, NOT bad AS ok
FROM v_top t JOIN v_check c ON c.held = -1 AND c.vec_id = t.vec_id AND c.cls = CAST(t.pred AS VARCHAR)""")
def _(spark, sf):
    """By rules that were saved and read again."""
    path = shared_path(spark, "policy")
    P.write_policy(path, rules=P.fit_verifier(feature_rows(spark, sf)))
    rows = V.probs(spark, sf).select("vec_id", F.col("pred").cast("string").alias("top")).join(feature_map(spark, sf), "vec_id")
    checked = P.verification_checks(rows, P.read_policy(spark, path, "rules")["rules"], "top")
    return checked.select("vec_id", F.inline("checks"))


def fold_rules(spark, sf):
    """The verifier's rules for each held-out fold."""
    return P.fit_verifier(P.for_training(feature_rows(spark, sf), FOLDS, deployed=False), ["held"]).withColumnRenamed("held", "fold")


def judged(spark, sf, fit: str, tempered: bool = False, members: bool = False, rules=None):
    """Predictions with runner-up and verification of both classes; fit = 'fold' (cross-fitted, by `rules` if they are at hand) or 'all'."""
    if members:
        cols = [F.avg(F.col("p")[k]).alias(f"m{k}") for k in range(C)]
        rows = member_probs(spark, sf).groupBy("vec_id", "y", "grp", "fold").agg(*cols).withColumn(
            "p", F.array(*[F.round(f"m{k}", 12) for k in range(C)]))
    else:
        z = F.col("z")
        rows = V.preds(spark, sf, dealt=True).withColumn("p", F.transform(A.tempered_softmax(z, 0.5) if tempered else A.softmax(z), lambda x: F.round(x, 12)))
    rows = rows.withColumn("s", A.ranked(F.col("p"))).select(
        "vec_id", "y", "fold", "p", F.col("s")[0]["k"].cast("string").alias("top"), F.col("s")[0]["p"].alias("conf"),
        F.col("s")[1]["k"].cast("string").alias("second"), F.col("s")[1]["p"].alias("p2"))
    rows = rows.join(feature_map(spark, sf), "vec_id").withColumn("correct", F.col("top") == F.col("y").cast("string"))
    if fit == "fold":
        rules = fold_rules(spark, sf) if rules is None else rules
        rows = P.verify(P.verify(rows, rules, "top", ["fold"]), rules, "second", ["fold"], "second_")
    else:
        rules = P.fit_verifier(feature_rows(spark, sf))
        rows = P.verify(P.verify(rows, rules, "top"), rules, "second", prefix="second_")
    return rows.drop("features", "reasons", "second_reasons")


cte("v_fulldist", "SELECT vec_id, y, fold, k, round(avg(p), 12) AS p FROM v_mprob GROUP BY 1, 2, 3, 4")
for _name, _src in (("soft", "v_prob"), ("temp", "(SELECT vec_id, y, fold, k, p FROM v_models JOIN (SELECT DISTINCT vec_id, fold FROM v_vec) USING (vec_id) WHERE model = 'tempered')"),
                    ("full", "v_fulldist")):
    cte(f"v_j{_name}", f"""
SELECT vec_id, y, fold, max(k) FILTER (rk = 1) AS top, max(p) FILTER (rk = 1) AS conf, max(k) FILTER (rk = 2) AS second, max(p) FILTER (rk = 2) AS p2
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS rk FROM {_src}) GROUP BY 1, 2, 3""")
    for _fit, _held in (("cf", "j.fold"), ("all", "-1")):
        cte(f"v_j{_name}{_fit}", f"""
SELECT j.*, j.top = j.y AS correct, a.status, b.status AS second_status FROM v_j{_name} j
JOIN v_status a ON a.held = {_held} AND a.vec_id = j.vec_id AND a.cls = CAST(j.top AS VARCHAR)
JOIN v_status b ON b.held = {_held} AND b.vec_id = j.vec_id AND b.cls = CAST(j.second AS VARCHAR)""")


@query("verification_stats", f"""
SELECT status, count(*) AS n, {R('avg(CASE WHEN correct THEN 1.0 ELSE 0 END)')} AS accuracy FROM v_jsoftcf GROUP BY 1""")
def _(spark, sf):
    return D.rounded(P.verification_stats(judged(spark, sf, "fold")), "accuracy")


# ---------------------------------------------------------------- routing
def pick_sql(source: str, by: str, targets: list[float]) -> str:
    """Threshold, coverage, accuracy per (by, target) from source(by, conf, correct)."""
    b = by + ", " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    values = ", ".join(f"(CAST({t} AS DOUBLE))" for t in targets)
    return f"""
SELECT {b}target, coalesce(min(conf) FILTER (a >= target), 1.01) AS threshold, coalesce(max(rn) FILTER (a >= target) / max(total), 0) AS coverage,
       arg_max(a, rn) FILTER (a >= target) AS accuracy
FROM (SELECT {b}conf, sum(n) OVER w AS rn, sum(ok) OVER w / sum(n) OVER w AS a, sum(n) OVER ({part}) AS total
      FROM (SELECT {b}conf, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS ok FROM {source} GROUP BY {b}conf)
      WINDOW w AS ({part} ORDER BY conf DESC)), (VALUES {values}) t(target) GROUP BY {b}target"""


_PICK = f"SELECT {{}} target, {R('threshold')} AS threshold, {R('coverage')} AS coverage, {R('accuracy')} AS accuracy FROM "


@query("pick_threshold", _PICK.format("") + "(" + pick_sql("v_jsoft_ok", "", TARGETS) + ")")
def _(spark, sf):
    rows = V.probs(spark, sf).withColumn("correct", F.col("pred") == F.col("y"))
    return D.rounded(P.pick_thresholds(rows, TARGETS), "threshold", "coverage", "accuracy")


cte("v_jsoft_ok", "SELECT conf, top = y AS correct FROM v_jsoft")
_SWITCH = "(status = 'FAIL' AND second_status = 'PASS' AND p2 >= 0.1)"


@query("decide", f"""
SELECT vec_id, CASE WHEN {_SWITCH} THEN second ELSE top END AS final,
       CASE WHEN conf >= 0.2 AND status <> 'FAIL' THEN 'auto_accept' ELSE 'human_review' END AS action,
       {R(f'CASE WHEN {_SWITCH} THEN p2 ELSE conf END')} AS confidence,
       CASE WHEN {_SWITCH} THEN 'top class ' || top || ' failed morphology checks; runner-up ' || second || ' passed' END AS note
FROM v_jsoftall""")
def _(spark, sf):
    return D.rounded(P.decide(judged(spark, sf, "all"), 0.2, auto_correct=True, correct_min_prob=0.1), "confidence").select(
        "vec_id", F.col("final").cast("int").alias("final"), "action", "confidence", "note")


@query("route_cascade", """
SELECT vec_id, mode, CASE WHEN fast THEN 'fast' ELSE 'full' END AS path, CASE WHEN fast THEN ftop ELSE top END AS final,
       CASE WHEN CASE WHEN fast THEN fast_ok ELSE conf >= 0.2 AND status <> 'FAIL' END THEN 'auto_accept' ELSE 'human_review' END AS action
FROM (SELECT *, mode = 'fast' OR (mode = 'auto' AND fast_ok) AS fast FROM (
  SELECT u.*, f.top AS ftop, f.conf >= 0.35 AND f.status = 'PASS' AS fast_ok FROM v_jtempall f JOIN v_jfullall u USING (vec_id)),
  (VALUES ('fast'), ('full'), ('auto')) t(mode))""")
def _(spark, sf):
    fast = judged(spark, sf, "all", tempered=True).select("vec_id", F.col("top").alias("fast_top"), F.col("conf").alias("fast_conf"), F.col("status").alias("fast_status"))
    rows = judged(spark, sf, "all", members=True).join(fast, "vec_id")
    out = None
    for mode in ("fast", "full", "auto"):
        part = P.route_cascade(rows, 0.35, 0.2, mode).select("vec_id", "mode", "path", F.col("final").cast("int").alias("final"), "action")
        out = part if out is None else out.union(part)
    return out


def crossfit_sql(name: str, source: str, targets: list[float]) -> None:
    """Accept flags of source(vec_id, fold, conf, correct, eligible, ..), threshold learned on the other folds."""
    cte(f"{name}_train", f"SELECT CAST(h AS INT) AS held, conf, correct FROM {source}, (SELECT unnest(range(-1, 5)) AS h) WHERE h <> fold AND eligible")
    cte(f"{name}_thr", pick_sql(f"{name}_train", "held", targets))
    values = ", ".join(f"(CAST({t} AS DOUBLE))" for t in targets)
    cte(name, f"""
SELECT s.*, g.target, s.eligible AND s.conf >= coalesce(t.threshold, 1.01) AS accept
FROM {source} s CROSS JOIN (VALUES {values}) g(target) LEFT JOIN {name}_thr t ON t.held = s.fold AND t.target = g.target""")


cte("v_fastin", "SELECT *, status = 'PASS' AS eligible FROM v_jtempcf")
crossfit_sql("v_fastroute", "v_fastin", [FAST_TARGET])
cte("v_fullin", """
SELECT u.vec_id, u.fold, u.conf, u.correct, f.accept AS fast, f.correct AS fast_ok, NOT f.accept AND u.status <> 'FAIL' AS eligible
FROM v_fastroute f JOIN v_jfullcf u USING (vec_id)""")
crossfit_sql("v_fullroute", "v_fullin", TARGETS)


@query("crossfit_route", f"""
SELECT vec_id, fold, {R('conf')} AS conf, accept, {R('t.threshold')} AS deployed_threshold
FROM v_fastroute JOIN (SELECT threshold FROM v_fastroute_thr WHERE held = -1) t ON true""")
def _(spark, sf):
    rows = judged(spark, sf, "fold", tempered=True).withColumn("eligible", F.col("status") == "PASS")
    deployed = P.crossfit_thresholds(rows, [FAST_TARGET], FOLDS).where(F.col("held") == P.DEPLOYED).select("threshold").scalar()
    return P.crossfit_route(rows, [FAST_TARGET], FOLDS).select("vec_id", "fold", r6(F.col("conf")).alias("conf"), "accept", r6(deployed).alias("deployed_threshold"))


_REPORT = """count(*) AS n, {cov} AS coverage, {acc} AS accuracy, {rev} AS review, count(*) FILTER (NOT ok AND NOT auto) AS errors_caught,
       count(*) FILTER (NOT ok AND auto) AS errors_passed, count(*) FILTER (fast) AS fast_accepted
FROM (SELECT target, fast, fast OR accept AS auto, CASE WHEN fast THEN fast_ok ELSE correct END AS ok FROM v_fullroute)""".format(
    cov=R("count(*) FILTER (auto) / count(*)"), acc=R("count(*) FILTER (auto AND ok) / nullif(count(*) FILTER (auto), 0)"),
    rev=R("1 - count(*) FILTER (auto) / count(*)"))


def cascade_rows(spark, sf, targets):
    rules = stored(fold_rules(spark, sf), "rules")       # of features alone: the same for both paths
    return P.cascade(judged(spark, sf, "fold", tempered=True, rules=rules), judged(spark, sf, "fold", members=True, rules=rules), FAST_TARGET, targets, FOLDS)


@query("cascade_report", f"SELECT {_REPORT} WHERE target = 0.6")
def _(spark, sf):
    return D.rounded(P.cascade_report(cascade_rows(spark, sf, [0.6])), "coverage", "accuracy", "review")


@query("tradeoff_curve", f"SELECT target, {_REPORT} GROUP BY target")
def _(spark, sf):
    return D.rounded(P.cascade_report(cascade_rows(spark, sf, TARGETS), ["target"]), "coverage", "accuracy", "review")


cte("v_probtrain", "SELECT CAST(h AS INT) AS held, y, k, p FROM v_prob, (SELECT unnest(range(5)) AS h) WHERE h <> fold")
cte("v_youdencf", youden_sql("v_probtrain", "held"))


@query("secondary_alarm_rate", f"""
SELECT {R('count(*) FILTER (p >= threshold AND v_prob.k <> pred AND v_prob.k <> 9) / count(DISTINCT v_prob.vec_id)')} AS alarms_per_row
FROM v_prob JOIN v_top ON v_top.vec_id = v_prob.vec_id JOIN v_youdencf t ON t.held = v_prob.fold AND t.k = v_prob.k""")
def _(spark, sf):
    return D.rounded(P.secondary_alarm_rate(V.probs(spark, sf), FOLDS, C, baseline=9), "alarms_per_row")


@query("auto_correct_test", f"""
SELECT {R('a')} AS accuracy, {R('b')} AS corrected, n AS switched, b > a AS enable
FROM (SELECT avg(CASE WHEN correct THEN 1.0 ELSE 0 END) AS a,
             avg(CASE WHEN CASE WHEN sw THEN second ELSE top END = y THEN 1.0 ELSE 0 END) AS b, count(*) FILTER (sw) AS n
      FROM (SELECT *, status = 'FAIL' AND second_status = 'PASS' AND p2 >= 0.2 AS sw FROM v_jtempcf))""")
def _(spark, sf):
    return D.rounded(P.auto_correct_test(judged(spark, sf, "fold", tempered=True)), "accuracy", "corrected")
