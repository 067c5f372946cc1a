"""Queries over the process log."""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.constants import CAUSES, CLASSES, PRIORS
from diegrid.functions.numeric import BETA_TERMS, ERFC_COEFFICIENTS, GAMMA_SERIES
from diegrid.operators import dies as D, rootcause as C
from diegrid.plans.metric_queries import mix_sql
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V


def student_sql(t: str, dof: str) -> str:
    """Two-sided p of Student's t as text: both sides of the incomplete beta function, the fraction written out."""
    a, z = f"(CAST({dof} AS DOUBLE) / 2)", f"(CAST({t} AS DOUBLE) * {t} / ({dof}))"
    steps = " * ".join(f"({a} + {k}) / ({a} + {k}.5)" for k in range(8))
    series = "(" + " + ".join(f"{c!r} / ({a} + 8) ^ {i}" for i, c in enumerate(GAMMA_SERIES)) + ")"
    front = f"(exp(-({a} + 0.5) * ln(1 + {z})) * sqrt({z}) * {steps} * sqrt({a} + 8) * {series} / sqrt(pi()))"

    def tail(p: str, q: str, x: str) -> str:
        v = "1.0"
        for j in range(BETA_TERMS, 0, -1):
            m = j // 2
            d = f"{m} * ({q} - {m}) * {x} / (({p} + {2 * m - 1}) * ({p} + {2 * m}))" if j % 2 == 0 else f"-({p} + {m}) * ({p} + {q} + {m}) * {x} / (({p} + {2 * m}) * ({p} + {2 * m + 1}))"
            v = f"(1 + {d} / {v})"
        return f"{front} / {p} / {v}"

    return f"CASE WHEN {t} * {t} < 16 THEN 1 - {tail('0.5', a, f'({z} / (1 + {z}))')} ELSE {tail(a, '0.5', f'(1 / (1 + {z}))')} END"


def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ({x})))"
    poly = f"CAST({ERFC_COEFFICIENTS[-1]} AS DOUBLE)"
    for a in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({a} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def setup(spark, sf):
    log = V.process(spark, sf)
    return log, C.infer_roles(log), C.analysed_classes(log)


_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


@query("join_process", f"""
SELECT wafer_id, seq, lot_id, chamber, etch_time_s, cmp_pad_cycles, {_LIST}[t.pred % 9 + 1] AS class
FROM v_process p JOIN v_top t ON p.wafer_id = 'W' || t.vec_id""")
def _(spark, sf):
    preds = V.probs(spark, sf).select(F.concat(F.lit("W"), F.col("vec_id").cast("string")).alias("wafer_id"),
                                      V.class_name(F.col("pred")).alias("class"))
    return C.join_process(preds, V.process(spark, sf))


@query("infer_roles", """
SELECT 'factor' AS role, 'chamber' AS name FROM v_process HAVING count(DISTINCT chamber) <= 50
UNION ALL SELECT 'param', 'etch_time_s' FROM v_process HAVING count(DISTINCT etch_time_s) > 5
UNION ALL SELECT 'param', 'cmp_pad_cycles' FROM v_process HAVING count(DISTINCT cmp_pad_cycles) > 5""")
def _(spark, sf):
    roles = C.infer_roles(V.process(spark, sf))
    return spark.createDataFrame([("factor", f) for f in roles.factors] + [("param", p) for p in roles.params], "role string, name string")


cte("v_ccount", "SELECT class, count(*) AS n, count(*) >= 5 AND class <> 'None' AS analysed FROM v_process GROUP BY 1")


@query("class_counts", "SELECT class, n, analysed FROM v_ccount")
def _(spark, sf):
    return C.class_counts(V.process(spark, sf))


cte("v_pvals", """
SELECT class, 'etch_time_s' AS param, CAST(etch_time_s AS DOUBLE) AS v FROM v_process
UNION ALL SELECT class, 'cmp_pad_cycles', CAST(cmp_pad_cycles AS DOUBLE) FROM v_process""")
cte("v_shift", """
SELECT a.class, a.param, (a.m - b.m) / b.s AS d, a.m AS mean_class, b.m AS mean_baseline
FROM (SELECT class, param, count(v) AS n, avg(v) AS m FROM v_pvals GROUP BY 1, 2) a
JOIN (SELECT param, count(v) AS n, avg(v) AS m, stddev_pop(v) AS s FROM v_pvals WHERE class = 'None' GROUP BY 1) b USING (param)
WHERE a.class <> 'None' AND a.n >= 5 AND b.n >= 5 AND b.s > 0""")


@query("param_shift", f"SELECT class, param, {R('d')} AS d, {R('mean_class')} AS mean_class, {R('mean_baseline')} AS mean_baseline FROM v_shift")
def _(spark, sf):
    log, roles, _c = setup(spark, sf)
    return D.rounded(C.param_shift(log, roles.params), "d", "mean_class", "mean_baseline")


cte("v_mw", f"""
SELECT class, param, n1, n2, u, z, CASE WHEN z < 0 THEN 1.0 ELSE least(1.0, {erfc_sql('abs(z) / sqrt(2.0)')}) END AS p FROM (
  SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z
  FROM (SELECT k AS class, param, sum(CASE WHEN class = k THEN rk END) - count(*) FILTER (class = k) * (count(*) FILTER (class = k) + 1) / 2.0 AS u,
               CAST(count(*) FILTER (class = k) AS DOUBLE) AS n1, CAST(count(*) FILTER (class = 'None') AS DOUBLE) AS n2, sum(CAST(t AS DOUBLE) * t - 1) AS ties
        FROM (SELECT k, class, param, rank() OVER w + (count(*) OVER (PARTITION BY k, param, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY k, param, v) AS t
              FROM v_pvals JOIN (SELECT class AS k FROM v_ccount WHERE analysed) c ON v_pvals.class IN (c.k, 'None') WINDOW w AS (PARTITION BY k, param ORDER BY v))
        GROUP BY 1, 2))""")


@query("mann_whitney", f"""
SELECT class, param, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {R('u')} AS u, {R('z')} AS z, {R('p')} AS p FROM v_mw""")
def _(spark, sf):
    log, roles, classes = setup(spark, sf)
    return D.rounded(C.mann_whitney(log, roles.params, classes), "u", "z", "p")


def bh_sql(source: str, tie: str) -> str:
    return f"""
SELECT *, least(1.0, min(raw) OVER (ORDER BY p, {tie} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q
FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, {tie}) AS raw FROM {source})"""


cte("v_effect", bh_sql("(SELECT * FROM v_shift JOIN (SELECT class, param, p FROM v_mw) USING (class, param))", "class, param"))


@query("bh_adjust", f"SELECT class, param, {R('p')} AS p, {R('q')} AS q, q < 0.05 AS significant FROM v_effect")
def _(spark, sf):
    log, roles, classes = setup(spark, sf)
    return D.rounded(C.parameter_effects(log, roles.params, classes).select("class", "param", "p", "q", "significant"), "p", "q")


cte("v_level", """
SELECT 'chamber' AS factor, k AS class, chamber AS level, count(*) AS n, count(*) FILTER (class = k) AS hits
FROM v_process, (SELECT class AS k FROM v_ccount WHERE analysed) GROUP BY 1, 2, 3""")
cte("v_equip", bh_sql("""(
  SELECT factor, class, arg_max(level, hits / n) AS worst_level, sum(pow(hits - n * tk / tn, 2) / (n * tk / tn) + pow(hits - n * tk / tn, 2) / (n * (tn - tk) / tn)) AS chi2,
         count(*) - 1 AS dof, exp(-sum(pow(hits - n * tk / tn, 2) / (n * tk / tn) + pow(hits - n * tk / tn, 2) / (n * (tn - tk) / tn)) / 2) AS p,
         max(hits / n) AS rate_worst, max(tk / tn) AS rate_overall, max(hits / n) / max(tk / tn) AS rate_ratio
  FROM (SELECT *, sum(n) OVER (PARTITION BY factor, class) AS tn, sum(hits) OVER (PARTITION BY factor, class) AS tk FROM v_level) GROUP BY 1, 2)""", "class, factor"))


@query("chamber_matching", f"""
SELECT class, factor, worst_level, {R('chi2')} AS chi2, dof, {R('p')} AS p, {R('q')} AS q, {R('rate_worst')} AS rate_worst,
       {R('rate_overall')} AS rate_overall, {R('rate_ratio')} AS rate_ratio, q < 0.05 AS significant FROM v_equip""")
def _(spark, sf):
    log, roles, classes = setup(spark, sf)
    return D.rounded(C.equipment_effects(log, roles.factors, classes), "chi2", "p", "q", "rate_worst", "rate_overall", "rate_ratio")


def _ll(k: str, n: str) -> str:
    p = f"greatest(1e-12, least(1 - 1e-12, {k} / {n}))"
    return f"({k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


cte("v_scope", "SELECT 'all' AS scope, seq, wafer_id, class FROM v_process UNION ALL SELECT 'chamber=' || chamber, seq, wafer_id, class FROM v_process")
cte("v_series", """
SELECT scope, k AS class, seq, wafer_id, row_number() OVER w - 1 AS n1, sum(CASE WHEN class = k THEN 1 ELSE 0 END) OVER w - CASE WHEN class = k THEN 1 ELSE 0 END AS k1,
       count(*) OVER (PARTITION BY scope, k) AS n, sum(CASE WHEN class = k THEN 1 ELSE 0 END) OVER (PARTITION BY scope, k) AS k
FROM v_scope, (SELECT class AS k FROM v_ccount WHERE analysed) WINDOW w AS (PARTITION BY scope, k ORDER BY seq)""")
cte("v_drift", f"""
SELECT scope, class, n, k, arg_max(n1, (stat, -n1)) AS n1, max(stat) AS stat, arg_max(seq, (stat, -n1)) AS onset_seq,
       arg_max(wafer_id, (stat, -n1)) AS onset_wafer, arg_max(k1, (stat, -n1)) AS k1
FROM (SELECT *, CASE WHEN (k - k1) * n1 > k1 * (n - n1) THEN round({_ll('k1', 'n1')} + {_ll('(k - k1)', '(n - n1)')} - {_ll('k', 'n')}, 9) ELSE 0 END AS stat
      FROM v_series WHERE n >= 90 AND k >= 5 AND n1 >= 30 AND n1 <= n - 30) GROUP BY 1, 2, 3, 4""")
_DRIFT = f"""
SELECT class, scope, n, CAST(k AS BIGINT) AS k, {R('stat')} AS stat, onset_seq, onset_wafer, {R('k1 / n1')} AS rate_before,
       {R('(k - k1) / (n - n1)')} AS rate_after FROM v_drift"""


@query("changepoint", _DRIFT + " WHERE scope = 'all'")
def _(spark, sf):
    log, _r, classes = setup(spark, sf)
    return D.rounded(C.drift_statistics(log, [], classes), "stat", "rate_before", "rate_after")


@query("drift_scopes", _DRIFT)
def _(spark, sf):
    log, roles, classes = setup(spark, sf)
    return D.rounded(C.drift_statistics(log, roles.factors, classes), "stat", "rate_before", "rate_after")


# every admissible split of every replicate, with the counts before it from a running total over all places
cte("v_nreps", "SELECT n, k, least(k, n - k) AS m, CAST(floor(least(k, n - k) + least(k, n - k) * least(k, n - k) * 4 / (n * 5) + least(k, n - k) / 16 + 64) AS BIGINT) AS draws, rep "
    "FROM (SELECT DISTINCT n, CAST(k AS BIGINT) AS k FROM v_drift), (SELECT unnest(range(1, 301)) AS rep)")
cte("v_nhash", f"SELECT n, k, m, rep, j, {mix_sql('j', 'rep')} AS h FROM (SELECT *, unnest(range(draws)) AS j FROM v_nreps)")
cte("v_ndraws", f"SELECT n, k, m, rep, j, {mix_sql('h', '2 * n + 1')} AS h FROM v_nhash")
cte("v_npos", f"SELECT n, k, m, rep, (h * 2147483647 + {mix_sql('h', '3 * n + 2')}) % n AS pos, min(j) AS j FROM v_ndraws GROUP BY ALL")
cte("v_nkept", "SELECT n, k, m, rep, pos FROM v_npos QUALIFY row_number() OVER (PARTITION BY n, k, rep ORDER BY j) <= m")
cte("v_nsplit", """
SELECT n, k, m, rep, pos AS n1, row_number() OVER (PARTITION BY n, k, rep ORDER BY pos) - 1 AS c FROM v_nkept
UNION ALL SELECT n, k, m, rep, pos + 1, row_number() OVER (PARTITION BY n, k, rep ORDER BY pos) FROM v_nkept
UNION ALL SELECT n, k, m, rep, e, count(*) FILTER (pos < e) FROM v_nkept, LATERAL (SELECT unnest([30, n - 30]) AS e) GROUP BY ALL""")
cte("v_null", f"""
SELECT n, k, rep, coalesce(max(CASE WHEN (k - k1) * n1 > k1 * (n - n1) THEN round({_ll('k1', 'n1')} + {_ll('(k - k1)', '(n - n1)')} - {_ll('k', 'n')}, 9) ELSE 0 END)
       FILTER (n1 >= 30 AND n1 <= n - 30), 0) AS null_stat
FROM (SELECT n, k, rep, n1, CASE WHEN k = m THEN c ELSE n1 - c END AS k1 FROM v_nsplit) GROUP BY ALL""")
cte("v_pdrift", bh_sql("(SELECT *, (1 + (SELECT count(*) FROM v_null u WHERE u.n = d.n AND u.k = d.k AND u.null_stat >= d.stat)) / 301.0 AS p FROM v_drift d)", "class, scope"))


@query("changepoint_pvalue", f"""
SELECT class, scope, n, CAST(k AS BIGINT) AS k, {R('stat')} AS stat, onset_seq, onset_wafer, {R('k1 / n1')} AS rate_before,
       {R('(k - k1) / (n - n1)')} AS rate_after, {R('p')} AS p, {R('q')} AS q FROM v_pdrift""")
def _(spark, sf):
    log, roles, classes = setup(spark, sf)
    t = C.changepoint_pvalue(C.drift_statistics(log, roles.factors, classes))
    return D.rounded(C.bh_adjust(t, [], ["class", "scope"]), "stat", "rate_before", "rate_after", "p", "q")


@query("consumables", f"""
SELECT class, 'cmp_pad_cycles' AS counter, edges[bin] AS lo, edges[bin + 1] AS hi, n, {R('k / n')} AS rate, {R('r')} AS r, {R('p')} AS p, p < 0.05 AND abs(r) > 0.05 AS reported
FROM (SELECT c.class, bin, edges, count(*) AS n, count(*) FILTER (v.class = c.class) AS k
      FROM (SELECT class, edges, greatest(len(list_filter(edges, lambda e: e < v)), 1) AS bin FROM v_pvals,
              (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]))) AS edges FROM v_pvals WHERE param = 'cmp_pad_cycles') WHERE param = 'cmp_pad_cycles') v,
           (SELECT class FROM v_ccount WHERE analysed) c GROUP BY 1, 2, 3)
JOIN (SELECT class, r, {student_sql('t', 'dof')} AS p
      FROM (SELECT class, r, r * sqrt(n - 2) / sqrt(1 - r * r) AS t, n - 2 AS dof FROM (SELECT c.class, count(*) AS n, corr(CASE WHEN v.class = c.class THEN 1.0 ELSE 0.0 END, v) AS r
            FROM v_pvals v, (SELECT class FROM v_ccount WHERE analysed) c WHERE param = 'cmp_pad_cycles' GROUP BY 1))) USING (class)""")
def _(spark, sf):
    log, roles, classes = setup(spark, sf)
    return D.rounded(C.consumables(log, roles.params, classes), "rate", "r", "p")


cte("v_trans", """
SELECT a AS "from", b AS "to", n, n / (sum(n) OVER (PARTITION BY a) * (sum(n) OVER (PARTITION BY b) / sum(n) OVER ())) AS ratio
FROM (SELECT a, b, count(*) AS n FROM (SELECT lag(class) OVER (PARTITION BY chamber ORDER BY seq) AS a, class AS b FROM v_process) WHERE a IS NOT NULL GROUP BY 1, 2)""")
@query("transitions", f"""
SELECT "from", "to", n, {R('ratio')} AS ratio FROM v_trans WHERE "to" <> 'None' AND n >= 5 AND ratio > 1.05""")
def _(spark, sf):
    return D.rounded(C.transitions(V.process(spark, sf), "chamber", min_ratio=1.05), "ratio")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, float) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in rows)


cte("v_prior", f"SELECT * FROM (VALUES {_values(PRIORS)}) t(class, cause, prior)")
cte("v_link", f"""SELECT * FROM (VALUES {_values([(c, 'param', p) for c, _l, ps, _f in CAUSES for p in ps] + [(c, 'factor', f) for c, _l, _p, fs in CAUSES for f in fs])}) t(cause, kind, name)""")
cte("v_cause", f"SELECT * FROM (VALUES {_values([(c, label) for c, label, _p, _f in CAUSES])}) t(cause, label)")
cte("v_evid", """
SELECT class, cause, prior, coalesce(ev, 0) AS evidence FROM v_prior LEFT JOIN (
  SELECT class, cause, max(ev) AS ev FROM (
    SELECT class, cause, abs(round(d, 5)) AS ev FROM v_effect JOIN v_link ON kind = 'param' AND name = param WHERE q < 0.05
    UNION ALL SELECT class, cause, 2 * ln(greatest(rate_ratio, 1)) FROM v_equip JOIN v_link ON kind = 'factor' AND name = factor WHERE q < 0.05) GROUP BY 1, 2) USING (class, cause)""")
cte("v_post", """
SELECT class, cause, n, prior, evidence, prior * exp(least(evidence, 6)) / sum(prior * exp(least(evidence, 6))) OVER (PARTITION BY class) AS posterior
FROM v_evid JOIN v_ccount USING (class) WHERE analysed""")


@query("kb_tables", "SELECT class, n, cause, label, prior FROM v_ccount JOIN v_prior USING (class) JOIN v_cause USING (cause)")
def _(spark, sf):
    causes, priors = C.kb_tables(spark)
    return (C.class_counts(V.process(spark, sf)).join(F.broadcast(priors), "class").join(F.broadcast(causes), "cause")
            .select("class", "n", "cause", "label", "prior"))


def scored(spark, sf):
    log, roles, classes = setup(spark, sf)
    kb = C.kb_tables(spark)
    effects, equipment = C.parameter_effects(log, roles.params, classes), C.equipment_effects(log, roles.factors, classes)
    counts = C.class_counts(log)
    return C.evidence(effects, equipment, kb), effects, equipment, counts, kb


@query("evidence", f"SELECT class, cause, prior, {R('evidence')} AS evidence FROM v_evid")
def _(spark, sf):
    return D.rounded(scored(spark, sf)[0], "evidence")


@query("cause_posterior", f"SELECT class, cause, {R('posterior')} AS posterior FROM v_post")
def _(spark, sf):
    ev, _e, _q, counts, _k = scored(spark, sf)
    return D.rounded(C.cause_posterior(ev, counts).select("class", "cause", "posterior"), "posterior")


@query("pareto", f"""
SELECT CAST(row_number() OVER (ORDER BY round(c, 9) DESC, cause) AS INT) AS rank, cause, {R('c')} AS contribution,
       {R('sum(c) OVER (ORDER BY round(c, 9) DESC, cause ROWS UNBOUNDED PRECEDING)')} AS cumulative
FROM (SELECT cause, sum(n / (SELECT sum(n) FROM v_ccount WHERE analysed) * posterior) AS c FROM v_post GROUP BY 1)""")
def _(spark, sf):
    ev, _e, _q, counts, _k = scored(spark, sf)
    return D.rounded(C.pareto(C.cause_posterior(ev, counts), counts), "contribution", "cumulative")


@query("pareto_drilldown")
def _(spark, sf):
    ev, effects, equipment, counts, kb = scored(spark, sf)
    d = C.pareto_drilldown(C.cause_posterior(ev, counts), effects, equipment, kb)
    return d.select("cause", "label", F.to_json("classes").alias("classes"), F.array_join("evidence", "; ").alias("evidence"))


@query("rootcause_report")
def _(spark, sf):
    return C.rootcause_report(V.process(spark, sf), C.kb_tables(spark))
