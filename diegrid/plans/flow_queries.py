"""Queries over learned models, dropout sampling, result documents and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from diegrid.constants import FEATURES
from diegrid.functions import arrays as A
from diegrid.operators import dies as D, features as M, learn as L, policy as P, quantify as Q
from diegrid.plans.die_queries import pattern
from diegrid.plans.metric_queries import mix_sql
from diegrid.plans.policy_queries import judged
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V
from diegrid.sources.tables import shared_path, table
from diegrid.streaming import flow


@query("morphology_oof")
def _(spark, sf):
    features = M.feature_matrix(V.dies(spark, sf))
    rows = features.join(V.batches(spark, sf), "wafer_id").withColumn("y", F.col("wafer_id") % 9).withColumn("fold", F.col("batch") % 5)
    out = L.morphology_oof(rows, FEATURES, 5)
    return out.select("wafer_id", "fold", F.col("label").cast("int").alias("y"), "pred", F.array_join(F.transform("p", lambda v: F.round(v, 4).cast("string")), ",").alias("p"))


def meta_rows(spark, sf):
    z = F.col("z")
    return V.preds(spark, sf).select("vec_id", "y", "fold", F.concat(
        A.log_clipped(A.softmax(z)), A.log_clipped(A.tempered_softmax(z, 0.5)), F.array(A.dirichlet(z)[1])).alias("meta"))


@query("stacker_oof")
def _(spark, sf):
    out = L.stacker_oof(meta_rows(spark, sf), 5, "vec_id")
    return out.select("vec_id", "fold", F.col("label").cast("int").alias("y"), "pred", F.round(F.array_max("p"), 4).alias("conf"))


@query("meta_weight_share")
def _(spark, sf):
    return D.rounded(L.meta_weight_share(meta_rows(spark, sf), {"softmax": 10, "tempered": 10, "evidential_u": 1}), "share")


def head(spark, sf) -> np.ndarray:
    """Classifier head: ten times the class means (classes x dimensions, fixed size)."""
    rows = V._centroids(V.embeddings(spark, sf)).orderBy("label").collect()
    return 10 * np.array([r["centroid"] for r in rows])


_MASK = f"CASE WHEN {mix_sql('t * 64 + i', '0')} / CAST(2147483647 AS DOUBLE) >= 0.3 THEN 1 / (1 - CAST(0.3 AS DOUBLE)) ELSE 0 END"
cte("v_mask", f"SELECT t, i, {_MASK} AS w FROM (SELECT unnest(range(30)) AS t), (SELECT unnest(range(64)) AS i)")
cte("v_mc", """
SELECT vec_id, t, k, e / sum(e) OVER (PARTITION BY vec_id, t) AS p FROM (
  SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id, t)) AS e FROM (
    SELECT vec_id, t, k, 10 * sum(v * w * m) AS z FROM v_vec JOIN v_mask USING (i) JOIN v_cent USING (i) WHERE w > 0 GROUP BY 1, 2, 3))""")


@query("mc_dropout", f"""
SELECT vec_id, {R('h')} AS entropy, {R('h - mh')} AS mutual_info, {R('s')} AS std
FROM (SELECT vec_id, -sum(a * ln(greatest(1e-12, least(1, a)))) AS h, max(s) AS s FROM (SELECT vec_id, k, avg(p) AS a, stddev_pop(p) AS s FROM v_mc GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT vec_id, avg(h) AS mh FROM (SELECT vec_id, t, -sum(p * ln(greatest(1e-12, least(1, p)))) AS h FROM v_mc GROUP BY 1, 2) GROUP BY 1) USING (vec_id)""")
def _(spark, sf):
    w = head(spark, sf)
    rows = V.embeddings(spark, sf).select("vec_id", F.col("embedding").alias("g"))
    return D.rounded(L.mc_dropout(rows, "vec_id", w, np.zeros(len(w)), 0.3).select("vec_id", "entropy", "mutual_info", "std"), "entropy", "mutual_info", "std")


# ---------------------------------------------------------------- documents
def decisions(spark, sf):
    return P.decide(judged(spark, sf, "all"), 0.2).withColumnRenamed("vec_id", "wafer_id")


@query("batch_rows", f"""
SELECT CAST(wafer_id AS VARCHAR) AS wafer_id, batch, CAST(top AS VARCHAR) AS final, {R('conf')} AS confidence, action, status AS verification,
       {R('100.0 * f / n')} AS fail_pct, {R('100.0 * p / n')} AS affected_pct, {R('p * dw * dh')} AS area_mm2,
       count(*) FILTER (action = 'human_review') OVER (PARTITION BY batch) AS human_review
FROM (SELECT *, CASE WHEN conf >= 0.2 AND status <> 'FAIL' THEN 'auto_accept' ELSE 'human_review' END AS action
      FROM v_jsoftall j JOIN v_patn q ON q.wafer_id = j.vec_id JOIN v_batch USING (wafer_id))""")
def _(spark, sf):
    dies = V.dies(spark, sf)
    out = L.batch_rows(Q.wafer_summary(dies), Q.pattern_area(dies, pattern(spark, sf)), decisions(spark, sf), V.batches(spark, sf))
    return D.rounded(out, "confidence", "fail_pct", "affected_pct", "area_mm2")


@query("result_json")
def _(spark, sf):
    dies, pat = V.dies(spark, sf), pattern(spark, sf)
    return L.result_json(decisions(spark, sf), Q.wafer_summary(dies), Q.pattern_area(dies, pat), Q.pattern_centroid(dies, pat))


# ---------------------------------------------------------------- streams and short memories
@query("recent_latency", f"""
SELECT count(*) AS n, {R('quantile_cont(ms, 0.5)')} AS p50, {R('quantile_cont(ms, 0.95)')} AS p95
FROM (SELECT value AS ms FROM events ORDER BY ts DESC, value DESC LIMIT 64)""")
def _(spark, sf):
    return D.rounded(flow.recent_latency(table(spark, sf, "events").select("ts", F.col("value").alias("ms"))), "p50", "p95")


@query("recent_batches", "SELECT user_id AS batch, count(*) AS wafers FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 DESC LIMIT 50")
def _(spark, sf):
    b = table(spark, sf, "events").groupBy(F.col("user_id").alias("batch")).agg(F.count("*").alias("wafers"), F.max("ts").alias("created"))
    return flow.recent_batches(b).select("batch", "wafers")


@query("stream_defect_rate", f"""
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, chamber, wafers, defects, {R('defects / wafers')} AS rate FROM (
  SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, chamber, count(*) AS wafers, CAST(sum(CASE WHEN class <> 'None' THEN 1 ELSE 0 END) AS BIGINT) AS defects
  FROM events JOIN v_process ON seq = event_id GROUP BY 1, 2)""")
def _(spark, sf):
    """The events table as a stream; all windows, those still open at its end too."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = V.process_columns(raw.withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    out = flow.run_to_table(flow.defect_rate(rows), "defect-rate", ["start", "end", "chamber"])
    return D.rounded(out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "chamber", "wafers", "defects", "rate"), "rate")


@query("stream_validate", """
SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS wafers FROM (
  SELECT CASE wafer_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not rectangular' WHEN 2 THEN 'bad value' ELSE 'empty' END AS reason FROM v_wafers) GROUP BY 1""")
def _(spark, sf):
    m, k = F.col("wafer_map"), F.col("wafer_id") % 4
    faulty = (F.when(k == 1, F.transform(m, lambda row, i: F.when(i == 0, F.slice(row, 1, F.size(row) - 1)).otherwise(row)))
              .when(k == 2, F.transform(m, lambda row, i: F.when(i == 0, F.transform(row, lambda v: (v + 3).cast("byte"))).otherwise(row)))
              .when(k == 3, F.array().cast("array<array<tinyint>>")).otherwise(m))
    landing = shared_path(spark, "landing")
    V.wafers(spark, sf).select("wafer_id", faulty.alias("wafer_map")).write.parquet(landing)
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)
    good, bad = flow.validate_stream(stream, "validated")
    return good.groupBy().agg(F.count("*").alias("wafers")).select(F.lit("accepted").alias("outcome"), "wafers").union(
        bad.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("wafers")))
