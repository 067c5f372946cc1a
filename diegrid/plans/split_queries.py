"""Queries over splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.operators import dies as D, splits as S
from diegrid.plans.metric_queries import mix_sql
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V

C = V.N_CLASSES


def lots(spark, sf):
    return V.batches(spark, sf).select("wafer_id", F.col("batch").alias("lot_id")).join(V.wafer_classes(spark, sf), "wafer_id")


@query("factorize", """
SELECT wafer_id, lot, dense_rank() OVER (ORDER BY lot) - 1 AS code
FROM (SELECT wafer_id, 'lot-' || batch AS lot FROM v_batch JOIN v_cls USING (wafer_id))""")
def _(spark, sf):
    return S.factorize(lots(spark, sf).select("wafer_id", F.concat(F.lit("lot-"), F.col("lot_id").cast("string")).alias("lot")), "lot")


@query("class_cap", f"""
SELECT seq, class FROM v_process WHERE class <> 'None' UNION ALL
SELECT seq, class FROM (SELECT *, row_number() OVER (ORDER BY {mix_sql('seq', '0')}, seq) AS k FROM v_process WHERE class = 'None') WHERE k <= 900""")
def _(spark, sf):
    return S.class_cap(V.process(spark, sf).select("seq", "class"), "class", "None", 900, "seq")


@query("dataset_audit", """
SELECT cls, count(*) AS wafers, count(DISTINCT batch) AS lots FROM v_cls JOIN v_batch USING (wafer_id) GROUP BY 1
UNION ALL SELECT NULL, count(*), count(DISTINCT batch) FROM v_cls JOIN v_batch USING (wafer_id)""")
def _(spark, sf):
    return S.dataset_audit(lots(spark, sf))


cte("v_gdom", """
SELECT grp, sum(n) AS size, arg_max(y, (n, -y)) AS dominant FROM (SELECT grp, y, count(*) AS n FROM v_top GROUP BY 1, 2) GROUP BY 1""")
cte("v_gfold", f"""
SELECT grp, CAST(CASE WHEN p < 5 THEN p ELSE 9 - p END AS INT) AS fold FROM (
  SELECT grp, (row_number() OVER (PARTITION BY dominant ORDER BY {mix_sql('grp', '0')} / CAST(2147483647.0 AS DOUBLE) - size, grp) - 1) % 10 AS p FROM v_gdom)""")
cte("v_rfold", f"""
SELECT vec_id, y, grp, pred, CAST((row_number() OVER (PARTITION BY y ORDER BY {mix_sql('vec_id', '0')}, vec_id) - 1) % 5 AS INT) AS fold FROM v_top""")


@query("group_kfold", "SELECT grp, fold FROM v_gfold")
def _(spark, sf):
    return S.group_kfold(V.embeddings(spark, sf), 5)


@query("random_kfold", "SELECT vec_id, fold FROM v_rfold")
def _(spark, sf):
    return S.random_kfold(V.embeddings(spark, sf).select("vec_id", "y"), 5, "vec_id").select("vec_id", "fold")


@query("fold_leak_check", """
SELECT 'random' AS split, count(*) AS leaking_groups FROM (SELECT grp FROM v_rfold GROUP BY 1 HAVING count(DISTINCT fold) > 1)
UNION ALL SELECT 'grouped', 0""")
def _(spark, sf):
    e = V.embeddings(spark, sf).select("vec_id", "y", "grp")
    parts = {"random": S.random_kfold(e, 5, "vec_id"), "grouped": e.join(S.group_kfold(e, 5), "grp")}
    a, b = (S.fold_leak_check(p).agg(F.count("*").alias("leaking_groups")).select(F.lit(n).alias("split"), "leaking_groups") for n, p in parts.items())
    return a.union(b)


@query("leak_effect", f"""
SELECT 'random' AS split, {R('avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END)')} AS accuracy FROM v_rfold WHERE fold = 0
UNION ALL SELECT 'grouped', {R('avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END)')} FROM v_top JOIN v_gfold g USING (grp) WHERE g.fold = 0""")
def _(spark, sf):
    p = V.probs(spark, sf).select("vec_id", "y", "grp", "pred")
    e = V.embeddings(spark, sf).select("vec_id", "y", "grp")
    return D.rounded(S.leak_effect(p, S.random_kfold(e, 5, "vec_id"), S.group_kfold(e, 5), "vec_id"), "accuracy")


@query("oversample", f"""
SELECT vec_id, y, count(*) AS copies FROM (
  SELECT vec_id, y FROM v_top UNION ALL
  SELECT m.vec_id, m.y FROM (SELECT y, n, y * 60 + j AS id FROM (SELECT y, count(*) AS n FROM v_top GROUP BY 1), (SELECT unnest(range(60)) AS j) WHERE j < 60 - n) d
  JOIN (SELECT vec_id, y, row_number() OVER (PARTITION BY y ORDER BY vec_id) AS rn FROM v_top) m ON m.y = d.y AND m.rn = {mix_sql('d.id', '0')} % n + 1) GROUP BY 1, 2""")
def _(spark, sf):
    return S.oversample(V.embeddings(spark, sf).select("vec_id", "y"), 60, "vec_id", C).groupBy("vec_id", "y").agg(F.count("*").alias("copies"))


@query("class_weights", f"""
SELECT y, {R('w / sum(w) OVER () * count(*) OVER ()')} AS weight
FROM (SELECT y, 0.001 / (1 - pow(0.999, greatest(count(*), 50))) AS w FROM v_top GROUP BY 1)""")
def _(spark, sf):
    counts = V.embeddings(spark, sf).groupBy("y").agg(F.count("*").alias("n"))
    return D.rounded(S.class_weights(counts, floor=50), "weight")


@query("holdout_complement", f"SELECT vec_id FROM (SELECT vec_id FROM v_top EXCEPT SELECT vec_id FROM v_top WHERE fold = 0) ORDER BY {mix_sql('vec_id', '3')}, vec_id LIMIT 256")
def _(spark, sf):
    e = V.embeddings(spark, sf).select("vec_id", "fold")
    return S.holdout_complement(e, e.where("fold = 0"), "vec_id", seed=3).select("vec_id")


@query("demo_sample", f"""
SELECT vec_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {mix_sql('vec_id', '0')}, vec_id) AS k FROM v_top WHERE fold = 0) WHERE k <= 4""")
def _(spark, sf):
    return S.demo_sample(V.embeddings(spark, sf).where("fold = 0").select("vec_id", "y"), "vec_id")
