"""Queries over scans, sinks, checks, labels and probability vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.functions import arrays as A, labels as L
from diegrid.functions.numeric import r6
from diegrid.operators import dies as D
from diegrid.plans.registry import R, cte, query
from diegrid.sources import readers, validation, views as V, writers
from diegrid.sources.tables import shared_path, table

cte("v_wafers", """
SELECT wafer_id, s_nationkey AS lot_id, max(r) + 1 AS h, max(c) + 1 AS w, count(*) AS n, count(*) FILTER (state = 2) AS f,
       CASE WHEN wafer_id % 7 <> 0 THEN any_value(cls) END AS cls
FROM v_dies JOIN v_cls USING (wafer_id) JOIN supplier ON s_suppkey = wafer_id GROUP BY 1, 2""")


@query("scan_wafers", """
SELECT wafer_id, lot_id, cls, h AS n_rows, w AS n_cols, n AS dies, f AS fails FROM v_wafers WHERE cls IS NOT NULL""")
def _(spark, sf):
    path = shared_path(spark, "wafers")
    V.wafers(spark, sf).write.parquet(path)
    flat = F.flatten("wafer_map")
    return readers.read_wafers(spark, path).select(
        "wafer_id", "lot_id", "cls", F.size("wafer_map").alias("n_rows"), F.size(F.get("wafer_map", F.lit(0))).alias("n_cols"),
        F.size(F.filter(flat, lambda v: v > 0)).alias("dies"), F.size(F.filter(flat, lambda v: v == 2)).alias("fails"))


cte("v_process", """
SELECT 'W' || event_id AS wafer_id, event_id AS seq, 'L' || (user_id % 7) AS lot_id,
       CASE event_type WHEN 'view' THEN 'None' WHEN 'click' THEN 'Edge-Ring' WHEN 'error' THEN 'Scratch'
                       WHEN 'signup' THEN 'Center' ELSE 'Loc' END AS class,
       CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'B' ELSE ['A', 'B', 'C'][user_id % 3 + 1] END AS chamber,
       value + CASE WHEN event_type = 'click' THEN 10.0 ELSE 0.0 END AS etch_time_s,
       (event_id % 400) * 2 + CASE WHEN event_type = 'error' THEN 120 ELSE 0 END AS cmp_pad_cycles
FROM events""")


@query("scan_process_csv", "SELECT wafer_id, seq, lot_id, class, chamber, etch_time_s, CAST(cmp_pad_cycles AS INT) AS cmp_pad_cycles FROM v_process")
def _(spark, sf):
    path = shared_path(spark, "process")
    log = V.process(spark, sf)
    log.write.option("header", True).csv(path)
    return readers.read_process_log(spark, path).select(
        "wafer_id", F.col("seq").cast("long"), "lot_id", "class", "chamber",
        F.col("etch_time_s").cast("double"), F.col("cmp_pad_cycles").cast("int"))


@query("scan_image_folder", """
SELECT 'wafer_' || wafer_id || '.bmp' AS image, (SELECT cls FROM v_cls k WHERE k.wafer_id = g.wafer_id) AS cls,
       54 + h * (w * 3 + (4 - w * 3 % 4) % 4) AS bytes, h * w AS pixels,
       n - f AS pass_px, f AS fail_px FROM v_wafers g""")
def _(spark, sf):
    root = shared_path(spark, "images")
    w = V.wafers(spark, sf).select("wafer_id", V.class_name(F.col("wafer_id")).alias("cls"), "wafer_map")
    writers.write_bitmaps(w, root).count()             # runs the write; each task writes its own wafers
    meta = readers.read_image_folder(spark, root).select(F.col("file").alias("image"), "cls", F.col("length").alias("bytes"))
    px = readers.image_pixels(spark, root).groupBy("image").agg(
        F.count("*").alias("pixels"), F.count_if(F.col("g") == 145).alias("pass_px"), F.count_if(F.col("g") == 231).alias("fail_px"))
    return meta.join(px, "image")


@query("explode_dies", "SELECT wafer_id, r, c, state FROM v_dies")
def _(spark, sf):
    return D.explode_dies(V.wafers(spark, sf))


@query("collect_die_map", """
SELECT wafer_id, string_agg(line, '/' ORDER BY r) AS wafer_map FROM (
  SELECT g.wafer_id, g.r, string_agg(CAST(coalesce(state, 0) AS VARCHAR), '' ORDER BY g.c) AS line
  FROM (SELECT wafer_id, r, unnest(range(w)) AS c FROM (SELECT wafer_id, w, unnest(range(h)) AS r FROM v_grids)) g
  LEFT JOIN v_dies d ON d.wafer_id = g.wafer_id AND d.r = g.r AND d.c = g.c GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    text = F.array_join(F.transform("wafer_map", lambda row: F.array_join(row.cast("array<string>"), "")), "/")
    return D.collect_die_map(V.dies(spark, sf)).select("wafer_id", text.alias("wafer_map"))


@query("validate_wafers", """
SELECT wafer_id, CASE wafer_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not rectangular' WHEN 2 THEN 'bad value' WHEN 3 THEN 'no dies'
       WHEN 4 THEN 'too large' ELSE 'empty' END AS reason FROM v_wafers""")
def _(spark, sf):
    """Valid maps and one planted fault of each kind."""
    m, k = F.col("wafer_map"), F.col("wafer_id") % 6
    faulty = (F.when(k == 1, F.transform(m, lambda row, i: F.when(i == 0, F.slice(row, 1, F.size(row) - 1)).otherwise(row)))
              .when(k == 2, F.transform(m, lambda row, i: F.when(i == 0, F.transform(row, lambda v: (v + 3).cast("byte"))).otherwise(row)))
              .when(k == 3, F.transform(m, lambda row: F.transform(row, lambda v: F.lit(0).cast("byte"))))
              .when(k == 4, F.flatten(F.array_repeat(m, 40)))
              .when(k == 5, F.array().cast("array<array<tinyint>>")).otherwise(m))
    return validation.validate_wafers(V.wafers(spark, sf).select("wafer_id", faulty.alias("wafer_map"))).select("wafer_id", "reason")


@query("validate_geometry", """
SELECT s_suppkey AS wafer_id, d > 0 AND d <= 450 AS diameter_ok, e BETWEEN 0 AND 20 AS exclusion_ok,
       w IS NULL OR (w > 0 AND w <= 100) AS die_w_ok, h IS NULL OR (h > 0 AND h <= 100) AS die_h_ok
FROM (SELECT s_suppkey, s_acctbal / 20 AS d, s_suppkey % 25 - 1.0 AS e, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 90 END AS w,
             CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 50 END AS h FROM supplier)""")
def _(spark, sf):
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    geo = table(spark, sf, "supplier").select(
        k.alias("wafer_id"), (b / 20).alias("wafer_diameter_mm"), (k % 25 - 1.0).alias("edge_exclusion_mm"),
        F.when(k % 3 != 0, b / 90).alias("die_w_mm"), F.when(k % 4 != 0, b / 50).alias("die_h_mm"))
    return validation.validate_geometry(geo).select("wafer_id", "diameter_ok", "exclusion_ok", "die_w_ok", "die_h_ok")


@query("batch_limits", """
SELECT lot_id AS batch, count(*) AS wafers, CAST(sum(h * w) AS BIGINT) AS grid_dies,
       CASE WHEN count(*) > 256 THEN 'too many wafers' WHEN sum(h * w) > 2000000 THEN 'too many dies' ELSE 'accepted' END AS reason,
       CASE WHEN count(*) > 5 THEN 'too many wafers' WHEN sum(h * w) > 2100 THEN 'too many dies' ELSE 'accepted' END AS reason_small
FROM v_wafers GROUP BY 1""")
def _(spark, sf):
    return validation.batch_limits(V.map_sizes(spark, sf)).withColumn("reason_small", validation.limit_reason(5, 2100))


@query("parse_nested_label", "SELECT wafer_id, cls AS label FROM v_wafers WHERE cls IS NOT NULL")
def _(spark, sf):
    return V.wafers(spark, sf).select("wafer_id", L.nested_label(F.col("failureType")).alias("label")).dropna(subset=["label"])


@query("write_wafers", "SELECT cls, count(*) AS wafers, CAST(sum(h) AS BIGINT) AS map_rows FROM v_wafers WHERE cls IS NOT NULL GROUP BY 1")
def _(spark, sf):
    path = shared_path(spark, "dataset")
    labelled = V.wafers(spark, sf).withColumn("cls", L.nested_label(F.col("failureType"))).where("cls IS NOT NULL")
    writers.write_wafers(labelled, path, lambda written: written.groupBy("cls").agg(F.count("*").alias("wafers")))
    back = spark.read.parquet(f"{path}/wafers").groupBy("cls").agg(F.sum(F.size("wafer_map")).alias("map_rows"))
    return spark.read.parquet(f"{path}/audit").join(back, "cls")


# ---------------------------------------------------------------- labels
cte("v_rawlabel", """
SELECT CASE WHEN user_id % 11 = 0 THEN 'mystery' ELSE CASE event_type WHEN 'view' THEN ' None ' WHEN 'click' THEN 'edge ring'
       WHEN 'error' THEN 'SCRATCH' WHEN 'signup' THEN 'Near_Full' ELSE 'Local' END END AS raw FROM events""")


@query("canonical_label", """
SELECT raw, CASE raw WHEN ' None ' THEN 'None' WHEN 'edge ring' THEN 'Edge-Ring' WHEN 'SCRATCH' THEN 'Scratch'
       WHEN 'Near_Full' THEN 'Near-full' WHEN 'Local' THEN 'Loc' END AS cls, count(*) AS wafers FROM v_rawlabel GROUP BY 1, 2""")
def _(spark, sf):
    t = F.col("event_type")
    raw = F.when(F.col("user_id") % 11 == 0, "mystery").otherwise(
        F.when(t == "view", " None ").when(t == "click", "edge ring").when(t == "error", "SCRATCH")
        .when(t == "signup", "Near_Full").otherwise("Local"))
    return (table(spark, sf, "events").select(raw.alias("raw")).withColumn("cls", L.canonical_label(F.col("raw")))
            .groupBy("raw", "cls").agg(F.count("*").alias("wafers")))


cte("v_files", """
SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 10 = 0 THEN 'plain_' || doc_id || '.png'
       ELSE 'image_' || (doc_id % 700) || '_png_jpg.rf.' || md5(text) || '.jpg' END AS f FROM documents""")
cte("v_sources", r"""
SELECT *, CASE WHEN stem <> f THEN stem ELSE regexp_replace(f, '^(.+)\.[^.]*$', '\1') END AS source
FROM (SELECT *, regexp_replace(f, '(?i)(_(png|jpe?g|bmp))*\.rf\.[0-9a-f]+\.\w+$', '') AS stem FROM v_files)""")


@query("source_id", "SELECT doc_id, f, source FROM v_sources")
def _(spark, sf):
    return V.files(spark, sf).select("doc_id", "f", L.source_id(F.col("f")).alias("source"))


# ---------------------------------------------------------------- probability vectors
cte("v_vec", """
SELECT vec_id, label AS y, CAST(i AS INT) AS i, CAST(v AS DOUBLE) AS v, vec_id // 4 AS grp, CAST(vec_id // 4 % 5 AS INT) AS fold
FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)""")
cte("v_cent", "SELECT y AS k, i, avg(v) AS m FROM v_vec GROUP BY 1, 2")
cte("v_preds", """
SELECT e.vec_id, e.y, e.grp, e.fold, c.k, round(10 * sum(e.v * c.m), 9) AS z
FROM v_vec e JOIN v_cent c USING (i) GROUP BY 1, 2, 3, 4, 5""")
cte("v_soft", """
SELECT vec_id, y, grp, fold, k, z, e / sum(e) OVER (PARTITION BY vec_id) AS p
FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM v_preds)""")
cte("v_prob", "SELECT vec_id, y, grp, fold, k, z, round(p, 12) AS p FROM v_soft")
cte("v_top", """
SELECT vec_id, y, grp, fold, max(p) AS conf, arg_max(k, (p, -k)) AS pred FROM v_prob GROUP BY 1, 2, 3, 4""")


@query("softmax", f"SELECT vec_id, k, {R('p')} AS p FROM v_soft")
def _(spark, sf):
    return D.rounded(V.preds(spark, sf).select("vec_id", F.posexplode(A.softmax(F.col("z"))).alias("k", "p")), "p")


@query("entropy", f"SELECT vec_id, {R('-sum(p * ln(greatest(1e-12, least(1.0, p))))')} AS entropy FROM v_soft GROUP BY 1")
def _(spark, sf):
    p = V.preds(spark, sf).select("vec_id", A.softmax(F.col("z")).alias("p"))
    return p.select("vec_id", r6(A.entropy(F.col("p"))).alias("entropy"))


@query("temperature_apply", f"""
SELECT vec_id, k, {R('e / sum(e) OVER (PARTITION BY vec_id)')} AS p
FROM (SELECT vec_id, k, exp((z - max(z) OVER (PARTITION BY vec_id)) / 0.5) AS e FROM v_preds)""")
def _(spark, sf):
    return D.rounded(V.preds(spark, sf).select("vec_id", F.posexplode(A.tempered_softmax(F.col("z"), 0.5)).alias("k", "p")), "p")


@query("dirichlet", f"""
SELECT vec_id, k, {R('a / sum(a) OVER (PARTITION BY vec_id)')} AS p, {R('10 / sum(a) OVER (PARTITION BY vec_id)')} AS u
FROM (SELECT vec_id, k, ln(1 + exp(z)) + 1 AS a FROM v_preds)""")
def _(spark, sf):
    p, u = A.dirichlet(F.col("z"))
    return D.rounded(V.preds(spark, sf).select("vec_id", u.alias("u"), F.posexplode(p).alias("k", "p")), "p", "u")


@query("top2", f"""
SELECT vec_id, max(k) FILTER (n = 1) AS top1, {R('max(p) FILTER (n = 1)')} AS p1, max(k) FILTER (n = 2) AS top2, {R('max(p) FILTER (n = 2)')} AS p2
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS n FROM v_prob) GROUP BY 1""")
def _(spark, sf):
    s = V.probs(spark, sf).select("vec_id", A.ranked(F.col("p")).alias("s"))
    return s.select("vec_id", F.col("s")[0]["k"].alias("top1"), r6(F.col("s")[0]["p"]).alias("p1"),
                    F.col("s")[1]["k"].alias("top2"), r6(F.col("s")[1]["p"]).alias("p2"))


THRESHOLDS = {k: (k + 1) / 20 for k in range(8)}       # class 8 has none, class 9 plays the baseline


@query("alarms", """
SELECT vec_id, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (k < 8 AND k <> pred AND p >= (k + 1) / 20.0), '') AS alarms
FROM v_prob JOIN v_top USING (vec_id) GROUP BY 1""")
def _(spark, sf):
    hit = A.alarms(F.col("p"), F.col("pred"), THRESHOLDS, V.N_CLASSES, baseline=9)
    return V.probs(spark, sf).select("vec_id", F.array_join(hit.cast("array<string>"), ",").alias("alarms"))


@query("meta_features", f"""
SELECT vec_id, CAST(k AS INT) AS pos, {R('ln(greatest(1e-6, least(1, p)))')} AS value FROM v_soft
UNION ALL SELECT vec_id, CAST(10 + k AS INT), {R('ln(greatest(1e-6, least(1, e / sum(e) OVER (PARTITION BY vec_id))))')}
FROM (SELECT vec_id, k, exp((z - max(z) OVER (PARTITION BY vec_id)) / 0.5) AS e FROM v_preds)
UNION ALL SELECT vec_id, 20, {R('10 / sum(ln(1 + exp(z)) + 1)')} FROM v_preds GROUP BY 1""")
def _(spark, sf):
    z = F.col("z")
    meta = F.concat(A.log_clipped(A.softmax(z)), A.log_clipped(A.tempered_softmax(z, 0.5)), F.array(A.dirichlet(z)[1]))
    return D.rounded(V.preds(spark, sf).select("vec_id", F.posexplode(meta).alias("pos", "value")), "value")
