"""Queries over dies: geometry, quantification, clusters, patterns, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.constants import CLASSES
from diegrid.functions.numeric import r6, wilson
from diegrid.operators import dies as D, quantify as Q
from diegrid.plans.registry import BODIES, R, cte, query
from diegrid.sources import views as V

_CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"

cte("v_dies", """
SELECT CAST(l_suppkey AS BIGINT) AS wafer_id, CAST(l_partkey % 26 AS INT) AS r, CAST(l_orderkey % 26 AS INT) AS c,
       MAX(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS state,
       MAX(l_extendedprice * l_discount) AS cam
FROM lineitem GROUP BY 1, 2, 3""")
cte("v_cls", f"SELECT wafer_id, {_CLASS_LIST}[CAST(wafer_id % 9 + 1 AS INT)] AS cls FROM (SELECT DISTINCT wafer_id FROM v_dies)")
cte("v_ext", """
SELECT wafer_id, min(r) rmin, max(r) rmax, min(c) cmin, max(c) cmax, max(r) - min(r) + 1 h, max(c) - min(c) + 1 w,
       greatest(max(r) - min(r), max(c) - min(c)) + 1 s, count(*) n, count(*) FILTER (state = 2) f,
       (min(r) + max(r)) / 2.0 cy, (min(c) + max(c)) / 2.0 cx,
       294.0 / (max(c) - min(c) + 1) dw, 294.0 / (max(r) - min(r) + 1) dh
FROM v_dies GROUP BY 1""")
cte("v_polar", """
SELECT d.wafer_id, d.r, d.c, d.state, sqrt((c - cx) * (c - cx) + (cy - r) * (cy - r)) / (s / 2.0) AS radius,
       (degrees(atan2(CAST(cy - r AS DOUBLE), CAST(c - cx AS DOUBLE))) + 360) % 360 AS theta
FROM v_dies d JOIN v_ext USING (wafer_id)""")
cte("v_fails", "SELECT wafer_id, r, c, cam FROM v_dies WHERE state = 2")
cte("v_near", """
SELECT d.wafer_id, d.r, d.c, d.state, d.cam, count(f.r) AS neighbors
FROM v_dies d LEFT JOIN v_fails f ON f.wafer_id = d.wafer_id AND abs(f.r - d.r) <= 1 AND abs(f.c - d.c) <= 1
     AND NOT (f.r = d.r AND f.c = d.c)
GROUP BY 1, 2, 3, 4, 5""")


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    mid = f"(({k}/{n} + 1.96*1.96/(2*{n})) / (1 + 1.96*1.96/{n}))"
    half = f"(1.96*sqrt({k}/{n}*(1-{k}/{n})/{n} + 1.96*1.96/(4*{n}*{n})) / (1 + 1.96*1.96/{n}))"
    return tuple(f"CASE WHEN {n} > 0 THEN {b} ELSE 0.0 END" for b in (f"greatest(0.0, {mid} - {half})", f"least(1.0, {mid} + {half})"))


def reach_cte(name: str, cells: str, keys: str, touch: str) -> None:
    """All (cell, reachable cell) pairs of a cell set, then the smallest reachable code as label."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"n.{x} = p.{x}" for x in k)
    cte(f"{name}_reach", f"""
SELECT {keys}, r, c, r * 4096 + c AS root FROM {cells}
UNION
SELECT {", ".join("p." + x for x in k)}, n.r, n.c, p.root FROM {name}_reach p JOIN {cells} n ON {on} AND {touch}""")
    cte(name, f"SELECT {keys}, r, c, CAST(min(root) AS BIGINT) AS comp FROM {name}_reach GROUP BY {keys}, r, c")


TOUCH8 = "abs(n.r - p.r) <= 1 AND abs(n.c - p.c) <= 1"
TOUCH4 = "abs(n.r - p.r) + abs(n.c - p.c) = 1"
reach_cte("v_comp8", "v_fails", "wafer_id", TOUCH8)
reach_cte("v_comp4", "v_fails", "wafer_id", TOUCH4)
cte("v_core", """
SELECT wafer_id, k AS mn, r, c, cam FROM v_near JOIN v_cls USING (wafer_id), (VALUES (1), (2), (3)) t(k)
WHERE state = 2 AND neighbors >= k AND cls NOT IN ('None', 'Random', 'Near-full')""")
reach_cte("v_corecomp", "v_core", "wafer_id, mn", TOUCH8)
cte("v_corestat", """
SELECT wafer_id, mn, comp, count(*) AS size, max(cam) AS hot
FROM v_corecomp JOIN v_core USING (wafer_id, mn, r, c) GROUP BY 1, 2, 3""")
cte("v_cammax", "SELECT wafer_id, max(cam) AS cam_max FROM v_dies GROUP BY 1")
cte("v_whole", "SELECT wafer_id, r, c FROM v_fails JOIN v_cls USING (wafer_id) WHERE cls IN ('Random', 'Near-full')")
cte("v_pattern", """
SELECT wafer_id, r, c FROM v_corecomp JOIN v_corestat USING (wafer_id, mn, comp) WHERE mn = 2 AND size >= 3
UNION ALL SELECT wafer_id, r, c FROM v_whole""")
cte("v_camsets", """
SELECT s.wafer_id, s.mn, frac, comp, size, hot >= frac * cam_max AND cam_max > 0 AS focus,
       bool_or(hot >= frac * cam_max AND cam_max > 0) OVER (PARTITION BY s.wafer_id, s.mn, frac) AS any_focus
FROM v_corestat s JOIN v_cammax m ON s.wafer_id = m.wafer_id, (VALUES (CAST(0.3 AS DOUBLE)), (0.5), (0.7)) t(frac) WHERE size >= 3""")
reach_cte("v_patcomp", "v_pattern", "wafer_id", TOUCH8)
cte("v_regions", """
SELECT wafer_id, comp, count(*) AS size, sum(r) AS sr, sum(c) AS sc,
       row_number() OVER (PARTITION BY wafer_id ORDER BY count(*) DESC, comp) AS region
FROM v_patcomp GROUP BY 1, 2""")


def pattern(spark, sf):
    return Q.segment_pattern(V.dies(spark, sf), V.wafer_classes(spark, sf))


# ---------------------------------------------------------------- dies and geometry
@query("native_crop", """
SELECT wafer_id, r - rmin AS r, c - cmin AS c, state, h AS height, w AS width FROM v_dies JOIN v_ext USING (wafer_id)""")
def _(spark, sf):
    return D.native_crop(V.dies(spark, sf))


@query("square_pad", """
SELECT wafer_id, CAST(r - rmin + (s - h) // 2 AS INT) AS r, CAST(c - cmin + (s - w) // 2 AS INT) AS c, state, s
FROM v_dies JOIN v_ext USING (wafer_id)""")
def _(spark, sf):
    return D.square_pad(V.dies(spark, sf))


cte("v_square", """
SELECT wafer_id, r - rmin + (s - h) // 2 AS r, c - cmin + (s - w) // 2 AS c, state, s FROM v_dies JOIN v_ext USING (wafer_id)""")
cte("v_axis", """
SELECT s, i, j, least((j + 1) * s, (i + 1) * 64) - greatest(j * s, i * 64) AS o
FROM (SELECT DISTINCT s FROM v_ext), LATERAL (SELECT unnest(range(s)) AS i), (SELECT unnest(range(64)) AS j)
WHERE least((j + 1) * s, (i + 1) * 64) > greatest(j * s, i * 64)""")
cte("v_cells", """
SELECT wafer_id, CAST(a.j AS INT) AS y, CAST(b.j AS INT) AS x, CAST(sum(a.o * b.o) AS BIGINT) AS wn,
       CAST(sum(CASE WHEN state = 2 THEN a.o * b.o ELSE 0 END) AS BIGINT) AS fn, CAST(max(q.s * q.s) AS BIGINT) AS s2
FROM v_square q JOIN v_axis a ON a.s = q.s AND a.i = q.r JOIN v_axis b ON b.s = q.s AND b.i = q.c GROUP BY 1, 2, 3""")


@query("resample_area", f"""
SELECT wafer_id, y, x, {R('wn / s2')} AS w, {R('fn / s2')} AS f FROM v_cells""")
def _(spark, sf):
    return D.resample_area(V.dies(spark, sf)).select(
        "wafer_id", "y", "x", r6(F.col("wn") / F.col("s2")).alias("w"), r6(F.col("fn") / F.col("s2")).alias("f"))


@query("resample_back", f"""
WITH t AS (
  SELECT s, d, lo AS src, 1 - t AS w FROM (SELECT s, d, p, floor(p) AS lo, p - floor(p) AS t FROM (
    SELECT s, d, greatest(0.0, least(63.0, (d + 0.5) * 64 / s - 0.5)) AS p
    FROM (SELECT DISTINCT s FROM v_ext), LATERAL (SELECT unnest(range(s)) AS d)))
  UNION ALL
  SELECT s, d, lo + 1, t FROM (SELECT s, d, p, floor(p) AS lo, p - floor(p) AS t FROM (
    SELECT s, d, greatest(0.0, least(63.0, (d + 0.5) * 64 / s - 0.5)) AS p
    FROM (SELECT DISTINCT s FROM v_ext), LATERAL (SELECT unnest(range(s)) AS d))) WHERE t > 0)
SELECT wafer_id, q.r + rmin - (e.s - h) // 2 AS r, q.c + cmin - (e.s - w) // 2 AS c, {R('coalesce(v, 0)')} AS value
FROM v_square q JOIN v_ext e USING (wafer_id) LEFT JOIN (
  SELECT q.wafer_id, q.r, q.c, sum(x.fn / x.s2 * a.w * b.w) AS v
  FROM v_square q JOIN t a ON a.s = q.s AND a.d = q.r JOIN t b ON b.s = q.s AND b.d = q.c
  JOIN v_cells x ON x.wafer_id = q.wafer_id AND x.y = a.src AND x.x = b.src GROUP BY 1, 2, 3) k USING (wafer_id, r, c)
""".replace("WITH t AS (", "SELECT * FROM (WITH t AS (").rstrip() + ")")
def _(spark, sf):
    dies = V.dies(spark, sf)
    heat = D.resample_area(dies).select("wafer_id", "y", "x", (F.col("fn") / F.col("s2")).alias("value"))
    return D.rounded(D.resample_back(dies, heat), "value").select(
        "wafer_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "value")


@query("die_polar", f"SELECT wafer_id, r, c, state, {R('radius')} AS radius, {R('theta')} AS theta FROM v_polar")
def _(spark, sf):
    return D.rounded(D.die_polar(V.dies(spark, sf)), "radius", "theta")


@query("die_mm", f"""
SELECT wafer_id, r, c, state, {R('(c - cx) * dw')} AS x_mm, {R('(cy - r) * dh')} AS y_mm, {R('dw')} AS die_w_mm,
       {R('dh')} AS die_h_mm, 'estimated from grid span' AS die_size_source FROM v_dies JOIN v_ext USING (wafer_id)""")
def _(spark, sf):
    return D.rounded(D.die_mm(V.dies(spark, sf)), "x_mm", "y_mm", "die_w_mm", "die_h_mm")


_W = wilson_sql("f", "n")


cte("v_parts", """
SELECT wafer_id, n, f, 'all' AS part FROM v_ext
UNION ALL SELECT wafer_id, count(*) FILTER (WHERE r = rmin AND c = cmin), count(*) FILTER (WHERE r = rmin AND c = cmin AND state = 2), 'corner'
FROM v_dies JOIN v_ext USING (wafer_id) GROUP BY 1""")


@query("wilson", f"SELECT wafer_id, part, n, {R(_W[0])} AS lo, {R(_W[1])} AS hi FROM v_parts")
def _(spark, sf):
    """All dies of each wafer, and the corner of its grid, which mostly holds none."""
    g = D.with_extent(V.dies(spark, sf)).groupBy("wafer_id")
    corner = (F.col("r") == F.col("rmin")) & (F.col("c") == F.col("cmin"))
    g = g.agg(*[F.struct(F.lit(part).alias("part"), F.count_if(cond).alias("n"), F.count_if(cond & Q.is_fail()).alias("k")).alias(part)
                for part, cond in (("all", F.lit(True)), ("corner", corner))])
    g = g.select("wafer_id", F.inline(F.array("all", "corner")))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("wafer_id", "part", "n", r6(lo).alias("lo"), r6(hi).alias("hi"))


# ---------------------------------------------------------------- one wafer
@query("wafer_summary", f"""
SELECT wafer_id, n AS dies_total, f AS dies_failed, n - f AS dies_passed, {R('100.0 * f / n')} AS fail_pct,
       {R('100 * (1 - f / n)')} AS clean_pct, {R('100 * ' + _W[0])} AS wilson_lo, {R('100 * ' + _W[1])} AS wilson_hi
FROM v_ext""")
def wafer_summary(spark, sf):
    return D.rounded(Q.wafer_summary(V.dies(spark, sf)), "fail_pct", "clean_pct", "wilson_lo", "wilson_hi")


@query("fail_neighbors", "SELECT wafer_id, r, c, state, neighbors FROM v_near")
def _(spark, sf):
    return D.fail_neighbors(V.dies(spark, sf))


cte("v_rings", """
SELECT wafer_id, CAST(i AS INT) AS ring, count(r) AS dies,
       coalesce(avg(CASE WHEN state = 2 THEN 1.0 WHEN state = 1 THEN 0.0 END), 0) AS fail_density
FROM (SELECT wafer_id, unnest(range(10)) AS i FROM v_ext) LEFT JOIN v_polar p USING (wafer_id)
WHERE 1 = 1 AND (least(floor(radius * 10 + 1e-9), 9) = i) GROUP BY 1, 2""")
cte("v_ringsfull", """
SELECT g.wafer_id, CAST(i AS INT) AS ring, coalesce(dies, 0) AS dies, coalesce(fail_density, 0) AS fail_density
FROM (SELECT wafer_id, unnest(range(10)) AS i FROM v_ext) g LEFT JOIN v_rings v ON v.wafer_id = g.wafer_id AND v.ring = i""")


@query("radial_profile", f"SELECT wafer_id, ring, dies, {R('fail_density')} AS fail_density FROM v_ringsfull")
def _(spark, sf):
    return D.rounded(Q.radial_profile(V.dies(spark, sf)), "fail_density")


@query("angular_profile", f"""
SELECT g.wafer_id, CAST(i AS INT) AS sector, count(p.r) AS dies,
       {R('coalesce(avg(CASE WHEN state = 2 THEN 1.0 WHEN state = 1 THEN 0.0 END), 0)')} AS fail_density
FROM (SELECT wafer_id, unnest(range(12)) AS i FROM v_ext) g
LEFT JOIN v_polar p ON p.wafer_id = g.wafer_id AND floor(theta / 30 + 1e-9) % 12 = i GROUP BY 1, 2""")
def _(spark, sf):
    return D.rounded(Q.angular_profile(V.dies(spark, sf)), "fail_density")


def moran_sql(cells: str, y: str, x: str, v: str, min_sd: str = "0") -> str:
    return f"""
SELECT a.wafer_id, CASE WHEN max(a.n) >= 10 AND max(a.zz) > 0 AND count(b.z) > 0 AND sqrt(max(a.zz) / max(a.n)) >= {min_sd}
       THEN max(a.n) / (2.0 * count(b.z)) * 2 * coalesce(sum(a.z * b.z), 0) / max(a.zz) ELSE 0 END AS moran_i
FROM (SELECT *, sum(z * z) OVER (PARTITION BY wafer_id) AS zz FROM (
        SELECT wafer_id, {y} AS y, {x} AS x, count(*) OVER (PARTITION BY wafer_id) AS n,
               {v} - avg({v}) OVER (PARTITION BY wafer_id) AS z FROM {cells})) a
LEFT JOIN (SELECT wafer_id, {y} AS y, {x} AS x, {v} - avg({v}) OVER (PARTITION BY wafer_id) AS z FROM {cells}) b
ON b.wafer_id = a.wafer_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x))
GROUP BY 1"""


cte("v_moran", moran_sql("v_dies", "r", "c", "(CASE WHEN state = 2 THEN 1.0 ELSE 0.0 END)::DOUBLE"))


@query("morans_i", f"SELECT wafer_id, {R('moran_i')} AS moran_i FROM v_moran")
def _(spark, sf):
    return D.rounded(Q.wafer_moran(V.dies(spark, sf)), "moran_i")


def _clusters_sql(comp: str) -> str:
    return f"""
SELECT wafer_id, CAST(row_number() OVER (PARTITION BY wafer_id ORDER BY comp) AS INT) AS cluster, count(*) AS size,
       {R('sum(r) / count(*)')} AS row_mean, {R('sum(c) / count(*)')} AS col_mean,
       min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max
FROM {comp} GROUP BY wafer_id, comp"""


@query("fail_clusters", _clusters_sql("v_comp8"))
def _(spark, sf):
    return D.rounded(Q.fail_clusters(V.dies(spark, sf)), "row_mean", "col_mean")


@query("clusters_4conn", _clusters_sql("v_comp4"))
def _(spark, sf):
    return D.rounded(Q.fail_clusters(V.dies(spark, sf), connectivity=4), "row_mean", "col_mean")


@query("segment_pattern", """
SELECT 'no activation map' AS variant, wafer_id, r, c FROM v_pattern
UNION ALL
SELECT 'activation map', wafer_id, r, c FROM v_corecomp JOIN v_camsets USING (wafer_id, mn, comp)
WHERE mn = 2 AND frac = 0.5 AND (focus OR NOT any_focus)
UNION ALL SELECT 'activation map', wafer_id, r, c FROM v_whole""")
def _(spark, sf):
    dies, cls = V.dies(spark, sf), V.wafer_classes(spark, sf)
    plain = Q.segment_pattern(dies, cls).select(F.lit("no activation map").alias("variant"), "*")
    return plain.unionByName(Q.segment_pattern(dies, cls, V.activation(spark, sf)).select(F.lit("activation map").alias("variant"), "*"))


@query("segmentation_range", """
SELECT wafer_id, CASE WHEN count(k) = 9 THEN min(k) ELSE 0 END AS dies_min, coalesce(max(k), 0) AS dies_max
FROM v_ext LEFT JOIN (
  SELECT wafer_id, mn, frac, CAST(sum(size) AS BIGINT) AS k FROM v_camsets WHERE focus OR NOT any_focus GROUP BY 1, 2, 3
  UNION ALL
  SELECT wafer_id, mn, frac, count(*) FROM v_whole, (VALUES (1), (2), (3)) a(mn), (VALUES (0.3), (0.5), (0.7)) b(frac) GROUP BY 1, 2, 3
) USING (wafer_id) GROUP BY 1""")
def segmentation_range(spark, sf):
    return Q.segmentation_range(V.dies(spark, sf), V.wafer_classes(spark, sf), V.activation(spark, sf))


@query("segmentation_area", f"""
SELECT wafer_id, dies_min, dies_max, {R('100.0 * dies_min / n')} AS pct_min, {R('100.0 * dies_max / n')} AS pct_max,
       {R('dies_min * dw * dh')} AS mm2_min, {R('dies_max * dw * dh')} AS mm2_max
FROM ({BODIES["segmentation_range"]}) JOIN v_ext USING (wafer_id)""")
def _(spark, sf):
    return D.rounded(Q.segmentation_area(V.dies(spark, sf), segmentation_range(spark, sf)), "pct_min", "pct_max", "mm2_min", "mm2_max")


_WP = wilson_sql("p", "n")
cte("v_patn", "SELECT wafer_id, n, f, dw, dh, coalesce(p, 0) AS p FROM v_ext LEFT JOIN (SELECT wafer_id, count(*) AS p FROM v_pattern GROUP BY 1) USING (wafer_id)")


@query("pattern_area", f"""
SELECT wafer_id, p AS dies, {R('100.0 * p / n')} AS affected_pct, {R('100 - 100.0 * p / n')} AS clean_pct,
       {R('100 * ' + _WP[0])} AS wilson_lo, {R('100 * ' + _WP[1])} AS wilson_hi, {R('p * dw * dh')} AS area_mm2,
       f - p AS background_fail_dies FROM v_patn""")
def _(spark, sf):
    return D.rounded(Q.pattern_area(V.dies(spark, sf), pattern(spark, sf)),
                     "affected_pct", "clean_pct", "wilson_lo", "wilson_hi", "area_mm2")


@query("pattern_centroid", f"""
SELECT wafer_id, {R('rm')} AS row_mean, {R('cm')} AS col_mean, {R('(cm - cx) * dw')} AS x_mm, {R('(cy - rm) * dh')} AS y_mm,
       {R('sqrt((cm - cx) * (cm - cx) + (cy - rm) * (cy - rm)) / (s / 2)')} AS radius_norm,
       {R('(degrees(atan2(' + R('cy - rm') + ', ' + R('cm - cx') + ')) + 360) % 360')} AS angle_deg
FROM (SELECT wafer_id, sum(r) / count(*) AS rm, sum(c) / count(*) AS cm FROM v_pattern GROUP BY 1) JOIN v_ext USING (wafer_id)""")
def _(spark, sf):
    return D.rounded(Q.pattern_centroid(V.dies(spark, sf), pattern(spark, sf)),
                     "row_mean", "col_mean", "x_mm", "y_mm", "radius_norm", "angle_deg")


@query("pattern_regions", f"""
SELECT wafer_id, CAST(region AS INT) AS region, size AS dies, comp, {R('size * dw * dh')} AS area_mm2,
       {R('sr / size')} AS row_mean, {R('sc / size')} AS col_mean,
       {R('(sc / size - cx) * dw')} AS x_mm, {R('(cy - sr / size) * dh')} AS y_mm
FROM v_regions JOIN v_ext USING (wafer_id)""")
def _(spark, sf):
    return D.rounded(Q.pattern_regions(V.dies(spark, sf), pattern(spark, sf)), "area_mm2", "row_mean", "col_mean", "x_mm", "y_mm")


@query("region_polygons")
def _(spark, sf):
    return D.rounded(Q.region_polygons(V.dies(spark, sf), pattern(spark, sf)), "x_mm", "y_mm")


@query("clustering_stats", f"""
SELECT e.wafer_id, {R('moran_i')} AS morans_i, coalesce(k3, 0) AS clusters_ge3, coalesce(big, 0) AS largest_cluster_dies,
       {R('coalesce(n3 / f, 0)')} AS clustered_fail_frac, {R('coalesce(mn, 0)')} AS mean_fail_neighbors
FROM v_ext e JOIN v_moran USING (wafer_id)
LEFT JOIN (SELECT wafer_id, count(*) FILTER (k >= 3) AS k3, max(k) AS big, coalesce(sum(k) FILTER (k >= 3), 0) AS n3
           FROM (SELECT wafer_id, comp, count(*) AS k FROM v_comp8 GROUP BY 1, 2) GROUP BY 1) USING (wafer_id)
LEFT JOIN (SELECT wafer_id, avg(neighbors) AS mn FROM v_near WHERE state = 2 GROUP BY 1) USING (wafer_id)""")
def _(spark, sf):
    return D.rounded(Q.clustering_stats(V.dies(spark, sf)), "morans_i", "clustered_fail_frac", "mean_fail_neighbors")


_TAPS = Q.gaussian_taps()
cte("v_taps", "SELECT * FROM (VALUES " + ", ".join(f"({i - 6}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(_TAPS)) + ") t(k, g)")
cte("v_grids", "SELECT wafer_id, max(r) + 1 AS h, max(c) + 1 AS w FROM v_dies GROUP BY 1")


def _mirror(p: str, n: str) -> str:
    return f"(CASE WHEN {n} = 1 THEN 0 WHEN abs({p}) < {n} THEN abs({p}) ELSE abs(2 * ({n} - 1) - {p}) END)"


@query("density_heatmap", f"""
SELECT wafer_id, r, c, {R('v / (max(v) OVER (PARTITION BY wafer_id) + 1e-9)')} AS heat FROM (
  SELECT d.wafer_id, d.r, d.c, coalesce(sum(a.g * b.g) FILTER (f.r IS NOT NULL), 0) AS v
  FROM v_dies d JOIN v_grids USING (wafer_id), v_taps a, v_taps b
  LEFT JOIN v_fails f ON f.wafer_id = d.wafer_id AND f.r = {_mirror('(d.r + a.k)', 'h')} AND f.c = {_mirror('(d.c + b.k)', 'w')}
  GROUP BY 1, 2, 3)""")
def _(spark, sf):
    return D.rounded(Q.density_heatmap(V.dies(spark, sf)), "heat")


@query("failed_die_list", f"""
SELECT wafer_id, r, c, {R('(c - cx) * dw')} AS x_mm, {R('(cy - r) * dh')} AS y_mm, p.hit IS NOT NULL AS in_pattern,
       k AS rank, {R('100 * cam / 10000')} AS affected_pct
FROM (SELECT *, row_number() OVER (PARTITION BY wafer_id ORDER BY r, c) AS k FROM v_fails) q
JOIN (SELECT wafer_id, cx, cy, dw, dh, f AS n FROM v_ext) USING (wafer_id)
LEFT JOIN (SELECT wafer_id, r, c, 1 AS hit FROM v_pattern) p USING (wafer_id, r, c)""")
def _(spark, sf):
    affected = V.activation(spark, sf).select("wafer_id", "r", "c", (F.col("cam") / 10000).alias("affected"))
    return D.rounded(Q.failed_die_list(V.dies(spark, sf), pattern(spark, sf), affected=affected), "x_mm", "y_mm", "affected_pct")


# ---------------------------------------------------------------- batches
cte("v_batch", "SELECT CAST(s_suppkey AS BIGINT) AS wafer_id, s_nationkey AS batch FROM supplier")
_WB = wilson_sql("sum(f)", "sum(n)")


@query("batch_pool", f"""
SELECT batch, count(*) AS wafers, CAST(sum(n) AS BIGINT) AS dies_total, CAST(sum(f) AS BIGINT) AS dies_failed,
       {R('100.0 * sum(f) / sum(n)')} AS fail_pct, {R('100 * ' + _WB[0])} AS wilson_lo, {R('100 * ' + _WB[1])} AS wilson_hi,
       {R('100.0 * sum(p) / sum(n)')} AS pattern_pct FROM v_patn JOIN v_batch USING (wafer_id) GROUP BY 1""")
def _(spark, sf):
    return D.rounded(Q.batch_pool(V.dies(spark, sf), pattern(spark, sf), V.batches(spark, sf)),
                     "fail_pct", "wilson_lo", "wilson_hi", "pattern_pct")


@query("batch_mean_ci", f"""
SELECT batch, n AS wafers, {R('m')} AS mean, {R('m - CASE WHEN n > 1 THEN 1.96 * sd / sqrt(n) ELSE 0 END')} AS lo,
       {R('m + CASE WHEN n > 1 THEN 1.96 * sd / sqrt(n) ELSE 0 END')} AS hi
FROM (SELECT batch, count(*) AS n, avg(100.0 * f / n) AS m, stddev_samp(100.0 * f / n) AS sd
      FROM v_ext JOIN v_batch USING (wafer_id) GROUP BY 1)""")
def _(spark, sf):
    return D.rounded(Q.batch_mean_ci(V.dies(spark, sf), V.batches(spark, sf)), "mean", "lo", "hi")


@query("batch_class_counts", "SELECT batch, cls, count(*) AS wafers FROM v_cls JOIN v_batch USING (wafer_id) GROUP BY 1, 2")
def _(spark, sf):
    return Q.batch_class_counts(V.wafer_classes(spark, sf), V.batches(spark, sf))


@query("batch_heatmap", f"""
SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, {R('coalesce(t, 0) / (SELECT count(*) FROM v_ext)')} AS heat
FROM (SELECT y, x FROM (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x))
LEFT JOIN (SELECT y, x, sum(fn / s2) AS t FROM v_cells GROUP BY 1, 2) USING (y, x)""")
def _(spark, sf):
    return D.rounded(Q.batch_heatmap(V.dies(spark, sf)), "heat")


@query("batch_radial", f"SELECT ring, {R('avg(fail_density)')} AS fail_density FROM v_ringsfull GROUP BY 1")
def _(spark, sf):
    return D.rounded(Q.batch_radial(V.dies(spark, sf)), "fail_density")


@query("severity_band", """
SELECT wafer_id, cls, CASE WHEN cls = 'None' THEN 'NONE' WHEN 100.0 * p / n < 2 THEN 'LOW'
       WHEN 100.0 * p / n <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM v_patn JOIN v_cls USING (wafer_id)""")
def _(spark, sf):
    area = Q.pattern_area(V.dies(spark, sf), pattern(spark, sf))
    return (area.join(V.wafer_classes(spark, sf), "wafer_id")
            .select("wafer_id", "cls", Q.severity_band(F.col("cls"), F.col("affected_pct")).alias("severity")))
