"""Queries over pixels and die measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.operators import dies as D, pixels as X, quantify as Q
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V


def _colour(k: int) -> str:
    return f"[{', '.join(str(c[k]) for c in V.RENDERS['other'])}, {', '.join(str(c[k]) for c in V.RENDERS['standard'])}][s + 1 + CASE WHEN image % 3 = 1 THEN 0 ELSE 3 END]"


cte("v_px", f"""
SELECT image, y, x, {_colour(0)} AS r, {_colour(1)} AS g, {_colour(2)} AS b FROM (
  SELECT image, y, x, CAST(CASE WHEN (y * 7 + x * 13 + image) % 29 = 0 THEN (state + 1) % 3 ELSE state END AS INT) AS s FROM (
    SELECT g.wafer_id AS image, CAST(g.r * 4 + i AS INT) AS y, CAST(g.c * 4 + j AS INT) AS x, coalesce(d.state, 0) AS state
    FROM (SELECT wafer_id, r, unnest(range(w)) AS c FROM (SELECT wafer_id, w, unnest(range(h)) AS r FROM v_grids)) g
    LEFT JOIN v_dies d ON d.wafer_id = g.wafer_id AND d.r = g.r AND d.c = g.c,
    (VALUES (0), (1), (2), (3)) a(i), (VALUES (0), (1), (2), (3)) b(j)))""")


def _channel(k: int) -> str:
    v = f"CAST({X.VIRIDIS[-1][k]!r} AS DOUBLE)"
    for c in reversed(X.VIRIDIS[:-1]):
        v = f"({v} * (i / 255.0) + {c[k]!r})"
    return f"CAST(floor(greatest(0.0, least(255.0, {v} * 255)) + 0.5) AS INT)"


cte("v_map", f"SELECT i AS v, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM (SELECT CAST(unnest(range(256)) AS INT) AS i)")
cte("v_lut", """
SELECT qr, qg, qb, arg_min(v, (d, v)) AS v, arg_min(mr, (d, v)) AS mr, arg_min(mg, (d, v)) AS mg, arg_min(mb, (d, v)) AS mb
FROM (SELECT qr, qg, qb, m.v, m.r AS mr, m.g AS mg, m.b AS mb, pow(qr * 8 + 4 - m.r, 2) + pow(qg * 8 + 4 - m.g, 2) + pow(qb * 8 + 4 - m.b, 2) AS d
      FROM (SELECT DISTINCT r // 8 AS qr, g // 8 AS qg, b // 8 AS qb FROM v_px), v_map m) GROUP BY 1, 2, 3""")
cte("v_pos", """
SELECT image, y, x, v, sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)) AS dist FROM v_px JOIN v_lut ON r // 8 = qr AND g // 8 = qg AND b // 8 = qb""")
cte("v_hist", """
SELECT image, v, n, total, row_number() OVER (PARTITION BY image ORDER BY n DESC, v) AS rk
FROM (SELECT image, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY image) AS total FROM v_pos GROUP BY 1, 2)""")
cte("v_peaks", """
SELECT image, 0 AS rk, CAST([] AS INT[]) AS levels FROM v_grids2
UNION ALL
SELECT p.image, p.rk + 1, CASE WHEN h.n >= 0.004 * h.total AND len(list_filter(p.levels, lambda a: abs(a - h.v) <= 24)) = 0
                              THEN list_append(p.levels, h.v) ELSE p.levels END
FROM v_peaks p JOIN v_hist h ON h.image = p.image AND h.rk = p.rk + 1""")
cte("v_grids2", "SELECT wafer_id AS image, h * 4 AS h, w * 4 AS w FROM v_grids")
cte("v_levels", """
SELECT image, std, CASE WHEN std THEN [0, 128, 255] ELSE list_sort(levels) END AS levels,
       CASE WHEN std THEN [0, 1, 2] WHEN len(levels) = 2 THEN [0, CASE WHEN list_sort(levels)[2] < 128 THEN 1 ELSE 2 END]
            ELSE list_transform(range(len(levels)), lambda i: least(i, 2)) END AS codes
FROM (SELECT image, arg_max(levels, rk) AS levels FROM v_peaks GROUP BY 1)
JOIN (SELECT image, sum(n) FILTER (abs(v - 0) <= 24 OR abs(v - 128) <= 24 OR abs(v - 255) <= 24) / max(total) >= 0.9 AS std FROM v_hist GROUP BY 1) USING (image)""")
cte("v_code", """
SELECT image, v, CAST(arg_min(c, (abs(a - v), a)) AS INT) AS state
FROM (SELECT h.image, h.v, unnest(levels) AS a, unnest(codes) AS c FROM v_hist h JOIN v_levels l ON l.image = h.image) GROUP BY 1, 2""")
cte("v_state", "SELECT p.image, y, x, state FROM v_pos p JOIN v_code c ON c.image = p.image AND c.v = p.v")


def positions(spark, sf):
    return X.with_position(V.pixels(spark, sf))


def states(spark, sf):
    return X.pixel_states(positions(spark, sf))


@query("palette_levels", """
SELECT image, CASE WHEN std THEN 'standard' ELSE 'levels[' || array_to_string(levels, ', ') || ']' END AS palette, array_to_string(codes, ',') AS codes FROM v_levels""")
def _(spark, sf):
    return X.palette_levels(positions(spark, sf)).select("image", "palette", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("pixel_states", "SELECT image, y, string_agg(CAST(state AS VARCHAR), '' ORDER BY x) AS line FROM v_state GROUP BY 1, 2")
def _(spark, sf):
    return X.state_lines(states(spark, sf))


cte("v_change", """
SELECT image, 'rows' AS axis, y AS pos, count(*) AS n FROM (SELECT *, lag(state) OVER (PARTITION BY image, x ORDER BY y) AS p FROM v_state)
JOIN v_grids2 g USING (image) WHERE p <> state GROUP BY 1, 3
UNION ALL SELECT image, 'cols', x, count(*) FROM (SELECT *, lag(state) OVER (PARTITION BY image, y ORDER BY x) AS p FROM v_state)
JOIN v_grids2 g USING (image) WHERE p <> state GROUP BY 1, 3""")
cte("v_score", """
SELECT image, axis, k, sum(n) AS m, sqrt(pow(sum(n * cos(2 * pi() * k * pos / size)), 2) + pow(sum(n * sin(2 * pi() * k * pos / size)), 2)) / sum(n) AS score
FROM (SELECT c.*, CASE axis WHEN 'rows' THEN h ELSE w END AS size FROM v_change c JOIN v_grids2 USING (image)), (SELECT unnest(range(12, 161)) AS k) GROUP BY 1, 2, 3""")
cte("v_pitch", """
SELECT g.image, g.h, g.w, CAST(min(k) FILTER (axis = 'rows') AS INT) AS n_rows, CAST(min(k) FILTER (axis = 'cols') AS INT) AS n_cols
FROM v_grids2 g LEFT JOIN (SELECT *, max(score) OVER (PARTITION BY image, axis) AS top FROM v_score) s
  ON s.image = g.image AND m >= 20 AND score >= 0.8 * top GROUP BY 1, 2, 3""")


@query("grid_pitch", "SELECT image, h, w, n_rows, n_cols FROM v_pitch")
def _(spark, sf):
    return X.grid_pitch(states(spark, sf)).withColumnRenamed("rows", "n_rows").withColumnRenamed("cols", "n_cols")


cte("v_votes", """
SELECT image, r, c, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS state, n0, n1, n2 FROM (
  SELECT image, r, c, count(*) FILTER (near AND state = 0) AS v0, count(*) FILTER (near AND state = 1) AS v1, count(*) FILTER (near AND state = 2) AS v2,
         count(*) FILTER (state = 0) AS n0, count(*) FILTER (state = 1) AS n1, count(*) FILTER (state = 2) AS n2
  FROM (SELECT *, y BETWEEN floor((r + 0.5) * h / n_rows) - k // 2 AND floor((r + 0.5) * h / n_rows) - k // 2 + k - 1
              AND x BETWEEN floor((c + 0.5) * w / n_cols) - k // 2 AND floor((c + 0.5) * w / n_cols) - k // 2 + k - 1 AS near
        FROM (SELECT s.*, h, w, n_rows, n_cols, CAST(y * n_rows // h AS INT) AS r, CAST(x * n_cols // w AS INT) AS c,
                     greatest(1, CAST(floor(0.4 * least(h / n_rows, w / n_cols)) AS INT)) AS k
              FROM v_state s JOIN v_pitch USING (image) WHERE n_rows IS NOT NULL AND n_cols IS NOT NULL)) GROUP BY 1, 2, 3)""")


@query("cell_vote", "SELECT image, r, c, state FROM v_votes")
def _(spark, sf):
    return X.cell_votes(states(spark, sf)).select("image", "r", "c", "state")


cte("v_agree", "SELECT image, sum(CASE state WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END) / sum(n0 + n1 + n2) AS agreement FROM v_votes GROUP BY 1")


@query("render_agreement", f"SELECT image, {R('agreement')} AS agreement FROM v_agree")
def _(spark, sf):
    return D.rounded(X.render_agreement(X.cell_votes(states(spark, sf))), "agreement")


@query("audit_agreement", f"""
SELECT {R('min(agreement)')} AS "min", {R('quantile_cont(agreement, 0.01)')} AS p01, {R('quantile_cont(agreement, 0.5)')} AS median FROM v_agree""")
def _(spark, sf):
    return D.rounded(X.audit_agreement(X.render_agreement(X.cell_votes(states(spark, sf)))), "min", "p01", "median")


@query("looks_rendered", f"""
SELECT image, {R('avg(CASE WHEN dist < 40 THEN 1.0 ELSE 0 END)')} AS share, avg(CASE WHEN dist < 40 THEN 1.0 ELSE 0 END) > 0.9 AS rendered
FROM v_pos GROUP BY 1""")
def _(spark, sf):
    return D.rounded(X.looks_rendered(positions(spark, sf)), "share")


cte("v_dpx", """
SELECT *, value - median(value) OVER (PARTITION BY wafer_id, r, c) AS v FROM (
  SELECT CAST(l_suppkey AS BIGINT) AS wafer_id, CAST(l_partkey % 26 AS INT) AS r, CAST(l_orderkey % 26 AS INT) AS c, l_linenumber AS px, max(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2, 3, 4)""")
cte("v_golden", "SELECT wafer_id, px, median(v) AS golden FROM v_dpx GROUP BY 1, 2")
cte("v_dev", """
SELECT wafer_id, r, c, abs(any_value(own) - median(v)) AS diff FROM (
  SELECT d.wafer_id, d.r, d.c, d.px, d.v AS own, coalesce(n.v, g.golden) AS v
  FROM v_dpx d JOIN v_golden g ON g.wafer_id = d.wafer_id AND g.px = d.px,
       (SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE i <> 0 OR j <> 0) o
  LEFT JOIN v_dpx n ON n.wafer_id = d.wafer_id AND n.px = d.px AND n.r = d.r + o.i AND n.c = d.c + o.j) GROUP BY wafer_id, r, c, px""")


@query("die_to_die", f"""
SELECT wafer_id, r, c, {R('affected')} AS affected, CASE WHEN affected >= 0.05 THEN 2 ELSE 1 END AS state FROM (
  SELECT wafer_id, r, c, avg(CASE WHEN diff > 2 * 1.4826 * mad THEN 1.0 ELSE 0 END) AS affected
  FROM v_dev JOIN (SELECT wafer_id, median(diff) + 1e-6 AS mad FROM v_dev GROUP BY 1) USING (wafer_id) GROUP BY 1, 2, 3)""")
def _(spark, sf):
    return D.rounded(X.die_to_die(V.die_px(spark, sf), k_mad=2.0), "affected")


cte("v_blob", """
SELECT wafer_id AS image, row_number() OVER (PARTITION BY wafer_id ORDER BY comp) AS blob, count(*) AS area_px,
       max(r) - min(r) + 1.0 AS length, max(c) - min(c) + 1.0 AS width FROM v_comp8 GROUP BY wafer_id, comp""")


@query("blob_shape", f"""
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY area_px DESC, blob) AS INT) AS rank, {R('area_px * 0.000025')} AS area_um2,
       {R('circ')} AS circularity, {R('elong')} AS elongation, CASE WHEN elong > 4 THEN 'scratch' WHEN circ > 0.7 THEN 'particle' ELSE 'residue/irregular' END AS shape_hint
FROM (SELECT *, 4 * pi() * area_px / (pow(2 * (length + width), 2) + 1e-9) AS circ, greatest(length, width) / (least(length, width) + 1e-9) AS elong FROM v_blob WHERE area_px >= 2)""")
def _(spark, sf):
    h, w = F.col("r_max") - F.col("r_min") + 1.0, F.col("c_max") - F.col("c_min") + 1.0
    blobs = Q.fail_clusters(V.dies(spark, sf)).select(
        F.col("wafer_id").alias("image"), F.col("cluster").alias("blob"), F.col("size").alias("area_px"), (2 * (h + w)).alias("perimeter"), h.alias("length"), w.alias("width"))
    return D.rounded(X.blob_shapes(blobs, min_px=2), "area_um2", "circularity", "elongation")
