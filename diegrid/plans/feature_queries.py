"""Queries over the morphology features."""

from __future__ import annotations


from diegrid.constants import FEATURES
from diegrid.operators import dies as D, features as M
from diegrid.plans.die_queries import moran_sql
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V

_PI = "3.141592653589793"
cte("v_on", f"""
SELECT wafer_id, y, x, fn, s2, sqrt((x - 31.5) * (x - 31.5) + (y - 31.5) * (y - 31.5)) / 32 AS r,
       atan2(CAST(y - 31.5 AS DOUBLE), CAST(x - 31.5 AS DOUBLE)) + {_PI} AS th
FROM v_cells WHERE 2 * wn > s2""")


def _dens(cond: str) -> str:
    return f"coalesce(sum(fn) FILTER ({cond}) / CAST(nullif(max(s2) * count(*) FILTER ({cond}), 0) AS DOUBLE), 0)"


_MID = [_dens(f"r >= 1.0/3 AND r < 2.0/3 AND CAST(floor(th / ({_PI} / 2) + 1e-9) AS INT) % 4 = {k}") for k in range(4)]
_OUT = [_dens(f"r >= 2.0/3 AND CAST(floor(th / ({_PI} / 4) + 1e-9) AS INT) % 8 = {k}") for k in range(8)]
cte("v_fdens", f"""
SELECT wafer_id, count(*) AS area, {_dens('true')} AS fail_frac,
       {', '.join(_dens(f'r >= {i}/8.0 AND r < {i + 1}/8.0') + f' AS radial_{i}' for i in range(8))},
       {_dens('r < 0.3')} - {_dens('r >= 0.3')} AS center_contrast,
       {_dens('r >= 0.3 AND r < 0.75')} - greatest({_dens('r < 0.3')}, {_dens('r >= 0.8')}) AS donut_contrast,
       {_dens('r >= 0.8')} - {_dens('r < 0.8')} AS edge_contrast,
       {_dens('r < 1.0/3')} AS region_center,
       list_sort([{', '.join(_MID)}]) AS mids, list_sort([{', '.join(_OUT)}]) AS outs
FROM v_on GROUP BY 1""")
cte("v_bins", f"""
SELECT wafer_id, CAST(floor(r * 16 + 1e-9) AS INT) AS ri, CAST(least(floor(th / (2 * {_PI}) * 64 + 1e-9), 63) AS INT) AS ti,
       sum(fn) / (max(s2) * count(*)) AS density
FROM v_on WHERE r < 1 GROUP BY 1, 2, 3""")
cte("v_edge", """
SELECT g.wafer_id, g.ti, (coalesce(max(density) FILTER (ri = 12), 0) + coalesce(max(density) FILTER (ri = 13), 0)
       + coalesce(max(density) FILTER (ri = 14), 0) + coalesce(max(density) FILTER (ri = 15), 0)) / 4 AS e
FROM (SELECT wafer_id, unnest(range(64)) AS ti FROM v_fdens) g LEFT JOIN v_bins b ON b.wafer_id = g.wafer_id AND b.ti = g.ti
GROUP BY 1, 2""")
cte("v_fedge", """
SELECT wafer_id, count(*) FILTER (e > greatest(0.3, 2 * fail_frac)) / 64.0 AS edge_coverage, max(m) AS edge_max_sector
FROM v_edge JOIN v_fdens USING (wafer_id)
JOIN (SELECT a.wafer_id, a.ti, sum(b.e) / 8 AS m FROM v_edge a JOIN v_edge b
      ON b.wafer_id = a.wafer_id AND (b.ti - a.ti + 64) % 64 < 8 GROUP BY 1, 2) USING (wafer_id, ti) GROUP BY 1""")
cte("v_bad", "SELECT wafer_id, y AS r, x AS c FROM v_cells WHERE 2 * wn > s2 AND 2 * fn > s2")
# labels of the resampled grid by run merging: reaching pairs of whole 64 x 64 clusters would be too many
cte("v_bruns", """
SELECT wafer_id, r, min(c) AS c0, max(c) AS c1, row_number() OVER (PARTITION BY wafer_id ORDER BY r, min(c)) AS id
FROM (SELECT *, c - row_number() OVER (PARTITION BY wafer_id, r ORDER BY c) AS g FROM v_bad) GROUP BY wafer_id, r, g""")
cte("v_bedges", """
SELECT a.wafer_id, a.id AS a, b.id AS b FROM v_bruns a JOIN v_bruns b
ON a.wafer_id = b.wafer_id AND abs(a.r - b.r) = 1 AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1""")
cte("v_breach", """
SELECT wafer_id, id, id AS root FROM v_bruns
UNION SELECT p.wafer_id, e.b, p.root FROM v_breach p JOIN v_bedges e ON e.wafer_id = p.wafer_id AND e.a = p.id""")
cte("v_badcomp", """
SELECT wafer_id, r, unnest(range(c0, c1 + 1)) AS c, comp
FROM v_bruns JOIN (SELECT wafer_id, id, min(root) AS comp FROM v_breach GROUP BY 1, 2) USING (wafer_id, id)""")
cte("v_bstat", """
SELECT wafer_id, comp, count(*) AS n, sum(r) / count(*) AS mr, sum(c) / count(*) AS mc,
       (count(*) * sum(r * r) - sum(r) * sum(r)) / nullif(count(*) * (count(*) - 1), 0) AS a,
       (count(*) * sum(r * c) - sum(r) * sum(c)) / nullif(count(*) * (count(*) - 1), 0) AS b,
       (count(*) * sum(c * c) - sum(c) * sum(c)) / nullif(count(*) * (count(*) - 1), 0) AS d,
       row_number() OVER (PARTITION BY wafer_id ORDER BY count(*) DESC, comp) AS k
FROM v_badcomp GROUP BY 1, 2""")
cte("v_fclus", """
SELECT wafer_id, coalesce(sum(n) FILTER (n >= greatest(8, 0.004 * area)) / sum(n), 0) AS clustered_frac,
       CAST(count(*) FILTER (n >= greatest(8, 0.004 * area)) AS DOUBLE) AS n_clusters
FROM v_fdens LEFT JOIN v_bstat USING (wafer_id) GROUP BY 1""")
cte("v_fsal", """
SELECT wafer_id, coalesce(n / area, 0) AS salient_area,
       coalesce(sqrt((mc - 31.5) * (mc - 31.5) + (mr - 31.5) * (mr - 31.5)) / 32, 0) AS salient_r,
       CASE WHEN n >= 3 THEN sqrt(((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) + 1e-3)
                                / ((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) + 1e-3)) ELSE 1 END AS salient_elong
FROM v_fdens LEFT JOIN (SELECT * FROM v_bstat WHERE k = 1) USING (wafer_id)""")
# hull width at each row = best interpolation between any two rows; the hull is piecewise linear between rows
cte("v_ends", """
SELECT wafer_id, r, min(c) AS lo, max(c) AS hi FROM v_badcomp JOIN v_bstat USING (wafer_id, comp) WHERE k = 1 AND n >= 3 GROUP BY 1, 2""")
cte("v_hull", """
SELECT p.wafer_id, y.r, max(p.hi + (q.hi - p.hi) * (y.r - p.r) / greatest(q.r - p.r, 1)) AS hi,
       min(p.lo + (q.lo - p.lo) * (y.r - p.r) / greatest(q.r - p.r, 1)) AS lo
FROM v_ends p JOIN v_ends q ON q.wafer_id = p.wafer_id AND q.r >= p.r
JOIN v_ends y ON y.wafer_id = p.wafer_id AND y.r BETWEEN p.r AND q.r GROUP BY 1, 2""")
cte("v_fsol", """
SELECT wafer_id, CASE WHEN n >= 3 THEN n / greatest(coalesce(area_hull, 0), 1) ELSE 1 END AS salient_solidity
FROM v_fdens LEFT JOIN (SELECT wafer_id, n FROM v_bstat WHERE k = 1) USING (wafer_id)
LEFT JOIN (SELECT a.wafer_id, sum((a.hi - a.lo + b.hi - b.lo) / 2.0) AS area_hull
           FROM v_hull a JOIN v_hull b ON b.wafer_id = a.wafer_id AND b.r = a.r + 1 GROUP BY 1) USING (wafer_id)""")
cte("v_rot", """
SELECT angle, y, x, col, sum(w) AS weight FROM (
  SELECT angle, col, CAST(floor(sy) AS INT) + j AS y, CAST(floor(sx) AS INT) + i AS x,
         (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w
  FROM (SELECT angle, col, cos(radians(angle)) * (col - 31.5) - sin(radians(angle)) * (v - 31.5) + 31.5 AS sx,
               sin(radians(angle)) * (col - 31.5) + cos(radians(angle)) * (v - 31.5) + 31.5 AS sy
        FROM (SELECT unnest(range(0, 180, 15)) AS angle), (SELECT unnest(range(64)) AS v), (SELECT unnest(range(64)) AS col)),
       (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
WHERE w > 0 AND y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 GROUP BY 1, 2, 3, 4""")
cte("v_fradon", """
SELECT wafer_id, coalesce(p, 0) AS radon_peak FROM v_fdens LEFT JOIN (
  SELECT wafer_id, max(q) AS p FROM (
    SELECT wafer_id, angle, max(v) / (sum(v) / 64 + 1e-6) AS q FROM (
      SELECT wafer_id, angle, col, sum(fn / s2 * weight) AS v FROM v_on JOIN v_rot USING (y, x) WHERE fn > 0 GROUP BY 1, 2, 3)
    GROUP BY 1, 2) GROUP BY 1) USING (wafer_id)""")
cte("v_fmoran", moran_sql("v_on", "y", "x", "(fn / s2)", "1e-6"))

_DENS = ["fail_frac"] + [f"radial_{i}" for i in range(8)]
_CONTRAST = ["center_contrast", "donut_contrast", "edge_contrast"]
_REGIONS = ["region_center"] + [f"region_mid_{k}" for k in range(4)] + [f"region_out_{k}" for k in range(8)]


def _col(name: str) -> str:
    if name.startswith("region_mid"):
        return f"mids[{int(name[-1]) + 1}]"
    if name.startswith("region_out"):
        return f"outs[{int(name[-1]) + 1}]"
    return name


def _cols(names: list[str]) -> str:
    return ", ".join(f"{R(_col(n))} AS {n}" for n in names)


def cells(spark, sf):
    return D.resample_area(V.dies(spark, sf))


def sums(spark, sf):
    return M.grid_sums(M.on_cells(cells(spark, sf)))


@query("feat_density", f"SELECT wafer_id, {_cols(_DENS)} FROM v_fdens")
def _(spark, sf):
    return D.rounded(M.density_features(sums(spark, sf)).select("wafer_id", *_DENS), *_DENS)


@query("feat_contrast", f"SELECT wafer_id, {_cols(_CONTRAST)} FROM v_fdens")
def _(spark, sf):
    return D.rounded(M.density_features(sums(spark, sf)).select("wafer_id", *_CONTRAST), *_CONTRAST)


@query("feat_regions", f"SELECT wafer_id, {_cols(_REGIONS)} FROM v_fdens")
def _(spark, sf):
    return D.rounded(M.density_features(sums(spark, sf)).select("wafer_id", *_REGIONS), *_REGIONS)


@query("polar_density", f"""
SELECT g.wafer_id, CAST(i AS INT) AS ri, CAST(j AS INT) AS ti, {R('coalesce(density, 0)')} AS density
FROM (SELECT wafer_id, i, unnest(range(64)) AS j FROM (SELECT wafer_id, unnest(range(16)) AS i FROM v_fdens)) g
LEFT JOIN v_bins b ON b.wafer_id = g.wafer_id AND b.ri = i AND b.ti = j""")
def _(spark, sf):
    return D.rounded(M.polar_density(M.on_cells(cells(spark, sf))), "density")


@query("feat_edge", f"SELECT wafer_id, {_cols(['edge_coverage', 'edge_max_sector'])} FROM v_fedge")
def _(spark, sf):
    return D.rounded(M.edge_features(sums(spark, sf)), "edge_coverage", "edge_max_sector")


@query("feat_clusters", f"SELECT wafer_id, {_cols(['clustered_frac', 'n_clusters'])} FROM v_fclus")
def _(spark, sf):
    return D.rounded(M.cluster_features(sums(spark, sf), M.cluster_table(M.outlines(cells(spark, sf)))), "clustered_frac", "n_clusters")


@query("feat_salient", f"SELECT wafer_id, {_cols(['salient_area', 'salient_r', 'salient_elong'])} FROM v_fsal")
def _(spark, sf):
    return D.rounded(M.salient_features(sums(spark, sf), M.cluster_table(M.outlines(cells(spark, sf)))), "salient_area", "salient_r", "salient_elong")


@query("feat_solidity", f"SELECT wafer_id, {_cols(['salient_solidity'])} FROM v_fsol")
def _(spark, sf):
    return D.rounded(M.solidity_feature(sums(spark, sf), M.outlines(cells(spark, sf))), "salient_solidity")


@query("feat_radon", f"SELECT wafer_id, {_cols(['radon_peak'])} FROM v_fradon")
def _(spark, sf):
    return D.rounded(M.radon_feature(sums(spark, sf)), "radon_peak")


@query("feat_moran", f"SELECT wafer_id, {_cols(['moran_i'])} FROM v_fmoran")
def _(spark, sf):
    return D.rounded(M.moran_feature(cells(spark, sf)), "moran_i")


@query("feature_matrix", f"""
SELECT wafer_id, {_cols(FEATURES)} FROM v_fdens JOIN v_fedge USING (wafer_id) JOIN v_fclus USING (wafer_id)
JOIN v_fsal USING (wafer_id) JOIN v_fsol USING (wafer_id) JOIN v_fradon USING (wafer_id) JOIN v_fmoran USING (wafer_id)""")
def _(spark, sf):
    return D.rounded(M.feature_matrix(V.dies(spark, sf)), *FEATURES)
