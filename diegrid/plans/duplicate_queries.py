"""Queries over duplicates, leakage groups and the dataset audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from diegrid.operators import dies as D, duplicates as U
from diegrid.plans.registry import R, cte, query
from diegrid.sources import views as V
from diegrid.sources.tables import stored


def _turn(i: int) -> str:
    return "CASE wafer_id % 8 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(
        ["r", "c", "25 - r", "25 - c", "r", "c", "25 - r", "25 - c"] if i == 0 else ["c", "25 - r", "25 - c", "r", "25 - c", "r", "c", "25 - r"])) + " END"


cte("v_idies", f"""
SELECT wafer_id, r, c, state FROM v_dies
UNION ALL SELECT wafer_id + 1000000, {_turn(0)}, {_turn(1)}, state FROM v_dies
UNION ALL SELECT wafer_id + 2000000, {_turn(0)}, {_turn(1)}, CASE WHEN (r * 31 + c * 17 + wafer_id) % 23 = 0 THEN 3 - state ELSE state END FROM v_dies""")
cte("v_images", """
SELECT w + k * 1000000 AS wafer_id, CASE WHEN k = 0 OR (k = 1 AND w % 2 = 0) THEN 'w' WHEN k = 1 THEN 'x' ELSE 'n' END || w AS source,
       ['Center', 'Donut', 'Edge-Loc', 'Edge-Ring', 'Loc', 'Near-full', 'Random', 'Scratch', 'None']
       [CAST((CASE WHEN k = 2 AND w % 5 = 0 THEN w + 1 ELSE w END) % 9 + 1 AS INT)] AS label,
       CASE WHEN (w + k) % 6 = 0 THEN 'levels' ELSE 'standard' END AS palette
FROM (SELECT DISTINCT wafer_id AS w FROM v_dies), (SELECT unnest(range(3)) AS k)""")
cte("v_iext", """
SELECT wafer_id, min(r) rmin, min(c) cmin, max(r) - min(r) + 1 h, max(c) - min(c) + 1 w, greatest(max(r) - min(r), max(c) - min(c)) + 1 s FROM v_idies GROUP BY 1""")
cte("v_iaxis", """
SELECT s, i, j, least((j + 1) * s, (i + 1) * 64) - greatest(j * s, i * 64) AS o
FROM (SELECT DISTINCT s FROM v_iext), LATERAL (SELECT unnest(range(s)) AS i), (SELECT unnest(range(64)) AS j)
WHERE least((j + 1) * s, (i + 1) * 64) > greatest(j * s, i * 64)""")
cte("v_fp", """
SELECT *, on_ AND NOT fail AS pass FROM (
  SELECT q.wafer_id, a.j // 2 AS y, b.j // 2 AS x, sum(a.o * b.o) > 2 * max(q.s * q.s) AS on_,
         sum(CASE WHEN state = 2 THEN a.o * b.o ELSE 0 END) > 2 * max(q.s * q.s) AS fail
  FROM (SELECT d.wafer_id, r - rmin + (s - h) // 2 AS r, c - cmin + (s - w) // 2 AS c, state, s FROM v_idies d JOIN v_iext USING (wafer_id)) q
  JOIN v_iaxis a ON a.s = q.s AND a.i = q.r JOIN v_iaxis b ON b.s = q.s AND b.i = q.c GROUP BY 1, 2, 3) WHERE on_ OR fail""")
cte("v_sym", "SELECT wafer_id, fail, pass, v, CASE v " + " ".join(f"WHEN {v} THEN {e}" for v, e in enumerate(
    ["y", "x", "31 - y", "31 - x", "y", "x", "31 - y", "31 - x"])) + " END AS y, CASE v " + " ".join(f"WHEN {v} THEN {e}" for v, e in enumerate(
        ["x", "31 - y", "31 - x", "y", "31 - x", "y", "x", "31 - y"])) + " END AS x FROM v_fp, (SELECT unnest(range(8)) AS v)")
# each mask as a 1024-character bit string
cte("v_bits", """
SELECT wafer_id, v, CAST(list_aggregate(list_transform(range(1024), lambda i: CASE WHEN list_contains(f, i) THEN '1' ELSE '0' END), 'string_agg', '') AS BIT) AS fail,
       CAST(list_aggregate(list_transform(range(1024), lambda i: CASE WHEN list_contains(p, i) THEN '1' ELSE '0' END), 'string_agg', '') AS BIT) AS pass,
       len(f) AS nf, len(p) AS np
FROM (SELECT wafer_id, v, coalesce(list(y * 32 + x) FILTER (fail), []) AS f, coalesce(list(y * 32 + x) FILTER (pass), []) AS p FROM v_sym GROUP BY 1, 2)
WHERE len(f) > 0 AND len(p) > 0""")
cte("v_sim", """
SELECT i, j, max(least(bit_count(fa & fb) / CAST(bit_count(fa | fb) AS DOUBLE), bit_count(pa & pb) / CAST(bit_count(pa | pb) AS DOUBLE))) AS sim
FROM (SELECT a.wafer_id AS i, b.wafer_id AS j, a.fail AS fa, a.pass AS pa, b.fail AS fb, b.pass AS pb
      FROM v_bits a JOIN v_bits b ON b.v = 0 AND a.wafer_id < b.wafer_id) GROUP BY 1, 2 HAVING sim >= 0.8""")
cte("v_rep", """
SELECT b.wafer_id, least(b.wafer_id, coalesce(min(s.i), b.wafer_id)) AS rep FROM (SELECT wafer_id FROM v_bits WHERE v = 0) b
LEFT JOIN v_sim s ON s.j = b.wafer_id AND s.sim = 1 GROUP BY 1""")
cte("v_ipairs", """
SELECT s.i, s.j, least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b, sim, x.source AS si, y.source AS sj, x.label AS li, y.label AS lj
FROM v_sim s JOIN v_rep a ON a.wafer_id = i JOIN v_rep b ON b.wafer_id = j JOIN v_images x ON x.wafer_id = i JOIN v_images y ON y.wafer_id = j""")
cte("v_ireach", """
SELECT wafer_id, wafer_id AS root FROM v_images
UNION SELECT e.t, p.root FROM v_ireach p JOIN v_iedge e ON e.f = p.wafer_id""")
cte("v_iedge", """
SELECT i AS f, j AS t FROM v_ipairs UNION SELECT j, i FROM v_ipairs
UNION SELECT a.wafer_id, b.wafer_id FROM v_images a JOIN v_images b ON a.source = b.source AND a.wafer_id <> b.wafer_id""")
cte("v_igrp", """
SELECT wafer_id, dense_rank() OVER (ORDER BY root) - 1 AS grp FROM (SELECT wafer_id, min(root) AS root FROM v_ireach GROUP BY 1)""")


def cells(spark, sf):
    return D.resample_area(V.image_dies(spark, sf))


def duplicates(spark, sf):
    """images, similar orbits and orbit members with their source and label."""
    pairs, members = U.near_duplicates(V.image_dies(spark, sf))
    images = stored(V.images(spark, sf), "images")
    return images, pairs, stored(members.join(images, "wafer_id"), "placed_members")


_WORDS = "CAST(sum(CASE WHEN fail THEN 1::BIGINT << x ELSE 0 END) AS BIGINT) AS fail_word, CAST(sum(CASE WHEN pass THEN 1::BIGINT << x ELSE 0 END) AS BIGINT) AS pass_word"


@query("fingerprint", f"SELECT wafer_id, CAST(y AS INT) AS y, {_WORDS} FROM v_fp GROUP BY 1, 2")
def _(spark, sf):
    return U.fingerprint(cells(spark, sf))


@query("dihedral_variants", f"SELECT wafer_id, CAST(v AS INT) AS v, CAST(y AS INT) AS y, {_WORDS} FROM v_sym GROUP BY 1, 2, 3")
def _(spark, sf):
    return U.dihedral_variants(cells(spark, sf))


@query("near_duplicate_pairs", f"SELECT a, b, {R('max(sim)')} AS sim, count(*) AS pairs FROM v_ipairs GROUP BY 1, 2")
def _(spark, sf):
    return D.rounded(U.near_duplicate_pairs(V.image_dies(spark, sf)), "sim")


@query("cross_source_pairs", f"SELECT a, b, {R('max(sim)')} AS sim, count(*) AS pairs FROM v_ipairs WHERE si <> sj GROUP BY 1, 2")
def _(spark, sf):
    _, pairs, members = duplicates(spark, sf)
    return D.rounded(U.cross_source_pairs(pairs, members), "sim")


@query("leakage_groups", "SELECT wafer_id, grp FROM v_igrp")
def _(spark, sf):
    return U.leakage_groups(*duplicates(spark, sf))


@query("label_conflicts", "SELECT source FROM (SELECT source, count(DISTINCT lang) AS n FROM v_sources GROUP BY 1) WHERE n > 1")
def _(spark, sf):
    from diegrid.functions.labels import source_id
    return U.label_conflicts(V.files(spark, sf).select(source_id(F.col("f")).alias("source"), F.col("lang").alias("label")))


@query("leakage_audit", """
SELECT count(*) AS images, count(DISTINCT source) AS sources, (SELECT count(DISTINCT grp) FROM v_igrp) AS groups,
       (SELECT count(*) FROM v_ipairs WHERE si <> sj) AS pairs, (SELECT count(*) FROM v_ipairs WHERE si <> sj AND li <> lj) AS pairs_differing_labels
FROM v_images""")
def _(spark, sf):
    images, pairs, members = duplicates(spark, sf)
    return U.leakage_audit(images, U.leakage_groups(images, pairs, members), pairs, members)


@query("audit_per_class", """
SELECT label, count(*) AS images, count(DISTINCT grp) AS independent_wafers,
       count(*) FILTER (wafer_id IN (SELECT i FROM v_ipairs WHERE si <> sj UNION SELECT j FROM v_ipairs WHERE si <> sj)) AS images_with_renamed_copy,
       count(*) FILTER (palette <> 'standard') AS nonstandard_palette
FROM v_images JOIN v_igrp USING (wafer_id) GROUP BY 1""")
def _(spark, sf):
    images, pairs, members = duplicates(spark, sf)
    return U.audit_per_class(images, U.leakage_groups(images, pairs, members), pairs, members)


@query("grid_shapes", "SELECT h || 'x' || w AS shape, count(*) AS n FROM v_ext GROUP BY 1")
def _(spark, sf):
    return U.grid_shapes(D.native_crop(V.dies(spark, sf)).select("wafer_id", "height", "width").distinct())
