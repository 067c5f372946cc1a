"""Closed-form answers and brute force on tiny tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diegrid.constants import CLASSES
from diegrid.functions import arrays as A, labels as L, numeric as N, prefix
from diegrid.operators import components, dies as D, duplicates as U, features as M, metrics as E, policy as P, quantify as Q, rootcause as C, splits as S
from diegrid.sources import validation


def block_wafer(spark):
    rows = []
    for r in range(21):
        for c in range(21):
            if math.hypot(r - 10, c - 10) <= 10:
                bad = (4 <= r <= 6 and 12 <= c <= 14) or (r, c) in ((15, 3), (10, 18))
                rows.append((1, r, c, 2 if bad else 1))
    return spark.createDataFrame(rows, "wafer_id bigint, r int, c int, state int")


def test_block_wafer_geometry(spark):
    dies = block_wafer(spark)
    cls = spark.createDataFrame([(1, "Loc")], "wafer_id bigint, cls string")
    s = Q.wafer_summary(dies).first()
    assert (s.dies_total, s.dies_failed) == (317, 11)
    pattern = Q.segment_pattern(dies, cls)
    geo = dict(die_w=10.0, die_h=10.0)
    a = Q.pattern_area(dies, pattern, **geo).first()
    assert (a.dies, a.background_fail_dies, a.area_mm2) == (9, 2, 900.0)
    assert abs(a.affected_pct + a.clean_pct - 100) < 1e-9 and a.wilson_lo < a.affected_pct < a.wilson_hi
    c = Q.pattern_centroid(dies, pattern, **geo).first()
    assert (c.row_mean, c.col_mean, c.x_mm, c.y_mm) == (5.0, 13.0, 30.0, 50.0)
    p = Q.region_polygons(dies, pattern, **geo).collect()
    assert sorted((v.x_mm, v.y_mm) for v in p) == [(15.0, 35.0), (15.0, 65.0), (45.0, 35.0), (45.0, 65.0)]


@pytest.mark.parametrize("cls,expected", [("Random", 11), ("None", 0)])
def test_whole_wafer_and_baseline_classes(spark, cls, expected):
    k = spark.createDataFrame([(1, cls)], "wafer_id bigint, cls string")
    assert Q.segment_pattern(block_wafer(spark), k).count() == expected


def test_wilson(spark):
    df = spark.createDataFrame([(10, 100), (0, 0)], "k int, n int")
    lo, hi = N.wilson(F.col("k"), F.col("n"))
    a, b = df.select(lo, hi).collect()
    assert abs(a[0] - 0.0552) < 1e-3 and abs(a[1] - 0.1744) < 1e-3 and tuple(b) == (0.0, 0.0)


def test_tail_probabilities(spark):
    cases = [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (11.070498, 5)]
    df = spark.createDataFrame(cases, "x double, k int")
    for r in df.select(N.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect():
        assert abs(r.p - 0.05) < 1e-6
    t = spark.createDataFrame([(12.706205, 1), (4.302653, 2), (3.182446, 3), (2.776445, 4), (2.228139, 10), (2.042272, 30)], "t double, k int")
    for r in t.select(N.student_two_sided(F.col("t"), F.col("k")).alias("p")).collect():
        assert abs(r.p - 0.05) < 1e-6


def test_student_at_all_sizes(spark):
    """Against the finite trigonometric sum for whole degrees of freedom, on both sides of 1,000, and the normal limit."""
    def exact(t, k):
        th = math.atan(t / math.sqrt(k))
        c, s = math.cos(th), math.sin(th)
        if k % 2:
            term, total = c, c if k > 1 else 0.0
            for j in range(1, (k - 3) // 2 + 1):
                term *= c * c * 2 * j / (2 * j + 1)
                total += term
            return 1 - 2 / math.pi * (th + s * total)
        term, total = 1.0, 1.0
        for j in range(1, (k - 2) // 2 + 1):
            term *= c * c * (2 * j - 1) / (2 * j)
            total += term
        return 1 - s * total

    ts = [0.0, 1e-6, 0.3, 1.0, 1.6, 1.74, 2.0, 3.5, 6.0]
    cases = [(t, k, exact(t, k)) for t in ts for k in (1, 2, 3, 4, 7, 30, 999, 1000, 1001, 1002, 20_001)]
    cases += [(t, k, math.erfc(t / math.sqrt(2))) for t in ts for k in (10 ** 9, 10 ** 12)]
    df = spark.createDataFrame(cases, "t double, k long, want double")
    for sign in (1, -1):
        for r in df.select("t", "k", "want", N.student_two_sided(F.col("t") * sign, F.col("k")).alias("p")).collect():
            assert abs(r.p - r.want) < 1e-8, r
    assert df.limit(1).select(N.student_two_sided(F.lit(1.0), F.lit(0)).alias("p")).first().p is None


@pytest.mark.parametrize("connectivity", [4, 8])
def test_label_cells_matches_flood_fill(spark, connectivity):
    rnd = random.Random(1)
    cells = {g: {(r, c) for r in range(40) for c in range(40) if rnd.random() < 0.45} for g in range(12)}
    df = spark.createDataFrame([(g, r, c) for g, s in cells.items() for r, c in s], "wafer_id bigint, r int, c int")
    got = {(x.wafer_id, x.r, x.c): x.comp for x in components.label_cells(df, ["wafer_id"], connectivity).collect()}
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    for g, s in cells.items():
        left = set(s)
        while left:
            stack, comp = [min(left)], set()
            while stack:
                p = stack.pop()
                if p in left:
                    left.discard(p)
                    comp.add(p)
                    stack += [(p[0] + a, p[1] + b) for a, b in near]
            code = min(comp)[0] * D.STRIDE + min(comp)[1]
            assert all(got[(g, *p)] == code for p in comp)


def test_connected_nodes_with_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5001)]
    got = {r.node: r.root for r in components.connected_nodes(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(200)} == {0} and {got[1000 + i] for i in range(301)} == {1000} and got[5001] == 5000


def test_prefix_functions_under_skew(spark):
    rnd = random.Random(2)
    rows = [("a" if i % 3 else f"k{i % 5}", i, rnd.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    run = {(r.k, r.o): (r.run_v, r.all_v) for r in prefix.running_totals(df, ["k"], "o", ["v"], buckets=7).collect()}
    num = {(r.k, r.o): r.rn for r in prefix.global_row_number(df, ["k"], "o", "v", buckets=7).collect()}
    lag = {(r.k, r.o): (r.p, r.p_exists) for r in prefix.global_lag(df, ["k"], "o", "v", "p", buckets=7).collect()}
    total, count, last = {}, {}, {}
    sums = {}
    for k, _o, v in rows:
        sums[k] = sums.get(k, 0) + v
    for k, o, v in rows:
        total[k], count[k] = total.get(k, 0) + v, count.get(k, 0) + 1
        assert run[(k, o)] == (total[k], sums[k]) and num[(k, o)] == count[k]
        assert lag[(k, o)] == (last.get(k), k in last)
        last[k] = v
    q = {r.k: (r.q0, r.q1) for r in prefix.exact_quantiles(df, ["k"], "v", [0.1, 0.5], buckets=5).collect()}
    for k in sums:
        want = np.percentile([v for kk, _o, v in rows if kk == k], [10, 50])
        assert np.allclose(q[k], want)
    ids = {r.k: r.id for r in prefix.dense_ids(df, "k").collect()}
    assert ids == {k: i for i, k in enumerate(sorted(sums))}


def test_labels(spark):
    names = [("Local", "Loc"), ("none", "None"), ("near full", "Near-full"), ("martian", None)]
    df = spark.createDataFrame(names, "raw string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", L.canonical_label(F.col("raw"))).collect())
    with pytest.raises(Exception, match="unknown wafer class label"):
        df.select(L.canonical_label(F.col("raw"), strict=True)).collect()
    files = [("image_ER_26289_png_jpg.rf.0e198527160046f21209a5afd7513fc5.jpg", "image_ER_26289"),
             ("811KNF_73_png_jpg.rf.0ee923ddbcc23c539c28ccd55757003a.jpg", "811KNF_73"), ("plain.png", "plain")]
    assert all(r.got == r.want for r in spark.createDataFrame(files, "f string, want string").withColumn("got", L.source_id(F.col("f"))).collect())


def test_invalid_maps(spark):
    maps = [([], "empty"), ([[1, 1], [1]], "not rectangular"), ([[0, 3]], "bad value"), ([[0, 0]], "no dies"), ([[1]] * 513, "too large"), ([[0, 1], [2, 1]], None)]
    df = spark.createDataFrame(maps, "wafer_map array<array<int>>, want string")
    assert all(r.reason == r.want for r in validation.validate_wafers(df).collect())


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    base = {i: {(y, x): (rnd.random() < d) for y in range(64) for x in range(64) if (y - 31.5) ** 2 + (x - 31.5) ** 2 < 1000}
            for i, d in enumerate([0.03, 0.1, 0.3, 0.6, 0.05, 0.05])}
    grids = {i: {(y // 2 * 2 + a, x // 2 * 2 + b): base[i].get((y // 2 * 2, x // 2 * 2), False) for y, x in g for a in (0, 1) for b in (0, 1)} for i, g in base.items()}
    grids[10] = {(63 - x, y): v for (y, x), v in grids[0].items()}                              # turned copy
    keys = sorted({(y // 2, x // 2) for y, x in grids[2]})
    flip = set(rnd.sample(keys, 12))
    grids[11] = {(y, 63 - x): v != ((y // 2, x // 2) in flip) for (y, x), v in grids[2].items()}  # mirrored copy with changes
    rows = [(i, y, x, 1, int(v), 1) for i, g in grids.items() for (y, x), v in g.items()]
    cells = spark.createDataFrame(rows, "wafer_id bigint, y int, x int, wn bigint, fn bigint, s2 bigint")

    def sets(g):
        f = {(y, x) for y in range(32) for x in range(32) if g.get((2 * y, 2 * x))}
        return f, {(y, x) for y in range(32) for x in range(32) if (2 * y, 2 * x) in g} - f

    def images(s):
        out = []
        for _ in range(4):
            s = {(x, 31 - y) for y, x in s}
            out += [s, {(y, 31 - x) for y, x in s}]
        return out

    def iou(a, b):
        return len(a & b) / max(len(a | b), 1)

    want = set()
    ids = sorted(grids)
    for n, i in enumerate(ids):
        fi, pi = sets(grids[i])
        for j in ids[n + 1:]:
            fj, pj = sets(grids[j])
            if max(min(iou(a, fj), iou(b, pj)) for a, b in zip(images(fi), images(pi))) >= 0.8:
                want.add((i, j))
    assert (0, 10) in want and (2, 11) in want
    pairs, members = U.near_duplicates(cells)
    rep = {r.wafer_id: r.rep for r in members.collect()}
    similar = {(r.a, r.b) for r in pairs.collect()}
    got = {(i, j) for n, i in enumerate(ids) for j in ids[n + 1:] if rep[i] == rep[j] or tuple(sorted((rep[i], rep[j]))) in similar}
    assert got == want


def predictions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(y), int(y), 0.92, [0.92 if k == y else 0.01 for k in range(9)], i // 3, i // 3 % 5) for i, y in enumerate(rng.integers(0, 9, 900))]
    return spark.createDataFrame(rows, "vec_id bigint, y int, pred int, conf double, p array<double>, grp bigint, fold int")


def test_perfect_predictions(spark):
    p = predictions(spark)
    a, k = E.accuracy_suite(p).first(), E.kappa_mcc(E.confusion_counts(p)).first()
    assert (a.accuracy, a.top2_accuracy, k.kappa, k.mcc) == (1.0, 1.0, 1.0, 1.0)
    assert abs(E.ece(p).first().ece - 0.08) < 1e-9
    assert {(r.lo, r.hi) for r in E.group_bootstrap_ci(p, 50).collect()} == {(1.0, 1.0)}
    assert all(0.01 < r.threshold <= 0.92 for r in E.youden_thresholds(p).collect())
    assert all(r.auc == 1.0 for r in E.auc_ovr(p).collect())


def test_youden_separates(spark):
    s = np.r_[np.linspace(0, 0.4, 50), np.linspace(0.6, 1, 50)]
    rows = [(int(i >= 50), [1 - v, float(v)]) for i, v in enumerate(s.tolist())]
    t = {r.k: r.threshold for r in E.youden_thresholds(spark.createDataFrame(rows, "y int, p array<double>")).collect()}
    assert 0.4 < t[1] <= 0.6


def test_temperature_is_recovered(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1.5, (4000, 9))
    e = np.exp(z / 0.4 - (z / 0.4).max(1, keepdims=True))
    y = [int(rng.choice(9, p=p)) for p in e / e.sum(1, keepdims=True)]
    df = spark.createDataFrame(list(zip(z.tolist(), y)), "z array<double>, y int")
    assert abs(P.fit_temperature(df).first().temperature - 0.4) < 0.05


def test_verify_and_threshold(spark):
    rules = spark.createDataFrame([("Edge-Ring", "edge_coverage", 0.35, 1.0), ("Edge-Ring", "edge_contrast", 0.1, 0.9)], "cls string, feature string, lo double, hi double")
    rows = spark.createDataFrame([(1, "Edge-Ring", {"edge_coverage": 0.6, "edge_contrast": 0.3}), (2, "Edge-Ring", {"edge_coverage": 0.05, "edge_contrast": -0.1}),
                                  (3, "Loc", {"edge_coverage": 0.0})], "id int, top string, features map<string,double>")
    got = {r.id: (r.status, len(r.reasons)) for r in P.verify(rows, rules, "top").collect()}
    assert got == {1: ("PASS", 0), 2: ("FAIL", 2), 3: ("PASS", 0)}
    conf = [(i / 999, i / 999 > 0.3) for i in range(1000)]
    t = P.pick_thresholds(spark.createDataFrame(conf, "conf double, correct boolean"), [0.995]).first()
    assert t.accuracy >= 0.995 and 0.25 < t.threshold < 0.35 and t.coverage > 0.65


def test_dirichlet_and_weights(spark):
    p, u = A.dirichlet(F.array(F.lit(10.0), *[F.lit(-10.0)] * 8))
    r = spark.range(1).select(p.alias("p"), u.alias("u")).first()
    assert r.p[0] > 0.5 and r.u < 0.9
    w = {x.y: x.weight for x in S.class_weights(spark.createDataFrame([(0, 147000), (1, 149), (2, 5000)], "y int, n bigint")).collect()}
    assert w[1] > w[2] > w[0] and abs(sum(w.values()) - 3) < 1e-9


def test_features_of_a_disc(spark):
    rows = [(1, y, x, 1, int((y - 31.5) ** 2 + (x - 31.5) ** 2 < 64), 1) for y in range(64) for x in range(64) if (y - 31.5) ** 2 + (x - 31.5) ** 2 < 1024]
    f = M.feature_matrix(spark.createDataFrame(rows, "wafer_id bigint, y int, x int, wn bigint, fn bigint, s2 bigint")).first()
    assert f.n_clusters == 1 and f.clustered_frac == 1 and f.salient_r == 0 and abs(f.salient_elong - 1) < 1e-9
    assert f.radial_0 == 1 and f.center_contrast > 0.5 and f.edge_coverage == 0 and 0.9 < f.salient_solidity < 1.3


def fab_log(spark, planted: bool):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        chamber, etch, pad = "ABC"[rng.integers(3)], float(rng.normal(62, 1)), int(rng.integers(0, 800))
        cls = "None"
        if planted and chamber == "B" and i > 600 and rng.random() < 0.4:
            cls, etch = "Edge-Ring", etch + 4
        elif planted and pad > 600 and rng.random() < 0.5:
            cls = "Scratch"
        elif rng.random() < (0.02 if planted else 0.1):
            cls = "Loc"
        rows.append((f"w{i}", i, chamber, etch, pad, cls))
    return spark.createDataFrame(rows, "wafer_id string, seq bigint, chamber string, etch_time_s double, cmp_pad_cycles int, class string")


def test_planted_causes_rank_first(spark):
    log, kb = fab_log(spark, True), C.kb_tables(spark)
    roles, classes = C.infer_roles(log), C.analysed_classes(log)
    assert roles == C.Roles(["chamber"], ["etch_time_s", "cmp_pad_cycles"])
    effects, equipment = C.parameter_effects(log, roles.params, classes), C.equipment_effects(log, roles.factors, classes)
    post = C.cause_posterior(C.evidence(effects, equipment, kb), C.class_counts(log)).collect()
    top = {c: max((r for r in post if r["class"] == c), key=lambda r: r.posterior).cause for c in ("Edge-Ring", "Scratch")}
    assert top == {"Edge-Ring": "etch_edge_nonuniformity", "Scratch": "cmp_pad_wear"}
    assert ("Edge-Ring", "B") in {(r["class"], r.worst_level) for r in equipment.where("significant").collect()}
    drift = C.drift(log, roles.factors, classes, 100).collect()
    assert any(r["class"] == "Edge-Ring" and r.scope == "chamber=B" and 500 < r.onset_seq < 700 for r in drift)
    counters = C.consumables(log, roles.params, classes).where("reported AND class = 'Scratch'").collect()
    assert len(counters) == 4
    assert {r.section for r in C.rootcause_report(log, kb, 300).collect()} >= {"pareto", "drift", "equipment_effects", "parameter_effects"}


def test_stationary_log_shows_nothing(spark):
    log = fab_log(spark, False)
    assert C.equipment_effects(log, ["chamber"], ["Loc"]).where("significant").count() == 0
    assert C.drift(log, ["chamber"], ["Loc"], 100).count() == 0


def test_small_untied_samples_use_the_exact_law(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.5], [5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    log = spark.createDataFrame([("Loc", v) for v in a] + [("None", v) for v in b], "class string, x double")
    # U = 1 of 30; P(U <= 1) = 2 of C(11, 5) arrangements
    assert abs(C.mann_whitney(log, ["x"], ["Loc"]).first().p - 2 * 2 / math.comb(11, 5)) < 1e-12


def test_exact_law_holds_for_any_baseline(spark):
    for a, b in ((5, 6), (3, 9), (8, 8), (6, 40)):
        ways = np.array([1], object)                     # orders by U: one value of the small side after another
        table = [[ways] * (b + 1) for _ in range(a + 1)]
        for i in range(1, a + 1):
            for j in range(1, b + 1):
                w = np.zeros(i * j + 1, object)
                w[j:] += table[i - 1][j]
                w[:i * (j - 1) + 1] += table[i][j - 1]
                table[i][j] = w
        total = np.cumsum(table[a][b])
        assert [C._u_at_most(m, a, b) for m in range(a * b + 1)] == list(total)
    # 5 against 2001 untied values, all of the class above the baseline: p = 2 / C(2006, 5)
    log = spark.createDataFrame([("Loc", 5000.0 + i) for i in range(5)] + [("None", float(i)) for i in range(2001)], "class string, x double")
    assert abs(C.mann_whitney(log, ["x"], ["Loc"]).first().p * math.comb(2006, 5) / 2 - 1) < 1e-12
    assert abs(2 * C._u_at_most(1121, 5, 2001) / math.comb(2006, 5) - 0.00095) < 1e-5
    assert 0 < C._u_at_most(4 * 10**9, 8, 10**9) / math.comb(10**9 + 8, 8) - 0.5 < 1e-8


def test_null_statistics_match_a_full_scan(spark):
    """Every admissible split of the drawn places; arrays and blocks of rows agree; events rare, common, at half."""
    def ll(x, m):
        return sum(s * v * math.log(v) for s, v in ((1, x), (1, m - x), (-1, m)) if v > 0)

    sizes = [(200, 20), (500, 7), (300, 290), (400, 200), (120, 60), (5000, 1), (5000, 2400)]
    df = spark.createDataFrame(sizes, "n long, k long")
    fast = {(r.n, r.k, r.rep): r.null for r in C.null_statistics(df, 5, seed=3).collect()}
    rows = {(r.n, r.k, r.rep): r.null for r in C.null_statistics(df, 5, seed=3, long=0, width=64).collect()}
    assert len(fast) == 5 * len(sizes) and fast == rows
    for n, k in sizes:
        m = min(k, n - k)
        draws = int(m + m * m * 4 / (n * 5) + m / 16 + 64)
        for rep in range(1, 6):
            seen = []
            for j in range(draws):
                h = int(C._mixed(C._mixed(np.array([j]), rep + 3), 2 * n + 1)[0])
                pos = (h * 2147483647 + int(C._mixed(np.array([h]), 3 * n + 2)[0])) % n
                if pos not in seen:
                    seen.append(pos)
            assert len(seen) >= m
            events = set(seen[:m]) if k == m else set(range(n)) - set(seen[:m])
            best, k1 = 0.0, len([p for p in events if p < 29])
            for n1 in range(30, n - 30 + 1):
                k1 += n1 - 1 in events
                if (k - k1) * n1 > k1 * (n - n1):
                    best = max(best, ll(k1, n1) + ll(k - k1, n - n1) - ll(k, n))
            assert abs(best - fast[n, k, rep]) < 2e-9
    for n in (400, 1000, 4096, 10_007):                  # draws are even over places and replicates
        high = np.concatenate([C._mixed(C._mixed(np.arange(20 * n), rep), 2 * n + 1) for rep in range(5)])
        count = np.bincount((high * 2147483647 + C._mixed(high, 3 * n + 2)) % n, minlength=n)
        assert abs(((count - 100) ** 2 / 100).sum() / n - 1) < 0.25
    x = [0, 1, 77, 2 ** 31, 2 ** 45 + 12345, -3]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x long").select(N.mix(F.col("x"), 41)).collect()]
    assert C._mixed(np.array(x), 41).tolist() == want


def test_folds_never_split_a_group(spark):
    df = spark.createDataFrame([(i, i % 7, i // 4) for i in range(2000)], "vec_id bigint, y int, grp bigint")
    folds = S.group_kfold(df, 5)
    assigned = df.join(folds, "grp")
    assert S.fold_leak_check(assigned).count() == 0
    sizes = [r["count"] for r in assigned.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 40


def test_class_order():
    assert CLASSES.index("None") == 8 and len(CLASSES) == 9


def test_null_rows_and_cells_are_invalid(spark):
    from diegrid.sources.validation import validate_wafers
    maps = [[[1, None], [1, 2]], [None, [1, 2]], [[1, 2], None], [[1, 2], [1, 1]]]
    got = validate_wafers(spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, wafer_map array<array<tinyint>>")).sort("i").collect()
    assert [r["reason"] for r in got] == ["bad value", "not rectangular", "not rectangular", None]


def test_missing_feature_does_not_pass(spark):
    from diegrid.operators.policy import verify
    rules = spark.createDataFrame([("Scratch", "a", 0.0, 1.0), ("Scratch", "b", 0.0, 1.0)], "cls string, feature string, lo double, hi double")
    rows = spark.createDataFrame([(1, "Scratch", {}), (2, "Scratch", {"a": 0.5, "b": float("nan")}), (3, "Scratch", {"a": 0.5, "b": 0.5})], "i int, cls string, features map<string,double>")
    got = {r["i"]: r for r in verify(rows, rules, "cls").collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["FAIL", "WARN", "PASS"] and "missing" in got[1]["reasons"][0]


def test_hash_of_any_id(spark):
    from diegrid.functions.numeric import mix
    ids = [0, 1, 4_000_000_000, 2**62, -5, -2**63]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x bigint").select(mix(F.col("x"), 3)).collect()]
    assert all(0 <= h < 2147483647 for h in got) and len(set(got)) == len(ids)
