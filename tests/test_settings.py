"""Settings of the root-cause analysis, knowledge bases from files, saved policies."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from diegrid.operators import policy as P, rootcause as C
from diegrid.sources.tables import shared_path


def log(spark, names=("class", "seq")):
    random = np.random.default_rng(1)
    rows = []
    for i in range(400):
        kind = "Scratch" if i % 5 == 0 else "Loc" if i % 41 == 0 else "clean"
        rows.append((kind, i, f"W{i}", "AB"[i % 2], float(random.normal() + 3 * (kind == "Scratch")), float(random.normal()), i % 13))
    return spark.createDataFrame(rows, f"{names[0]} string, {names[1]} int, wafer_id string, tool string, pad double, other double, note int")


def test_settings(spark):
    s = C.Settings(baseline="clean", min_count=20)
    counts = {r["class"]: r["analysed"] for r in C.class_counts(log(spark), s).collect()}
    assert counts == {"Scratch": True, "Loc": False, "clean": False}
    loose = C.parameter_effects(log(spark), ["pad", "other"], ["Scratch"], C.Settings(baseline="clean", alpha=1.1))
    strict = C.parameter_effects(log(spark), ["pad", "other"], ["Scratch"], C.Settings(baseline="clean", alpha=1e-9))
    assert [r["significant"] for r in loose.collect()] == [True, True]
    assert {r["param"] for r in strict.where("significant").collect()} == {"pad"}


def test_report_with_settings(spark):
    kb = C.kb_tables(spark, [("wear", "Pad wear", ["pad"], []), ("tool", "Tool", [], ["tool"])], [("Scratch", "wear", 0.5), ("Scratch", "tool", 0.5)])
    s = C.Settings(class_col="found", seq_col="n", baseline="clean", min_count=20, params=("pad",), factors=("tool",))
    found = C.rootcause_report(log(spark, ("found", "n")), kb, n_perm=20, s=s).collect()
    docs = {}
    for r in found:
        docs.setdefault(r["section"], {})[r["item"]] = json.loads(r["document"])
    assert docs["wafers"][""] == {"wafers": 400, "clean": 312, "defective": 88, "analysed": 80}
    assert set(docs["parameter_effects"]) == {"Scratch/pad"} and len(docs["level_rates"]) == 2
    assert docs["posteriors"]["Scratch/wear"]["posterior"] > 0.9 and docs["pareto"]["wear"]["rank"] == 1
    rates = docs["level_rates"]["tool/A/Scratch"]
    assert rates["n"] == 200 and rates["k"] == 40 and rates["rate"] == 0.2
    flat = C.rootcause_report(log(spark, ("found", "n")), kb, n_perm=20, s=C.Settings(class_col="found", seq_col="n", baseline="clean", min_count=20, params=("pad",), factors=("tool",), beta=0.0))
    posterior = {r["item"]: json.loads(r["document"])["posterior"] for r in flat.where("section = 'posteriors'").collect()}
    assert posterior == {"Scratch/wear": 0.5, "Scratch/tool": 0.5}


def test_knowledge_base_files(spark, tmp_path):
    kb = C.kb_tables(spark)
    path = shared_path(spark, "kb")
    C.write_knowledge_base(kb, path)
    back = C.read_knowledge_base(spark, path)
    for a, b in zip(kb, back):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    mine = tmp_path / "kb.json"
    mine.write_text(json.dumps({"causes": {"dust": {"label": "Dust"}}, "priors": {"Loc": {"dust": 1.0}}}, indent=2))
    causes, priors = C.read_knowledge_base(spark, str(mine))
    assert [tuple(r) for r in causes.collect()] == [("dust", "Dust", [], [])] and [tuple(r) for r in priors.collect()] == [("Loc", "dust", 1.0)]
    mine.write_text(json.dumps({"causes": {"dust": {"label": "Dust"}}, "priors": {"Loc": {"wind": 1.0}}}))
    with pytest.raises(ValueError, match="wind"):
        C.read_knowledge_base(spark, str(mine))
    mine.write_text("{}")
    with pytest.raises(ValueError, match="no causes"):
        C.read_knowledge_base(spark, str(mine))


def test_saved_policy(spark):
    rules = spark.createDataFrame([("Loc", "a", 0.0, 1.0), ("Loc", "b", 5.0, 6.0)], "cls string, feature string, lo double, hi double")
    limits = spark.createDataFrame([(0.99, 0.8)], "target double, threshold double")
    path = shared_path(spark, "policy")
    P.write_policy(path, rules=rules, thresholds=limits)
    saved = P.read_policy(spark, path, "rules", "thresholds")
    assert saved["thresholds"].first().threshold == 0.8
    with pytest.raises(Exception):
        P.read_policy(spark, path, "temperatures")
    rows = spark.createDataFrame([(1, "Loc", {"a": 1.04, "b": 7.0}), (2, "Loc", {"a": 0.5}), (3, "Donut", {"a": 0.5})], "id int, top string, features map<string, double>")
    checks = {r.id: [tuple(c) for c in r.checks] for r in P.verification_checks(rows, saved["rules"], "top").collect()}
    assert checks == {1: [("a", 1.04, 0.0, 1.0, True), ("b", 7.0, 5.0, 6.0, False)], 2: [("a", 0.5, 0.0, 1.0, True), ("b", None, 5.0, 6.0, False)], 3: []}
    status = {r.id: r.status for r in P.verify(rows, saved["rules"], "top").collect()}
    assert status == {1: "WARN", 2: "WARN", 3: "PASS"}


def test_thresholds_without_own_fold(spark):
    """All minus own fold gives what a copy of the rows for every fold gives, with ties and folds of one class."""
    random = np.random.default_rng(3)
    rows = [(i, i % 3 if i % 7 else 0, float(random.integers(0, 12)) / 11, bool(random.random() < 0.8), bool(i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id int, fold int, conf double, correct boolean, eligible boolean")
    for targets in ([0.8, 0.9, 1.0], [0.0]):
        copied = P.pick_thresholds(P.for_training(df.where("eligible"), 3).select("held", "conf", "correct"), targets, ["held"])
        want = sorted((r.held, r.target, r.threshold, r.coverage, r.accuracy) for r in copied.collect())
        got = sorted((r.held, r.target, r.threshold, r.coverage, r.accuracy) for r in P.crossfit_thresholds(df, targets, 3).collect())
        assert got == want
    assert {r.threshold for r in P.crossfit_thresholds(df.where(F.lit(False)), [0.9], 3).collect()} <= {1.01}
