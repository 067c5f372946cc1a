"""Fusion of evidence for languages, held against a plain row-by-row computation of Bayes' rule."""

import math
import time

import numpy as np
import pyarrow as pa

from diegrid.llm import language


def softmax(logs):
    e = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(e) for x in e]


def brute(rows, n):
    """Posteriors of rows (host, declared, suffix, evidence), every sum taken anew over all other rows."""
    alone = [softmax([*r[3][:-1], r[3][-1] + math.log(language.UND_PRIOR)]) for r in rows]
    whole = [sum(a[c] for a in alone) for c in range(n)]
    total = sum(whole) + 1
    domain = [None if r[0] is None else ".".join(r[0].split(".")[-2:]) for r in rows]
    columns = {"host": [r[0] for r in rows], "domain": domain, "declared": [r[1] for r in rows], "suffix": [r[2] for r in rows]}
    out = []
    for i, r in enumerate(rows):
        own, count = {}, {}
        for key, values in columns.items():
            others = [alone[j] for j in range(len(rows)) if j != i and values[i] is not None and values[j] == values[i]]
            own[key], count[key] = [sum(a[c] for a in others) for c in range(n)], len(others)
        logs = []
        for c in range(n):
            everywhere = (whole[c] + 1 / n) / total
            by_domain = (own["domain"][c] + 10 * everywhere) / (count["domain"] + 10)
            log = r[3][c] + math.log((own["host"][c] + 10 * by_domain) / (count["host"] + 10))
            for key in ("declared", "suffix"):
                share = (count[key] + 5) / (total + 5)
                if columns[key][i] is not None:
                    log += math.log((own[key][c] + 5 * share) / (whole[c] + 5) / share)
            logs.append(log)
        out.append(softmax(logs))
    return out


def test_posteriors(spark):
    random, labels = np.random.default_rng(8), ["de", "en", "fr"]
    model = language.TextModel(labels, np.ones((3, language.BUCKETS)))
    pick = lambda xs: xs[random.integers(0, len(xs))]
    rows = [(pick(["a.x.fr", "b.x.fr", "x.fr", "c.org", "plain", "", None]), pick(["de", "en", "tlh", None]), pick(["fr", "org", None]), [float(x) for x in random.normal(0, 3, 4)]) for _ in range(120)]
    rows += [("a.x.fr", "en", "fr", [0.0, 0.0, 0.0, 0.0])] * 30 + [(None, None, None, [-900.0, 0.0, 5.0, -2000.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, host string, declared string, suffix string, evidence array<double>").repartition(5)
    got = {r["i"]: r["posterior"] for r in language.Priors(df, model).fused(df).collect()}
    assert len(got) == len(rows) and np.allclose([got[i] for i in range(len(rows))], brute(rows, 4), rtol=1e-6, atol=1e-12)
    empty = df.where("i < 0")
    assert language.Priors(empty, model).fused(empty).count() == 0


def test_text_scored_in_the_same_batch(spark):
    """Evidence from the text of the batch and evidence of an earlier pass give the same posteriors; other columns pass."""
    random = np.random.default_rng(2)
    model = language.TextModel(["en", "fr"], random.integers(0, 50, (2, language.BUCKETS)).astype(float))
    rows = [(i, {"a b": i}, "".join(map(chr, random.integers(97, 123, int(random.integers(0, 90))))), "a.b.c" if i % 3 else None, None if i % 2 else "en", "c") for i in range(60)] + [(60, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i long, doc struct<`a b`:long>, text string, host string, declared string, suffix string").repartition(3)
    evidence = language.scored(df, model)
    priors = language.Priors(evidence, model)
    want = {r["i"]: (r["doc"], r["n_trigrams"], r["posterior"]) for r in priors.fused(evidence).collect()}
    got = {r["i"]: (r["doc"], r["n_trigrams"], r["posterior"]) for r in priors.fused(df, from_text=True).collect()}
    assert got == want and len(got) == 61


def test_many_labels():
    """Ten times the labels take about ten times the time of a batch, not the square of it."""
    random, seconds = np.random.default_rng(1), {}
    texts = pa.array(["".join(map(chr, random.integers(97, 123, 400))) for _ in range(2_000)])
    for n in (4, 40):
        model = language.TextModel([f"l{i:02}" for i in range(n)], np.ones((n, language.BUCKETS)))
        sums = {k: random.random((len(texts), n + 1)) * 50 for k in language.KEYS}
        given = {k: random.random(len(texts)) < 0.5 for k in ("declared", "suffix")}
        start = time.perf_counter()
        evidence, _ = model.evidence(texts)
        posterior = language.fuse(evidence, sums, given, sums["host"].sum(axis=0))
        seconds[n] = time.perf_counter() - start
        assert np.allclose(posterior.sum(axis=1), 1)
    assert seconds[40] < 20 * seconds[4]


def test_one_python_worker_a_task(spark):
    """Texts are scored and summed by one Python operator, not by two in a row; the text goes to it once."""
    rows = [(i, None if i % 9 == 4 else ["the cat and the dog", "le chat et le chien"][i % 2] * (i % 5), ["en", "fr"][i % 2], ["a.x.fr", "b.org", None][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    model = language.fit(docs.select(docs["lang"].alias("label"), "text"))
    plain = language.Priors(language.scored(language.documents_as_rows(docs, ["text"]), model).drop("text"), model)
    seen = []
    kept, language.written = language.written, lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, name)
    try:
        fused = language.Priors(language.documents_as_rows(docs, ["text"]), model, from_text=True)
        out = language.identified(docs)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        language.written = kept
    assert [p.count("MapInArrow") for name, p in seen if name == "priors"] == [1, 1] and plan.count("MapInArrow") == 1
    assert np.allclose(fused.all, plain.all)
    for key in language.KEYS:
        get = lambda t: {r[0]: r[1] for r in t.collect()}
        one, two = get(fused.tables[key]), get(plain.tables[key])
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k]) for k in one)
    want = {r["doc_id"]: r["language"] for r in language.languages(language.documents_as_rows(docs, ["doc_id", "text"]), model, ["doc_id"]).where("keep").collect()}
    assert {r["doc_id"]: r["lang"] for r in out.collect()} == want
