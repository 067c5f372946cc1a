"""The trees and thresholds of op4 come from every strict candidate of every distinct text."""

import numpy as np
import pytest

from diegrid.llm import pii
from diegrid.llm.boosting import calibrated
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    random = np.random.default_rng(11)
    words = ["server ip", "host", "version", "build", "pay card", "number", "call", "tel", "lot"]
    texts = []
    for _ in range(1500):
        parts = []
        for _ in range(int(random.integers(1, 6))):
            parts.append(words[random.integers(len(words))])
            parts.append([".".join(map(str, random.integers(0, 330, 4))), " ".join(f"{x:04d}" for x in random.integers(0, 10000, 4)),
                          "+" + " ".join(map(str, random.integers(10, 10 ** int(random.integers(2, 6)), 3))), f"me{random.integers(99)}@site.org"][random.integers(4)])
        texts.append(" ".join(parts))
    texts += texts[:50] * 3 + [None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def strict(docs, half):
    """(kind, features, passes) of the distinct texts of a half."""
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text").distinct().collect()
    return [(s[0], pii.features(r.text, s), pii.valid(s[0], r.text[s[1]:s[2]])) for r in rows if pii._mixed(r.h) & 1 == half for s in pii.proposals(r.text)[0]]


def test_all_candidates_are_counted(docs):
    got = pii.candidates(docs).collect()
    for half in (0, 1):
        want = strict(docs, half)
        mine = [r for r in got if r.half == half]
        assert sum(r.n for r in mine) == len(want) and sum(r.hits for r in mine) == sum(w[2] for w in want)
        assert {bytes(r.code) for r in mine} == {pii.coded(np.array(w[1])).tobytes() for w in want}


def test_thresholds_hold_on_all_held_out_candidates(docs):
    """A weight of 80 is far below the number of candidates; the thresholds are those of all of them."""
    model, thresholds = pii.fit(docs, sample=80)
    held = strict(docs, 1)
    for kind in pii.KINDS:
        mine = [w for w in held if w[0] == kind]
        assert len(mine) > 200
        assert thresholds[kind] == calibrated(model.score(np.array([w[1] for w in mine])), np.array([float(w[2]) for w in mine]), pii.PRECISION)
    again, same = pii.fit(docs.repartition(1), sample=80)
    assert again.trees == model.trees and model.trees and same == thresholds


def test_sums_over_parts_are_those_of_all_rows():
    from diegrid.llm.boosting import Boosted, edges_of
    random = np.random.default_rng(2)
    x = random.integers(0, 40, (3000, 4)).astype(float)
    y, one = ((x[:, 0] > 12) ^ (x[:, 2] > 30)).astype(float), np.ones(3000)
    whole = Boosted().fit(x, y)
    edges = [edges_of(*np.unique(v, return_counts=True)) for v in x.T]
    parts = Boosted().started(edges, y.mean()).boosted(lambda model: sum(model.sums(x[i::3], one[i::3], y[i::3], one[i::3]) for i in range(3)))
    assert parts.trees == whole.trees and ((whole.score(x) > 0) == y).mean() > 0.95
