"""Four-Russians scores against plain products, and the mining against a loop over all rows."""

import compare
import numpy as np
import pytest

from diegrid.llm import hard_negatives as H
from diegrid.llm.queries import QUERIES, SQL

SCHEMA = "label int, vec_id long, embedding array<double>, id string, v int, part int"


@pytest.mark.parametrize("low, high, width", [(-160, 160, 64), (-1, 1, 5), (0, 3, 9), (-(1 << 40), 1 << 40, 8), (-7, 0, 1)])
def test_scores(low, high, width):
    random = np.random.default_rng(width)
    rows, anchors = random.integers(low, high, (300, width), endpoint=True), random.integers(-200, 200, (7, width))
    planes = H.bit_planes(rows)
    assert (H.scores(H.subset_sums(anchors, planes.shape[1], np.int64), planes) == rows @ anchors.T).all()


def brute(rows, every=100, k=5, low=80, high=100):
    kept = {}
    for label, vec_id, v, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = int(np.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        row = (label, [int(np.floor(256 * x)) for x in v])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    out = []
    for a, (la, va) in kept.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(va, vb)) for b, (_, vb) in kept.items() if b != a}
        positives = sorted((b for b in score if kept[b][0] == la), key=lambda b: (-score[b], b))[:k]
        for p in positives:
            near = sorted((b for b in score if kept[b][0] != la and low * score[p] <= high * score[b] <= high * score[p]), key=lambda b: (-score[b], b))
            out += [(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(near[:k])]
    return sorted(out)


def mined(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(H.quantised(df), **limits).collect())


def test_mining(spark):
    """Many parts and batches, ties, repeated ids and rows, nulls, odd lengths, negative ids, clashing columns."""
    random = np.random.default_rng(1)
    centres = random.normal(size=(6, 12))
    rows = []
    for i in range(900):
        v = (centres[i % 6] + 0.4 * random.normal(size=12)).round(1 if i % 2 else 3).tolist()
        rows.append((int(random.integers(0, 4)) if i % 3 else 2, i - 200, v, f"x{i}", i, -i))
    rows += [rows[5], rows[5], (None, 1, [1.0], "", 0, 0), (1, None, [1.0], "", 0, 0), (1, 901, None, "", 0, 0), (1, 902, [], "", 0, 0), (1, 300, [9.0], "", 0, 0),
             (1, 903, [1.0, None], "", 0, 0), (1, 904, [1.0, float("nan")], "", 0, 0), (1, 905, [float("inf")], "", 0, 0), (1, 906, [2.0, 3.0], "", 0, 0), (0, 300, [9.0], "", 0, 0)]
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows, part=150, anchors_at_once=3, rows_at_once=40) == want
    assert mined(spark, rows[:0]) == []


def test_equal_vectors(spark):
    """All scores are ties: the smallest ids win."""
    rows = [(i % 2, i, [0.5, 0.25], "", 0, 0) for i in range(300)]
    assert mined(spark, rows) == mined(spark, rows, part=100, anchors_at_once=2, rows_at_once=7) == brute(rows)


def test_wide_products_are_an_error(spark):
    rows = [(1, i, [1e13] * 4, "", 0, 0) for i in range(0, 300, 100)]
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, rows)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare.difference(spark, compare.connect(sf), QUERIES["op11_hard_negatives"], SQL["op11_hard_negatives"], sf) is None
