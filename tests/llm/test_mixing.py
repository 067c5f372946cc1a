"""The mix against its definition: quotas, disjoint draws, exact totals, the law of the splits, reruns."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from diegrid.llm import mixing as M
from diegrid.llm.queries import QUERIES
from diegrid.sources.tables import table

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def aimed(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets of {source: words} by filling and dealing out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (budget - sum(most * sizes[s] for s in full)) / (sum(w[s] for s in rest) or 1)
        above = {s for s in rest if level * w[s] >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else level * w[s] for s in order}
        full |= above


def check(rows, found, most=2):
    """rows (doc_id, source, text) against doc_id, size, source_size, target, taken."""
    size = [len(re.findall(WORD, t or "")) for _, _, t in rows]
    total = Counter()
    for (_, s, _), n in zip(rows, size):
        total[s] += n
    goal = aimed(total)
    assert sorted(((d, n, total[s], round(goal[s], 3)) for (d, s, _), n in zip(rows, size)), key=repr) == sorted(((r[0], r[1], r[2], round(r[3], 3)) for r in found), key=repr)
    assert all(0 <= r[4] <= most * r[1] for r in found)
    taken = Counter()
    for r in found:
        taken[r[2], round(r[3], 3)] += r[4]
    for k, t in taken.items():
        same = sum(round(goal[s], 3) == k[1] and total[s] == k[0] for s in goal)
        assert abs(t - same * k[1]) <= same
    return goal


def test_query(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    found = [tuple(r) for r in QUERIES["op12_mixing"](spark, SF).collect()]
    check(rows, found)
    again = M.digest(docs.repartition(13, "n_chars"))
    assert sorted(found) == sorted(tuple(r) for r in again.collect())


def odd(spark):
    random = np.random.default_rng(4)
    rows = [(None, None, None), (1, None, ""), (1, "b", " \t"), (2, "b", "x"), (2, "b", "x"), (None, "c", "a b c"), (3, "\u00e9", "w " * 70_000), (4, "", "one two")]
    rows += [(10 + i, "hot" if i % 3 else ["a", None, "z"][i // 3 % 3], " ".join(f"w{j}" for j in range(int(random.integers(0, 900))))) for i in range(300)]
    return rows, spark.createDataFrame([(d, s, t, 1, 2, 3, 4) for d, s, t in rows], "doc_id long, source string, text string, number int, size int, start long, h long")


def test_odd_rows(spark, monkeypatch):
    rows, df = odd(spark)
    found = [tuple(r) for r in M.digest(df).collect()]
    check(rows, found)
    monkeypatch.setattr(M, "SHARD", 16)                  # many shards, a deep tree
    monkeypatch.setattr(M, "CELL", 900)
    monkeypatch.setattr(M, "SUBTREES", 4)
    monkeypatch.setattr(M, "FEW_SOURCES", 2)
    check(rows, [tuple(r) for r in M.digest(df.repartition(7)).collect()])
    assert M.digest(df.limit(0)).collect() == []
    assert {r[4] for r in M.digest(df.where("size(split(text, ' ')) < 1")).collect()} <= {0}


def test_spans(spark, monkeypatch):
    """Shards have their capacity, draws are disjoint, rounds are whole, pieces are what the texts say."""
    monkeypatch.setattr(M, "SHARD", 32)
    rows, df = odd(spark)
    spans, held = M.mixed(df, seed=5)
    spans = spans.cache()
    got = spans.collect()
    draws = defaultdict(set)
    for s in got:
        draws[s["shard"]].add((s["number"], s["draw"]))
    counts = [len(d) for d in draws.values()]
    assert len(counts) > 10 and max(counts) - min(counts) <= 1 and len(set().union(*draws.values())) == sum(counts)
    sizes = {(r["number"], r["start"]): r["size"] for r in held.where("size > 0").collect()}
    words = Counter()
    for s in got:
        for w in range(s["first_word"], s["first_word"] + s["n_words"]):
            words[s["number"], s["start"], w] += 1
    assert max(words.values()) <= 2
    for number in {n for n, _ in sizes}:                 # a second round starts when the first one is over
        seen = [words[number, a, w] for (n, a), size in sizes.items() if n == number for w in range(size)]
        assert min(seen) >= max(seen) - 1
    assert [s["place"] for s in sorted((s for s in got if s["shard"] == 0), key=lambda s: s["place"])] == list(range(1, sum(s["shard"] == 0 for s in got) + 1))
    text = {r[0]: r[1] for r in df.select(F.xxhash64("doc_id", "text"), "text").collect()}
    made = {(r["shard"], r["place"]): r["text"] for r in M.texts(df, spans).collect()}
    for s in got:
        assert re.findall(WORD, made[s["shard"], s["place"]]) == re.findall(WORD, text[s["doc"]["h"]])[s["first_word"]:s["first_word"] + s["n_words"]]
    other = M.mixed(df, seed=6)[0].collect()
    assert {(s["number"], s["draw"], s["shard"]) for s in got} != {(s["number"], s["draw"], s["shard"]) for s in other}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    x, whole = np.arange(n), np.full(n, n)
    p = M._place(np.full(n, 7), np.zeros(n, np.int64), x, whole, 1)
    q = M._place(np.full(n, 7), np.ones(n, np.int64), x, whole, 1)
    assert sorted(p) == list(x) and sorted(q - n) == list(x) and (n < 17 or (p != q - n).any())


def test_law(monkeypatch):
    """Splits follow the law, also where numbers are too large for the library and are drawn by inversion."""
    quotas, sample = np.array([30, 5, 15]), 20
    for small in (True, False):
        if not small:
            monkeypatch.setattr(M, "_SMALL", 1)
        draws = np.array([M.halved(quotas, sample, np.random.default_rng(i)) for i in range(6_000)])
        assert (draws.sum(axis=1) == sample).all() and (draws <= quotas).all()
        for s, q in enumerate(quotas):
            want = [math.comb(int(q), k) * math.comb(50 - int(q), sample - k) / math.comb(50, sample) if k <= sample else 0 for k in range(q + 1)]
            assert np.abs(np.bincount(draws[:, s], minlength=q + 1) / 6_000 - want).max() < 0.025
    big = [M.hypergeometric(3 * 10 ** 10, 10 ** 10, 2 * 10 ** 10, np.random.default_rng(i)) for i in range(40)]
    assert abs(np.mean(big) - 1.5e10) < 6 * 43_301 / math.sqrt(40) and 15_000 < np.std(big) < 90_000
