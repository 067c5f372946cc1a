"""Texts as numbers of words: nothing is lost at the ends of tries, rows, parts and keys, and no pass is made for phrases."""

import numpy as np
import pytest
import test_collocations as T

from diegrid.llm import collocations as C
from diegrid.llm.words import mix


def table(spark, rows):
    return spark.createDataFrame([(lang, t) for lang, t in rows], "lang string, text string")


def test_unmixed():
    x = np.random.default_rng(0).integers(0, 2 ** 64, 10_000, np.uint64, endpoint=False)
    assert (C._unmixed(mix(x)) == x).all()


@pytest.mark.parametrize("lim", [C.Limits(block=3, tries=2, held=50), C.Limits(block=1, tries=5, run=300, slot_bits=4), C.Limits(key_bits=10, held=500)])
def test_many_tries_passes_and_long_keys(spark, lim, monkeypatch):
    """Words that begin one another stand in different tries; rows of numbers hold seven words."""
    monkeypatch.setattr(C, "ROW", 7)
    monkeypatch.setattr(C, "PART", 6)
    assert sorted(tuple(r) for r in C.collocations(table(spark, T.odd_rows()).repartition(3), lim=lim).collect()) == T.brute(T.odd_rows(), 10, 2_000)


def test_passes_do_not_grow_with_phrases(spark, monkeypatch):
    """30 words make some 900 pairs and, by blocks of 40 phrases and one trie a pass, made dozens of passes over the texts."""
    random = np.random.default_rng(1)
    rows = [("en", " ".join(f"w{i}" for i in random.integers(0, 30, 3_000))) for _ in range(10)]
    names, written = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: names.append(name) or written(df, name))
    got = C.collocations(table(spark, rows), lim=C.Limits(block=40, tries=1))
    assert sorted(tuple(r) for r in got.collect()) == T.brute(rows, 10, 2_000) and len(names) < 10


def test_filled_slots_leave_no_false_candidates(spark):
    """Slots by which pairs were candidates filled up beyond some 10^8 words; counts of pairs are exact now."""
    random = np.random.default_rng(2)
    docs = table(spark, [("en", " ".join(f"w{i}" for i in random.integers(0, 200, 4_000))) for _ in range(10)])
    lim = C.Limits(slot_bits=10)
    tight = {tuple(r) for r in C.supports(docs, lim=lim)[0].collect()}
    assert tight == {tuple(r) for r in C.supports(docs)[0].collect()} and min(r[3] for r in tight) >= 10
    words, two = np.array([r[1] for r in tight if r[2] == 1]), [r for r in tight if r[2] == 2]
    assert len(words) == 200 and len(two) < 2_000
