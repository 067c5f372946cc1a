"""Tries against dictionaries, and the mining against plain counting and SQL."""

import re
from collections import Counter

import compare
import numpy as np
import pytest

from diegrid.llm import collocations as C
from diegrid.llm.double_array import Trie, build
from diegrid.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def brute(rows, least, top, share=50, width=3):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, low = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            totals[lang] += len(w)
            for k in range(1, width + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in cand.items():
            for q in {p[:2], p[1:]} if len(p) == 3 else ():
                inside[q] = max(inside.get(q, 0), a)
        rows_ = []
        for p, a in cand.items():
            if p in inside and len(p) == 2 and 100 * inside[p] >= share * a:
                continue
            score, k = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def test_trie():
    random = np.random.default_rng(0)
    keys = sorted({bytes(random.integers(0, 256 if i % 3 else 3, random.integers(1, 7)).astype(np.uint8)) for i in range(30_000)} | {b"a" * 500})
    trie, ends = build(keys)
    trie = Trie.frombytes(trie.tobytes())
    assert len(set(ends.tolist())) == len(keys)
    assert all(trie.walk(k) == e for k, e in zip(keys[::7], ends[::7]))
    for other in [bytes(random.integers(0, 256, 4).astype(np.uint8)) for _ in range(2_000)]:
        assert (trie.walk(other) >= 0) == any(k.startswith(other) for k in keys)
    empty, none = build([])
    assert empty.walk(b"x") == -1 and len(none) == 0


def odd_rows():
    random = np.random.default_rng(2)
    words = ["a", "b", "ab", "Ab", "aB\x00", "\u00e9t\u00e9", "\u00c9t\u00e9", "x" * 300, "\U0001f642", "\xa0", "the", "of"]
    joint = [" ", " ", "  ", "\t", ". ", ",", "\n", "\r", " \x0b", "?"]
    rows = [(None, None), ("en", None), ("en", ""), (None, " ,. "), ("x y", "a b a b a b."), ("\xff", "a b " * 30), ("en", "a " * 3_000), ("en", "nospace" * 20_000)]
    for i in range(400):
        n = int(random.integers(0, 40)) if i % 97 else 3_000
        rows.append(([None, "en", "en", "de", "und"][i % 5], "".join(words[int(random.integers(0, 12)) ** 2 // 12] + joint[int(random.integers(0, 10))] for _ in range(n))))
    return rows + rows[-20:]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, small):
    """With small limits: texts cut, many blocks and passes, packed runs given out early, slots that phrases share."""
    lim = C.Limits(slot_bits=17, held=64, block=40, tries=2, run=300) if small else C.Limits()
    rows = odd_rows()
    df = spark.createDataFrame([(t, lang, i, "q", 1) for i, (lang, t) in enumerate(rows)], "text string, lang string, f long, phrase string, range int").repartition(5)
    for least, top, share in ((10, 2_000, 50), (3, 7, 90)):
        assert sorted(tuple(r) for r in C.collocations(df, least, top, share, lim=lim).collect()) == brute(rows, least, top, share)
    assert C.collocations(df.limit(0)).collect() == []


def test_sql(spark):
    assert compare.difference(spark, compare.connect(SF), QUERIES["op13_collocations"], SQL["op13_collocations"], SF) is None
