"""Scans of one text stay linear: personal data, web tokens and chunks for token counts in texts of many megabytes."""

import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from diegrid.llm import pii, secrets, token_count
from diegrid.llm.queries import vocabulary

JWT = next(r for r in secrets.RULES if r.kind == "jwt")


def test_web_tokens_match_the_pattern():
    random = np.random.default_rng(0)
    bits = ["eyJ", ".", "a", "-_9", "0123456789", " ", "eyJabcdefghij", "eyJabcdefghi", "\u00e9", "\n"]
    found = 0
    for _ in range(4_000):
        text = "".join(bits[i] for i in random.integers(0, len(bits), 30))
        want = [("jwt", m.start(), m.end()) for m in re.finditer(JWT.pattern, text)]
        assert JWT.spans(text) == want
        found += len(want)
    assert found > 50


def test_web_tokens_in_a_long_run():
    token = "eyJabcdefghij.eyJabcdefghij.abcdefghij"
    text = "eyJ" * 3_000_000 + " " + token
    start = time.time()
    assert JWT.spans(text) == [("jwt", len(text) - len(token), len(text))]
    assert time.time() - start < 20


class Scores:
    """Stands for the trees: a fixed score of each span."""

    def score(self, x):
        return np.abs(np.sin(x.sum(axis=1) * 1000))


def brute(text, model, thresholds):
    strict, loose = pii.proposals(text)
    base = [s for s in strict if pii.valid(s[0], text[s[1]:s[2]])]
    more = [s for s in strict if s not in base] + loose
    kept = list(base)
    scores = model.score(np.array([pii.features(text, s) for s in more], float)) if more else []
    for score, s in sorted(zip(scores, more), key=lambda p: (-p[0], p[1])):
        if score >= thresholds[s[0]] and not any(k[0] == s[0] and k[1] < s[2] and s[1] < k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


def test_added_spans():
    random = np.random.default_rng(1)
    bits = ["a@b.de ", "10.0.0.1", "300.1.1.1 ", "4111 1111 1111 1111 ", "+1 (377) 555-0271", " 555 0271 377", "me (at) site (dot) org ", ".", " ", "12", "x@y"]
    thresholds, added = dict.fromkeys(pii.KINDS, 0.3), 0
    for _ in range(200):
        text = "".join(bits[i] for i in random.integers(0, len(bits), 25))
        base, kept = pii.spans(text, Scores(), thresholds)
        assert kept == brute(text, Scores(), thresholds)
        added += len(kept) - len(base)
    assert added > 50


def test_many_spans():
    text = " ".join(f"10.{i % 256}.{i // 256 % 256}.{i % 7}:300.1.{i}.1 u{i} (at) host{i} (dot) org" for i in range(20_000))
    start = time.time()
    base, kept = pii.spans(text, Scores(), dict.fromkeys(pii.KINDS, 0.2))
    assert len(base) >= 20_000 and len(kept) >= len(base) and time.time() - start < 60


def test_chunks_of_a_long_text(spark):
    """48 million characters are cut in seconds, and the chunks are the text."""
    n, chunk, reach = 48_000_000, token_count.CHUNK, token_count.OVERLAP
    text = F.repeat(F.lit("long text é\U0001F642 of words, " * 100), n // 2_300)
    chunks = -(-(n // 2_300 * 2_300) // chunk)
    rows = spark.range(1).select(F.col("id").alias("row"), F.expr(f"transform(sequence(0L, {chunks - 1}L), k -> struct(k, {reach}L as reach))").alias("ks"), text.alias("text"))
    start = time.time()
    cut = token_count._cut(rows, chunk).select("k", F.length("text").alias("n"), F.crc32("text").alias("h")).collect()
    assert time.time() - start < 60 and len(cut) == chunks
    whole = "long text é\U0001F642 of words, " * 100 * (n // 2_300)
    for r in cut:
        part = whole[r["k"] * chunk:(r["k"] + 1) * chunk + reach]
        assert (r["n"], r["h"]) == (len(part), zlib.crc32(part.encode()))


def test_token_counts_of_a_long_text(spark):
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    random = np.random.default_rng(3)
    words = ["".join(chr(c) for c in random.integers(97, 123, 7)) for _ in range(5_000)]
    text = " ".join(words[i] for i in random.integers(0, len(words), 500_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, path).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == {1: len(library.encode(text)), 2: len(library.encode("short")), 3: 0}
