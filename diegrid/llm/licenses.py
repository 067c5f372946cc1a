"""Licence scan with a generalised suffix automaton over the words of licence templates.

A text's words are streamed through the automaton: after each word it holds the longest run of words, ending
there, that occurs in some template (matching statistics). Maximal runs are cut into spans of the templates
that contain them and chained in template order; the share of a template's words that its best chain covers is
its coverage. Phrases are templates too: they stand wherever the current run ends with them.

Words that no template has end every run, so only stretches of template words reach the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diegrid.llm.words import ALNUM, LOWER, runs_of_rows, utf8, word_bounds, word_hashes

SEED = 5                                 # words of the shortest run that is chained
COVERED = 0.7                            # share of a template that labels a text

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Passages of public licence texts.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
    "apache-2-line": "licensed under the apache license version 2 0",
    "mit-line": "released under the terms of the mit license",
}


class Automaton:
    """Suffix automaton of several word sequences; every state also knows one template place of its run."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.texts = [(label, text.split(), True) for text, label in phrases.items()] + [(label, text.split(), False) for label, text in templates.items()]
        words = sorted({w for _, t, _ in self.texts for w in t})
        self.vocabulary = {w: i for i, w in enumerate(words)}
        data, offsets = utf8(pa.array(words, pa.string()))
        hashes = word_hashes(data, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, list[int]]] = [{}]                # template -> ends of the state's runs in it
        for t, (_, text, _) in enumerate(self.texts):
            state = 0
            for i, w in enumerate(text):
                state = self._extend(state, self.vocabulary[w])
        for t, (_, text, _) in enumerate(self.texts):                 # places reach up along suffix links
            state = 0
            for i, w in enumerate(text):
                state = self.next[state][self.vocabulary[w]]
                s = state
                while s > 0:
                    self.places[s].setdefault(t, []).append(i + 1)
                    s = self.link[s]
        sizes = [len(text) for _, text, _ in self.texts]
        self.phrases = [[(t, sizes[t]) for t in p if self.texts[t][2] and sizes[t] in p[t] and self.length[self.link[s]] < sizes[t] <= self.length[s]]
                        for s, p in enumerate(self.places)]

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _fork(self, p: int, w: int, q: int) -> int:
        """The state of exactly the run that p and w make, split off from q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._fork(last, w, self.next[last][w])
        state, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._fork(p, w, self.next[p][w])
        return state

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of hashed words, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def stream(self, ids: list[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """For one stretch of template words that begins at word `first`: phrase places (start, template),
        and maximal runs (end, length, state) of SEED words or more."""
        state = run = 0
        places, runs = [], []
        for i, w in enumerate(ids, first + 1):
            before = (i - 1, run, state)
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state, run = self.next[state][w], run + 1
                while state and run <= self.length[self.link[state]]:
                    state = self.link[state]
            if run <= before[1] and before[1] >= SEED:
                runs.append(before)
            s = state
            while s > 0:
                places += [(i - n, t) for t, n in self.phrases[s] if n <= run]
                s = self.link[s]
        if run >= SEED:
            runs.append((first + len(ids), run, state))
        return places, runs

    def coverage(self, runs: list[tuple[int, int, int]]) -> dict[int, float]:
        """By template, the largest share of its words in one chain of runs that follow each other in text and template."""
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, run, state in runs:
            for t, ends in self.places[state].items():
                if not self.texts[t][2]:
                    spans.setdefault(t, []).extend((end - run, end, e - run, e) for e in ends)
        out: dict[int, float] = {}
        for t, own in spans.items():
            size, own = len(self.texts[t][1]), sorted(own)
            best = [0] * len(own)
            for i, (a, b, x, y) in enumerate(own):
                before = 0
                for j in range(i - 1, -1, -1):
                    _, b0, _, y0 = own[j]
                    if a - own[j][0] > 4 * size:                      # outside of one copy of the template
                        break
                    if y0 < y and b0 < b:
                        before = max(before, best[j] - max(0, y0 - x, b0 - a))
                best[i] = before + y - x
            out[t] = min(1.0, max(best) / size)
        return out


def scan(column: pa.Array, automaton: Automaton) -> Iterator[tuple]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    data, offsets = utf8(column)
    names = [label for label, _, _ in automaton.texts]
    for i, j in runs_of_rows(offsets):
        low = LOWER[data[offsets[i]:offsets[j]]]
        starts, ends, first = word_bounds(low, offsets[i:j + 1] - offsets[i], ALNUM)
        ids = automaton.ids(word_hashes(low, starts, ends))
        known = np.concatenate([[False], ids >= 0, [False]])
        for r in range(j - i):
            lo, hi = int(first[r]), int(first[r + 1])
            inside = np.concatenate([[False], known[lo + 1:hi + 1], [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            places, runs = [], []
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= 3:
                    p, m = automaton.stream(ids[lo + a:lo + b].tolist(), a)
                    places += p
                    runs += m
            cover = automaton.coverage(runs) if runs else {}
            base = sorted({names[t] for _, t in places})
            found = {names[t] for t, c in cover.items() if c >= COVERED}
            at = [s for s, _ in places]
            score = max([1.0 if places else 0.0, *cover.values()])
            yield hi - lo, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(found | set(base))), float(score)


def licences(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row for each row. n_base counts all places of phrases; labels also have the templates of which a
    chain covers COVERED or more; score is the best coverage, 1 for a phrase. A null or empty text has no
    words, no labels and score 0; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(Automaton(phrases, templates))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*scan(batch.column(1), held.value))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
