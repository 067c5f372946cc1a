"""Secret scan over a trigram inverted index.

Every rule's regular expression yields a Boolean query over trigrams that any match must contain. Each batch of
texts is an index segment: one pass over its bytes makes postings (trigram -> texts) of the trigrams that
some query names, the queries are answered by uniting and intersecting postings, and the rule runs on the
texts that remain. A rule without a mandatory trigram runs on all texts.

A query is None (no constraint), a trigram, or ("and" | "or", queries).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diegrid.llm.words import LOWER, runs_of_rows, utf8

MOST = 64                                # strings that an exact set may hold before it becomes a query
ROWS = 512                               # rows that go back from Python at once, where texts are replaced

Query = None | str | tuple


def _combine(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return parts[0] if len(parts) == 1 else (kind, tuple(parts)) if parts else None


def _needs(strings: set[str]) -> Query:
    """What a text needs that contains one of these strings."""
    return _combine("or", [_combine("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(node) -> tuple[set[str] | None, Query]:
    """For part of a parsed expression: all strings that it matches if they are few, else None; and its query."""
    exact: set[str] | None = {""}
    needs: list[Query] = []

    def append(strings: set[str] | None, query: Query) -> None:
        nonlocal exact
        if exact is not None and strings is not None and len(exact) * len(strings) <= MOST:
            exact = {a + b for a in exact for b in strings}
            return
        if exact is not None:
            needs.append(_needs(exact))
        needs.append(_needs(strings) if strings is not None else query)
        exact = None

    held: set[str] = {""}
    for kind, value in node:
        if kind is op.LITERAL:
            step: tuple[set[str] | None, Query] = ({chr(value).lower()}, None)
        elif kind is op.IN:
            chars: set[str] | None = set()
            for k, v in value:
                if k is op.LITERAL:
                    chars.add(chr(v).lower())
                elif k is op.RANGE and v[1] - v[0] < 8:
                    chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    chars = None
                    break
            step = (chars if chars and len(chars) <= 8 else None, None)
        elif kind is op.SUBPATTERN:
            step = _walk(value[-1])
        elif kind is op.BRANCH:
            sides = [_walk(p) for p in value[1]]
            if all(s[0] is not None for s in sides) and sum(len(s[0]) for s in sides) <= MOST:
                step = (set().union(*(s[0] for s in sides)), None)
            else:
                step = (None, _combine("or", [_needs(s[0]) if s[0] is not None else s[1] for s in sides]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            strings, query = _walk(inner)
            if high == 1 and strings is not None:
                step = (strings | {""} if low == 0 else strings, None)
            else:
                step = (None, None if low == 0 else _needs(strings) if strings is not None else query)
        elif kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
            continue
        else:
            step = (None, None)
        # a run of exact parts after an inexact one starts a new run
        if exact is None and step[0] is not None and len(held) * len(step[0]) <= MOST:
            held = {a + b for a in held for b in step[0]}
            continue
        if exact is None:
            needs.append(_needs(held))
            held = {""}
        append(*step)
    if exact is not None:
        return exact, None
    needs.append(_needs(held))
    return None, _combine("and", needs)


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The query of a regular expression, in lower case."""
    strings, query = _walk(parser.parse(pattern, flags))
    return _needs(strings) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


@dataclass
class Rule:
    """`group` is what has to be of `least` characters or more; base rules have a column of counts."""
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0
    base: bool = False
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None       # finds the pattern's matches in linear time
    query: Query = field(init=False)

    def __post_init__(self) -> None:
        self.query = trigram_query(self.pattern, self.flags)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        if self.find:
            return [(self.kind, a, b) for a, b in self.find(text)]
        return [(self.kind, m.start(), m.end()) for m in re.compile(self.pattern, self.flags).finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


def _web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the `jwt` pattern. Runs of its characters are cut at dots, so each character is read once: three parts
    in a row make a token, from the first mark in the first part on."""
    for run in re.finditer("[A-Za-z0-9_.-]+", text):
        parts, at, i = run.group().split("."), [run.start()], 0
        for part in parts:
            at.append(at[-1] + len(part) + 1)
        while i + 2 < len(parts):
            mark = parts[i].find("eyJ")
            if 0 <= mark <= len(parts[i]) - 13 and parts[i + 1].startswith("eyJ") and len(parts[i + 1]) >= 13 and len(parts[i + 2]) >= 10:
                yield at[i] + mark, at[i + 3] - 1
                i += 3
            else:
                i += 1


# The patterns. ASCII keeps letters such as the long s from passing for s.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.I | re.A, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]+", 24, base=True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", find=_web_tokens),
    Rule("url", r"[a-z][a-z0-9+]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{6,128}@", flags=re.A),
]


class Segment:
    """Postings of one run of texts, of the named trigrams only."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, names: list[str]):
        low = LOWER[data]
        codes = [int.from_bytes(n.encode(), "big") for n in names]
        wanted = np.zeros(1 << 24, bool)
        wanted[codes] = True
        code = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(wanted[code])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[row + 1]
        pairs = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        self.rows, found = len(offsets) - 1, pairs >> 32
        self.postings = {n: pairs[np.searchsorted(found, c):np.searchsorted(found, c, side="right")] & 0xFFFFFFFF for n, c in zip(names, codes)}

    def answer(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[query]
        parts = [self.answer(q) for q in query[1]]
        return reduce(np.union1d if query[0] == "or" else lambda a, b: np.intersect1d(a, b, assume_unique=True), parts)


_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _long_hex_rows(data: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """The full scan of the rule without trigrams: rows with `least` hexadecimal digits in a row."""
    inside = np.concatenate([[False], _HEX[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    first, last = (np.searchsorted(offsets, x[long], side="right") - 1 for x in (starts, ends - 1))
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])) if len(first) else first


def scan(column: pa.Array, rules: list[Rule]) -> list[list[tuple[str, int, int]]]:
    """The spans of all rules in every text, by start, then rule."""
    names = sorted(set().union(*(trigrams(r.query) for r in rules)))
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    data, offsets = utf8(column)
    for i, j in runs_of_rows(offsets):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        segment = Segment(part, at, names)
        texts: dict[int, str] = {}
        for rule in rules:
            rows = segment.answer(rule.query)
            if rule.pattern == r"[0-9a-f]+":                      # a full scan, of the bytes; a run that reaches over a row's end adds rows
                rows = _long_hex_rows(part, at, rule.least)
            for r in rows:
                if r not in texts:
                    texts[r] = column[i + int(r)].as_py() or ""
                found[i + int(r)] += rule.spans(texts[r])
    order = {r.kind: k for k, r in enumerate(rules)}
    return [sorted(f, key=lambda s: (s[1], order[s[0]])) for f in found]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, a count n_<kind> of each base rule, base_sha256, spans.

    One row for each row. Offsets are code points, ends exclusive. A null or empty text has no spans, an
    empty table gives no rows.
    """
    kinds = [r.kind for r in rules if r.base]
    names = ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in scan(batch.column(1), rules):
                base = [s for s in found if s[0] in kinds]
                rows.append((*(sum(s[0] == k for s in base) for k in kinds), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            columns = list(zip(*rows)) if rows else [[]] * (len(kinds) + 2)
            types = [pa.int64()] * len(kinds) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, ", ".join(["doc_id long", *(f"n_{k} long" for k in kinds), "base_sha256 string, spans string"]))


def redact(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every secret in `text` replaced by `mark`; all other columns, and null texts, stay."""
    place, columns = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
            texts = part.column(place)
            changed: list[str | None] = []
            for text, found in zip(texts, scan(texts, rules)):
                text = text.as_py()
                out, at = [], 0
                for _, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                changed.append("".join([*out, text[at:]]) if found else text)
            arrays = [pa.array(changed, texts.type) if c == place else part.column(c) for c in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, docs.schema)
