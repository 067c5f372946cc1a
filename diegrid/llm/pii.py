"""Personal data: high-recall candidates, scored by boosted trees, selected by calibrated thresholds.

Generators propose overlapping spans of each kind: the strict pattern's matches and looser variants of it.
The strict matches that pass their check are always kept. The trees learn to tell them from matches that
fail the check, by format and context without the check itself, on all strict matches of one half of the distinct
texts; the threshold of a kind is the lowest score with the wanted precision on all of those of the other half.
Features are small whole numbers, so matches that look alike are one row with counts, and each tree is one job over
these rows. Looser spans above it are added where they do not overlap a span of their kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diegrid.functions.prefix import running_totals
from diegrid.llm.boosting import BINS, Boosted, edges_of
from diegrid.llm.store import written

KINDS = ("email", "ip", "card", "phone")
WEIGHT, N_FEATURES = 8_000, 16           # what all candidates weigh together at most, an eighth for each kind and half
PRECISION = 0.9
STEPS = (1, 1, 1, 251, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1)       # whole numbers of each feature's code, for one; codes end at 255

# The patterns of the four kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WORDS = {"email": ("mail", "contact", "at"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "tel", "call", "fax", "mobile")}
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}){1,4}")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|00[0-9]{2}|[0-9]{3})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """`local@domain` from the left: a local part cannot hold an @, so each @ is looked at once, in linear time."""
    at, done = text.find("@"), 0
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield low, done
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four numbers in chains of dotted numbers, from the left."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") >= 3:
            parts, at = chain[0].split("."), chain.start()
            for i in range(0, len(parts) - 3, 4):
                piece = ".".join(parts[i:i + 4])
                yield at, at + len(piece)
                at += len(piece) + 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in s.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(_digits(s)) <= 15


def proposals(text: str) -> tuple[list[Span], list[Span]]:
    """Strict matches, passing or not, and looser spans."""
    strict: list[Span] = [("email", a, b) for a, b in _emails(text)]
    loose: list[Span] = []
    if "(at)" in text or "[at]" in text:
        loose += [("email", m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    strict += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            strict.append(("card", m.start(), m.end()))
            at = [m.start() + i for i, c in enumerate(m[0]) if c not in " -"]
            if len(at) > 19:                                      # a number inside a longer run, where a space or dash bounds it
                starts = [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1] + 1]
                loose += [("card", at[i], at[i + 15] + 1) for i in starts if i + 15 < len(at) and (i + 16 == len(at) or at[i + 16] != at[i + 15] + 1)]
    strict += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)] if "+" in text else []
    loose += [("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
    return strict, loose


def features(text: str, span: Span) -> list[float]:
    """Format and context; what the checks decide by (octets, Luhn) is left out."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 24):a], text[b:b + 8]
    d = _digits(s)
    return [KINDS.index(kind), b - a, len(d), len(d) / max(1, b - a), len(set(d)), sum(c in " ().-" for c in s), s.count("."), s[:1] == "+",
            max((len(p) for p in re.split("[^0-9]+", s)), default=0), min((len(p) for p in re.split("[^0-9]+", s) if p), default=0),
            any(w in before.lower() for w in _WORDS[kind]), before[-1:].isalnum(), after[:1].isalnum(), before[-1:].isspace(), len(before), len(after)]


def _mixed(x: int) -> int:
    x &= (1 << 64) - 1
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * by) & ((1 << 64) - 1)
    return (x ^ (x >> 31)) >> 1


def coded(x: np.ndarray) -> np.ndarray:
    """Features as bytes, as `_code` has them."""
    return np.minimum(255, np.floor(x * np.array(STEPS, float) + 0.5)).astype(np.uint8)


def _code(x: list[float]) -> bytes:
    return bytes([min(255, int(v * s + 0.5)) for v, s in zip(x, STEPS)])


class Trees(Boosted):
    """Trees over coded features."""

    def score(self, x: np.ndarray) -> np.ndarray:
        return super().score(coded(x))


def _matrix(codes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, N_FEATURES)


def candidates(docs: DataFrame) -> DataFrame:
    """half, code, n, hits: how many strict candidates of all distinct texts have these features, and how many pass their check.

    The half is that of the text. A text's candidates leave its task as counts, copies of a text count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text, n, hits = text.as_py(), Counter(), Counter()
                for span in proposals(text)[0]:
                    code = _code(features(text, span))
                    n[code] += 1
                    hits[code] += valid(span[0], text[span[1]:span[2]])
                rows += [(h, h2, _mixed(h) & 1, code, k, hits[code]) for code, k in n.items()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["h", "h2", "half", "code", "n", "hits"])

    texts = docs.where("text is not null").select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    found = texts.mapInArrow(run, "h long, h2 long, half int, code binary, n long, hits long").dropDuplicates(["h", "h2", "code"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))          # each tree is a pass in Python: not coalesced by size
    return found.groupBy("half", "code").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).repartition(parts, "code")


def fit(docs: DataFrame, sample: int = WEIGHT, precision: float = PRECISION) -> tuple[Trees, dict[str, float]]:
    """Trees and the threshold of each kind, from all strict candidates of all distinct texts.

    `sample` leaves none out: where a kind has more candidates in a half than an eighth of it, they weigh as much as that
    together, so that a frequent kind does not drown a rare one."""
    each = max(1, sample // (2 * len(KINDS)))
    codes = written(candidates(docs), "candidates")
    learned = codes.where("half = 0").select("code", "n", "hits")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each kind and feature, how often each code occurs: 16,384 rows at most."""
        total = np.zeros((2, len(KINDS), N_FEATURES, 256))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).astype(np.int64)
                at = ((x[:, :1] * N_FEATURES + np.arange(N_FEATURES)) * 256 + x).ravel()
                for i in (0, 1):
                    total[i] += np.bincount(at, np.repeat(batch.column(1 + i).to_numpy().astype(float), N_FEATURES), total[i].size).reshape(total[i].shape)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(v.ravel()[at].astype(np.int64)) for v in total)], ["cell", "n", "hits"])

    def added(rows: DataFrame, names: list[str], size: int) -> np.ndarray:
        table = rows.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).toArrow()          # bounded: fixed cells
        out = np.zeros((len(names), size))
        out[:, table.column("cell").to_numpy()] = [table.column(n).to_numpy() for n in names]
        return out

    n, hits = added(learned.mapInArrow(values, "cell int, n long, hits long"), ["n", "hits"], len(KINDS) * N_FEATURES * 256).reshape(2, len(KINDS), N_FEATURES, 256)
    weight = np.minimum(1, each / np.maximum(1, n[:, 0].sum(1)))
    weighed = np.einsum("k,kfv->fv", weight, n)
    share = (weight @ hits[:, 0].sum(1)) / weighed[0].sum() if weighed[0].sum() else 0.5
    model = Trees().started([edges_of(np.flatnonzero(w), w[w > 0]) for w in weighed], float(share))

    def summed(model: Boosted) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | float = 0.0
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    total = total + model.sums(x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), weight[x[:, 0]])
            if isinstance(total, np.ndarray):
                at = np.flatnonzero(total[0])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(v[at].astype(np.int64)) for v in total)], ["cell", "n", "g", "h"])

        return added(learned.mapInArrow(run, "cell int, n long, g long, h long"), ["n", "g", "h"], N_FEATURES * (N_FEATURES + 1) // 2 * BINS * BINS)

    model.boosted(summed)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(Boosted.score(model, x)), batch.column(1), batch.column(2)], ["kind", "score", "n", "hits"])

    held = codes.where("half = 1").select("code", "n", "hits").mapInArrow(scored, "kind int, score double, n long, hits long")
    held = written(held.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "scores")
    good = running_totals(held, ["kind"], "score", ["n", "hits"], descending=True).where(F.col("run_hits") >= precision * F.col("run_n"))
    lowest = {r["kind"]: r["score"] for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}
    return model, {k: lowest.get(i, np.inf) for i, k in enumerate(KINDS)}


def spans(text: str, model: Trees, thresholds: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those that the model adds; both by kind, then start."""
    strict, loose = proposals(text)
    base = [s for s in strict if valid(s[0], text[s[1]:s[2]])]
    known = set(base)
    more = [s for s in strict if s not in known] + loose if len(base) < len(strict) or loose else []
    kept = list(base)
    if more:
        taken: dict[str, list[tuple[int, int]]] = {kind: sorted(s[1:3] for s in base if s[0] == kind) for kind in KINDS}      # disjoint within a kind
        scores = model.score(np.array([features(text, s) for s in more], float))
        for score, s in sorted(zip(scores, more), key=lambda p: (-p[0], p[1])):
            if score >= thresholds[s[0]]:
                at = bisect_left(taken[s[0]], (s[2],))
                if not at or taken[s[0]][at - 1][1] <= s[1]:
                    taken[s[0]].insert(at, (s[1], s[2]))
                    kept.append(s)
    order = {k: i for i, k in enumerate(KINDS)}
    by = lambda s: (order[s[0]], s[1], s[2])
    return sorted(base, key=by), sorted(kept, key=by)


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def personal_data(docs: DataFrame, sample: int = WEIGHT, precision: float = PRECISION) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    One row for each row. Offsets are code points, ends exclusive. A null or empty text has no spans; an
    empty table gives no rows, and without any labelled candidate nothing is added to the base.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, precision))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, thresholds = held.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, found = spans(text.as_py() or "", model, thresholds)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found) - len(base)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, found: list[Span], mark: str = "[{}]") -> str:
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark.format(kind.upper())]
        at = max(at, b)
    return "".join([*out, text[at:]])
