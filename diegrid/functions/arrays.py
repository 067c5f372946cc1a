"""Probability-vector expressions. Vectors are ARRAY<DOUBLE> in class order, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once. A lambda body is evaluated per element, so anything that does not
    depend on the element must be bound outside of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def normalised(a: Column) -> Column:
    return let(a, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def softmax(z: Column) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda m: normalised(F.transform(v, lambda x: F.exp(x - m)))))


def tempered_softmax(z: Column, temperature: float | Column) -> Column:
    return softmax(F.transform(z, lambda x: x / temperature))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(clip(x, 1e-12, 1.0))))


def dirichlet(evidence: Column) -> tuple[Column, Column]:
    """Mean probabilities and vacuity C / sum(alpha), alpha = softplus(evidence) + 1."""
    alpha = F.transform(evidence, lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) + 1)
    return normalised(alpha), F.size(evidence) / total(alpha)


def argmax(p: Column) -> Column:
    """Position of the largest element, the first one on ties (0-based)."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ranked(p: Column) -> Column:
    """Structs (k, p) by probability descending, ties by class index ascending."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("k")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct(s["k"].alias("k"), (-s["neg"]).alias("p")))


def log_clipped(p: Column) -> Column:
    return F.transform(p, lambda x: F.ln(clip(x, 1e-6, 1.0)))


def alarms(p: Column, final: Column, thresholds: dict[int, float], n_classes: int, baseline: int) -> Column:
    """Class indices other than the final and the baseline class whose probability reaches their
    threshold; a class without a threshold never raises one."""
    limit = F.array(*[F.lit(float(thresholds.get(k, 1.1))) for k in range(n_classes)])
    hit = F.zip_with(F.zip_with(p, limit, lambda x, t: x >= t), F.sequence(F.lit(0), F.lit(n_classes - 1)),
                     lambda h, k: F.when(h & (k != baseline) & (k != final), k))
    return F.filter(hit, lambda k: k.isNotNull())
