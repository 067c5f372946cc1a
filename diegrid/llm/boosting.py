"""Gradient-boosted trees of depth two over all rows, by sums of pairs of binned features, and a monotone calibration of their scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BINS = 16
FIXED = float(1 << 32)                   # gradients are added as whole numbers of this fraction: no order of rows changes a sum


def edges_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """At most 15 cuts of a feature: all of its distinct `values`, in order, if they are few, else weighted quantiles."""
    if len(values) <= BINS:
        return values[:-1].astype(float)
    upto = np.cumsum(weights)
    return np.unique(values[np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS), len(values) - 1)]).astype(float)


class Boosted:
    """Logistic loss, Newton leaf values; each tree asks one question and then one more on either side.

    Both follow from the sums of one pass over the rows, by the bins of each pair of features."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, least: int = 5):
        self.rounds, self.rate, self.least, self.trees, self.base = rounds, rate, least, [], 0.0
        self.edges: list[np.ndarray] = []

    def started(self, edges: list[np.ndarray], share: float) -> "Boosted":
        share = min(max(share, 0.01), 0.99)
        self.edges, self.base, self.trees = edges, float(np.log(share / (1 - share))), []
        return self

    def sums(self, x: np.ndarray, n: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of `n` rows like each row of x, `hits` of them true: (3, cells) rows, gradients and curvatures."""
        p = 1 / (1 + np.exp(-Boosted.score(self, x)))
        bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], 1)
        a, b = np.triu_indices(len(self.edges))
        cells = ((np.arange(len(a)) * BINS + bins[:, a]) * BINS + bins[:, b]).ravel()
        values = n, np.rint(weight * (hits - n * p) * FIXED), np.rint(weight * n * p * (1 - p) * FIXED)
        return np.stack([np.bincount(cells, np.repeat(v.astype(float), len(a)), len(a) * BINS * BINS) for v in values])

    def _split(self, sums: np.ndarray) -> tuple[int, int] | None:
        """Feature and bin after which the rows of sums (3, features, bins) part best."""
        low, whole = np.cumsum(sums, 2)[:, :, :-1], sums.sum(2)[:, :, None]
        (n, g, h), (m, i, j) = low, whole - low
        gain = g ** 2 / (h + 1) + i ** 2 / (j + 1) - (g + i) ** 2 / (h + j + 1)
        gain[(n < self.least) | (m < self.least)] = 0
        best = int(np.argmax(gain))
        return divmod(best, BINS - 1) if gain.flat[best] > 1e-9 else None

    def grown(self, total: np.ndarray) -> bool:
        """One more tree from the sums over all rows; false if no question helps."""
        k = len(self.edges)
        a, b = np.triu_indices(k)
        sums = np.zeros((3, k, k, BINS, BINS))
        sums[:, a, b] = total.reshape(3, -1, BINS, BINS)
        sums[:, b, a] = sums[:, a, b].swapaxes(2, 3)
        sums[1:] /= FIXED
        root = self._split(sums[:, np.arange(k), np.arange(k)].sum(2))
        if root is None:
            return False
        f, cut = root
        tree: list[tuple] = [(f, float(self.edges[f][cut]))]
        for side in (slice(0, cut + 1), slice(cut + 1, None)):
            mine = sums[:, f, :, side].sum(2)
            g, at = self._split(mine) or (0, BINS)
            leaves = [self.rate * part[1].sum() / (part[2].sum() + 1) for part in (mine[:, g, :at + 1], mine[:, g, at + 1:])]
            tree.append((g, float(self.edges[g][at]) if at < BINS else np.inf, *map(float, leaves)))
        self.trees.append(tuple(tree))
        return True

    def boosted(self, total: Callable[["Boosted"], np.ndarray]) -> "Boosted":
        """All rounds; `total` adds up `sums` of the model so far over all rows."""
        while len(self.trees) < self.rounds and self.grown(total(self)):
            pass
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """The same on arrays."""
        one = np.ones(len(y))
        edges = [edges_of(*np.unique(v, return_counts=True)) for v in x.T]
        return self.started(edges, y.mean() if len(y) else 0.5).boosted(lambda model: model.sums(x, one, y, one))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for (f, cut), left, right in self.trees:
            for side, (g, c, a, b) in ((x[:, f] <= cut, left), (x[:, f] > cut, right)):
                out += np.where(side, np.where(x[:, g] <= c, a, b), 0.0)
        return out


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score above which the share of true rows is at least `precision`; ties stay together."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)
    good = np.flatnonzero(last & (hits >= precision * np.arange(1, len(s) + 1)))
    return float(s[good[-1]]) if len(good) else np.inf
