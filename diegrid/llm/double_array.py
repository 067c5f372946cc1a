"""Double-array tries over bytes, built and walked with numpy.

A child of state s by symbol c is the cell base[s] + c if check there says s. Children of a state share one base,
so a step from a state is two look-ups, and many positions of a text step at once, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN = 256                               # symbols are bytes
_ROUNDS = 24                             # bases tried for the states of a size class before they get cells of their own


@dataclass(frozen=True)
class Trie:
    base: np.ndarray
    check: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child of each state by its symbol, -1 where there is none."""
        cells = self.base[states] + symbols
        return np.where(self.check[cells] == states, cells, -1)

    def walk(self, word: bytes, state: int = 0) -> int:
        for c in word:
            cell = int(self.base[state]) + c
            if self.check[cell] != state:
                return -1
            state = cell
        return state

    def tobytes(self) -> bytes:
        return self.base.tobytes() + self.check.tobytes()

    @staticmethod
    def frombytes(data: bytes) -> Trie:
        both = np.frombuffer(data, np.int32)
        return Trie(both[:len(both) // 2], both[len(both) // 2:])


def _place(sizes: np.ndarray, starts: np.ndarray, symbols: np.ndarray, top: int, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """Bases for child sets so that no two share a cell: large sets first, the same bases proposed by many
    sets at once and kept where all cells are free; sets that stay without one get fresh cells."""
    bases, used = np.full(len(sizes), -1, np.int64), np.zeros(top, bool)
    for size in np.unique(sizes)[::-1]:
        left = np.flatnonzero(sizes == size)
        for _ in range(_ROUNDS if size <= 16 and top > 4 * SPAN else 0):
            if not len(left):
                break
            at = random.integers(SPAN, top - SPAN, len(left))
            cells = at[:, None] + symbols[starts[left][:, None] + np.arange(size)]
            free = ~used[cells].any(axis=1)
            some, flat = left[free], cells[free].ravel()
            owner = np.repeat(np.arange(len(some)), size)
            first = np.full(len(flat), False)
            first[np.unique(flat, return_index=True)[1]] = True      # of equal proposals the first one wins the cell
            lost = np.zeros(len(some), bool)
            lost[owner[~first]] = True
            used[flat[~lost[owner]]] = True
            bases[some[~lost]] = at[free][~lost]
            left = left[bases[left] < 0]
        if len(left):
            fresh = top + SPAN * np.arange(len(left))
            used = np.concatenate([used, np.zeros(SPAN * len(left), bool)])
            used[(fresh[:, None] + symbols[starts[left][:, None] + np.arange(size)]).ravel()] = True
            bases[left] = fresh
            top += SPAN * len(left)
    return bases, top


def build(keys: list[bytes]) -> tuple[Trie, np.ndarray]:
    """The trie of distinct, sorted keys and the state in which each ends. An ending state may have children.

    Every level is one pass over all keys. Cells: about two for each state, and 256 for each state with more
    than 16 children, of which there are fewer than a sixteenth of the states."""
    lengths = np.array([len(k) for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(keys) else np.zeros(0, np.int64)
    levels, node, count = [], np.zeros(len(keys), np.int64), 1      # node: number of each key's prefix
    ends = np.zeros(len(keys), np.int64)
    for depth in range(int(lengths.max(initial=0))):
        alive = np.flatnonzero(lengths > depth)
        symbol = flat[at[alive] + depth].astype(np.int64)
        edge = node[alive] * SPAN + symbol
        new = np.concatenate([[True], edge[1:] != edge[:-1]])       # keys are sorted: equal prefixes stand together
        number = count + np.cumsum(new) - 1
        levels.append((node[alive][new], symbol[new], number[new]))
        node[alive] = number
        ends[alive[lengths[alive] == depth + 1]] = number[lengths[alive] == depth + 1]
        count = int(number[-1]) + 1
    if not levels:
        return Trie(np.zeros(SPAN, np.int32), np.full(SPAN, -1, np.int32)), ends
    parent, symbols, child = (np.concatenate([x[i] for x in levels]) for i in range(3))
    order = np.argsort(parent, kind="stable")
    parent, symbols, child = parent[order], symbols[order], child[order]
    owners, starts, sizes = np.unique(parent, return_index=True, return_counts=True)
    bases, top = _place(sizes, starts, symbols, 2 * count + 8 * SPAN, np.random.default_rng(0))
    cell = np.zeros(count, np.int64)                                # of each numbered prefix; the root is cell 0
    cell[child] = np.repeat(bases, sizes) + symbols
    base, check = np.zeros(top + SPAN, np.int32), np.full(top + SPAN, -1, np.int32)
    base[cell[owners]] = bases
    check[cell[child]] = cell[parent]
    return Trie(base, check), cell[ends]
