"""Double-array tries over numbered symbols: a step is one addition and one comparison, for all positions of a text at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Children of one node lie within so many places; larger symbols are written as several digits.
RADIX = 512
#: A node with several children looks for room in so many of the last places before it goes behind all others.
LOOKED_AT = 4096


@dataclass
class DoubleArray:
    """A child of node s by symbol c stands at base[s] + c where check there is s; accept is a phrase's number or -1."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """State behind each symbol, -1 where there is none; symbol 0 is none."""
        to = self.base[states] + symbols
        there = (symbols > 0) & (to >= 0) & (to < len(self.check))
        to = np.where(there, to, 0)
        return np.where(there & (self.check[to] == states), to, -1)


def digits(numbers: np.ndarray, largest: int) -> np.ndarray:
    """Numbers of at least 1 as symbols of at least 1 and at most RADIX along a new last axis; 0 gives zeros."""
    shifts = [RADIX**i for i in range(len(np.base_repr(max(largest, 1), 32)))]
    shifts = [x for x in shifts if x <= max(largest, 1)][::-1]
    return np.where(numbers[..., None] > 0, numbers[..., None] // np.array(shifts) % RADIX + 1, 0)


def build(phrases: np.ndarray) -> DoubleArray:
    """From distinct rows of symbols of at least 1, zeros behind the shorter ones; row i is accepted as i.

    Level by level, the nodes of a level by falling number of children; a node with one child takes the next free place.
    """
    size = 1 << max(10, (4 * len(phrases)).bit_length())
    base, check, accept = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    check[0] = -2  # the root
    top = 1  # no place at or behind it is taken

    def room(upto: int) -> None:
        nonlocal base, check, accept
        while upto > len(check):
            base, check, accept = (np.concatenate([x, np.full(len(x), fill, np.int64)]) for x, fill in ((base, 0), (check, -1), (accept, -1)))

    parents = np.zeros(len(phrases), np.int64)  # node of each row so far
    rows = np.arange(len(phrases))
    for depth in range(phrases.shape[1]):
        going = phrases[rows, depth] > 0
        rows, parents = rows[going], parents[going]
        if not len(rows):
            break
        pairs, child_of = np.unique(np.stack([parents, phrases[rows, depth]]), axis=1, return_inverse=True)
        child_of = child_of.ravel()
        node, symbol = pairs
        firsts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.concatenate([firsts, [len(node)]]))
        at = np.zeros(len(node), np.int64)
        order = np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]
        for i, n in zip(firsts[order].tolist(), sizes[order].tolist(), strict=True):
            children = symbol[i : i + n]
            behind = max(0, top - LOOKED_AT)
            starts = np.flatnonzero(check[behind:top] == -1)[:: max(1, n // 8)] + behind - children[0]
            room(top + int(children[-1]) + 1)
            clash = (check[np.maximum(starts[:, None] + children[None, :], 0)] != -1).any(1) if len(starts) else np.ones(1, bool)
            start = int(starts[np.argmin(clash)]) if not clash.all() else top - int(children[0])
            places = start + children
            base[node[i]], check[places], at[i : i + n] = start, node[i], places
            top = max(top, int(places[-1]) + 1)
        single = firsts[sizes == 1]
        if len(single):
            free = np.flatnonzero(check[:top] == -1)
            free = free[-len(single) :]
            more = len(single) - len(free)
            room(top + more)
            places = np.concatenate([free, np.arange(top, top + more)])
            base[node[single]], check[places], at[single] = places - symbol[single], node[single], places
            top += more
        parents = at[child_of]
        last = np.ones(len(rows), bool) if depth + 1 == phrases.shape[1] else phrases[rows, depth + 1] == 0
        accept[parents[last]] = rows[last]
    return DoubleArray(base[:top].copy(), check[:top].copy(), accept[:top].copy())
