"""K-d trees over letter counts, and range searches for words one edit away.

One inserted code point adds one to one count; one replaced adds one to one count and takes one from another. So a search
for words of a given length goes down with what it has used so far: the raised count, the lowered count, or neither yet.
A branch is pruned when no target can lie in its box. All words of a block go down together.
"""

from __future__ import annotations

import numpy as np

#: a-z, then the 64 code points from U+00C0.
LETTERS = 26 + 64
LENGTH = LETTERS  # column of the length
LARGEST = 30_000
NONE, CLOSED = -1, -2  # a change that is still open, and one that does not take place

Tree = tuple  # ("leaf", number) or ("split", dimension, threshold, tree of counts up to it, tree of larger counts)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts and length of each word; counts over 30,000 are taken as 30,000."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), lengths)
    lead = data == 0xC3
    of = np.where(data < 0x80, data.astype(np.int64) - 97, data.astype(np.int64) - 0x80 + 26)
    counts = np.bincount((row * (LETTERS + 1) + of)[~lead], minlength=len(words) * (LETTERS + 1)).reshape(-1, LETTERS + 1)
    counts[:, LENGTH] = counts.sum(1)
    return np.minimum(counts, LARGEST).astype(np.int16)


def best_split(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension and threshold that divide most evenly, or None where all points are alike."""
    n, best, found = len(points), 0, None
    for t in (0, 1, 2):
        below = np.count_nonzero(points <= t, axis=0)
        evenness = np.minimum(below, n - below)
        at = int(np.argmax(evenness))
        if evenness[at] > best:
            best, found = int(evenness[at]), (at, t)
    if best < n // 4:  # lengths, and counts that are all larger
        low, high = points.min(0), points.max(0)
        for at in {LENGTH, int(np.argmax(high - low))}:
            t = min(int(np.median(points[:, at])), int(high[at]) - 1)
            below = np.count_nonzero(points[:, at] <= t)
            if min(below, n - below) > best:
                best, found = min(below, n - below), (at, t)
    return found


def build(points: np.ndarray, leaves: int) -> tuple[Tree, int]:
    """A tree of about so many leaves of like size, and its number of leaves."""
    number = [0]

    def grow(some: np.ndarray, share: int) -> Tree:
        split = best_split(some) if share > 1 and len(some) > 1 else None
        if split is None:
            number[0] += 1
            return ("leaf", number[0] - 1)
        below = some[:, split[0]] <= split[1]
        part = min(share - 1, max(1, round(share * below.mean())))
        return ("split", *split, grow(some[below], part), grow(some[~below], share - part))

    return grow(points, leaves), number[0]


def assign(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Leaf of each point."""
    leaf = np.zeros(len(points), np.int32)

    def down(node: Tree, rows: np.ndarray) -> None:
        if node[0] == "leaf":
            leaf[rows] = node[1]
        elif len(rows):
            below = points[rows, node[1]] <= node[2]
            down(node[3], rows[below])
            down(node[4], rows[~below])

    down(tree, np.arange(len(points)))
    return leaf


class Searches:
    """Words on their way down: row, target length, raised and lowered dimension (NONE: still open, CLOSED: no such change)."""

    def __init__(self, points: np.ndarray, longer: bool, rows=None, up=None, down=None):
        self.points, self.longer = points, longer
        self.rows = np.arange(len(points)) if rows is None else rows
        self.up = np.full(len(self.rows), NONE, np.int16) if up is None else up
        self.down = np.full(len(self.rows), CLOSED if longer else NONE, np.int16) if down is None else down

    def of(self, keep: np.ndarray, up: np.ndarray | None = None, down: np.ndarray | None = None) -> Searches:
        return Searches(self.points, self.longer, self.rows[keep], (self.up if up is None else up)[keep],
                        (self.down if down is None else down)[keep])

    def branch(self, dimension: int, threshold: int) -> tuple[Searches, Searches]:
        """Those that go to counts up to the threshold, and to larger ones. The raised letter comes after the lowered one in
        the order of letters, so each pair of words of equal length is met from one side only."""
        value = self.points[self.rows, dimension].astype(np.int32)
        if dimension == LENGTH:
            below = value + self.longer <= threshold
            return self.of(below), self.of(~below)
        value = value + (self.up == dimension) - (self.down == dimension)
        free = (self.up != dimension) & (self.down != dimension)
        below = value <= threshold
        rises = free & (self.up == NONE) & (value == threshold) & ((self.down < 0) | (self.down < dimension))
        falls = free & (self.down == NONE) & (value == threshold + 1) & ((self.up < 0) | (self.up > dimension))
        there = np.full_like(self.up, dimension)
        return _both(self.of(below), self.of(falls, down=there)), _both(self.of(~below), self.of(rises, up=there))


def _both(a: Searches, b: Searches) -> Searches:
    if not len(b.rows):
        return a
    return Searches(a.points, a.longer, *(np.concatenate([getattr(a, x), getattr(b, x)]) for x in ("rows", "up", "down")))


def visit(tree: Tree, searches: Searches):
    """(leaf, rows that search it)."""
    if not len(searches.rows):
        return
    if tree[0] == "leaf":
        yield tree[1], searches.rows
        return
    low, high = searches.branch(tree[1], tree[2])
    yield from visit(tree[3], low)
    yield from visit(tree[4], high)


def candidates(points: np.ndarray, searches: Searches, bucket: int = 64):
    """(rows that search, rows of ``points``) whose counts are those of one edit; points are split as searches go down.

    Whole numbers differ by one in one place, or by one in two, where their squared distance is 1 or 2.
    """
    here, there = points[:, :LETTERS].astype(float), searches.points[:, :LETTERS].astype(float)
    here_square, there_square = (here**2).sum(1), (there**2).sum(1)
    distance, longer = 1 if searches.longer else 2, int(searches.longer)

    def down(some: np.ndarray, on_way: Searches):
        if not len(on_way.rows) or not len(some):
            return
        split = best_split(points[some]) if len(some) > bucket else None
        if split is None:
            for a in range(0, len(on_way.rows), 4096):
                for b in range(0, len(some), 256):
                    yield from alike(on_way.rows[a : a + 4096], some[b : b + 256])
            return
        below = points[some, split[0]] <= split[1]
        low, high = on_way.branch(*split)
        yield from down(some[below], low)
        yield from down(some[~below], high)

    def alike(rows: np.ndarray, some: np.ndarray):
        apart = there_square[rows][:, None] + here_square[some][None, :] - 2 * (there[rows] @ here[some].T)
        i, j = np.nonzero(apart == distance)
        i, j = rows[i], some[j]
        right = points[j, LENGTH] - searches.points[i, LENGTH] == longer
        i, j = i[right], j[right]
        if len(i) and not longer:  # the raised letter after the lowered one
            change = points[j, :LETTERS] - searches.points[i, :LETTERS]
            right = change.argmax(1) > change.argmin(1)
            i, j = i[right], j[right]
        if len(i):
            yield i, j

    yield from down(np.arange(len(points)), searches)


#: Words up to this length are compared in numpy.
WIDEST = 128


def code_points(words: list[str]) -> np.ndarray:
    """Code points of each word in a row, zeros behind."""
    width = max(map(len, words), default=0) + 2
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def one_edit_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, exactly one code point replaced, or one inserted into ``a``'s; zeros behind the words."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    differs = a != b
    replaced = differs.sum(1) == 1
    first = differs.argmax(1)
    behind = (a[:, :-1] != b[:, 1:]) & (np.arange(width - 1) >= first[:, None])
    longer = (b != 0).sum(1) == (a != 0).sum(1) + 1
    return np.where(longer, ~behind.any(1), replaced & ((a != 0).sum(1) == (b != 0).sum(1)))


def one_edit(a: str, b: str) -> bool:
    """The same for two words of any length."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])
