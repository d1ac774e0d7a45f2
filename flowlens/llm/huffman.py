"""Canonical length-limited Huffman codes over numpy arrays: code lengths, encoding, table-driven decoding."""

from __future__ import annotations

import numpy as np

#: Symbols between two checkpoints; all stretches of a block are decoded side by side.
STRETCH = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Length of each symbol's code (0: no code) by merging packages; ``limit`` bits at most."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols need codes of more than {limit} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    coins = counts[symbols].astype(np.float64)
    level, packaged = coins, []
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([coins, level[0:even:2] + level[1:even:2]])
        order = np.argsort(both, kind="stable")
        packaged.append(order >= len(coins))
        level = both[order]
    taken = 2 * len(coins) - 2
    for is_package in reversed(packaged):
        packages = int(is_package[:taken].sum())
        lengths[symbols[: taken - packages]] += 1
        taken = 2 * packages
    lengths[symbols[:taken]] += 1
    return lengths


def bits_needed(counts: np.ndarray) -> int:
    """The limit used for an alphabet: small tables, hardly any loss."""
    return max(12, int(np.count_nonzero(counts)).bit_length() + 1)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(sizes[-1])
        steps = np.left_shift(np.int64(1), top - sizes)
        codes[order] = ((np.cumsum(steps) - steps) >> (top - sizes)).astype(np.uint64)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of every STRETCH-th symbol)."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word, inside = start >> 6, start & 63
    over = inside + size - 64
    code = codes[ids]
    here = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(here, first)
    spilled = np.flatnonzero(over > 0)
    words[word[spilled] + 1] |= code[spilled] << (64 - over[spilled]).astype(np.uint64)
    return words.astype(">u8").tobytes(), start[::STRETCH].copy()


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, code length) for every value of the next ``limit`` bits."""
    limit = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    symbols, sizes = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    spread = np.repeat(order, np.left_shift(np.int64(1), limit - lengths[order].astype(np.int64)))
    symbols[: len(spread)] = spread
    sizes[: len(spread)] = lengths[spread]
    return symbols, sizes, limit


def decode(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All n symbols: one step reads the next symbol of every stretch."""
    symbols, sizes, limit = table
    words = np.frombuffer(payload, ">u8").astype(np.uint64)
    at = np.asarray(checkpoints, np.int64).copy()
    out = np.zeros((STRETCH, len(at)), np.uint32)
    last, rest = len(words) - 2, np.uint64(64 - limit)
    for step in range(min(STRETCH, n)):
        word = np.minimum(at >> 6, last)
        inside = (at & 63).astype(np.uint64)
        bits = words[word] << inside | (words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - inside)
        found = (bits >> rest).astype(np.int64)
        out[step] = symbols[found]
        at += sizes[found]
    return out.T.reshape(-1)[:n]
