"""Window packing against the tokenizers library, and the least-squares counts against their optimality conditions."""

import zlib
from collections import Counter

import numpy as np
import pytest
from llm_words import prose
from tokenizers import Tokenizer

from flowlens.llm import nnls, windowpack
from flowlens.llm.vocab import default_path


def _columns(capacity):
    found = []
    for window in windowpack.windows_of(capacity):
        found.append((window, 0, 0))
        found += [(a, window - a, 0) for a in range(-(-window // 2), window)]
        found += [(a, b, window - a - b) for a in range(1, window) for b in range(1, a + 1) if 0 < window - a - b <= b]
    return found


@pytest.mark.parametrize("seed", range(4))
def test_counts_are_least_squares(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(rng.integers(1, 33, 400 if seed % 2 else 25), minlength=33)
    counts = nnls.solve(histogram, windowpack.windows_of(32), rounds=200, sweeps=200)
    left = histogram.astype(float)
    for column, x in counts.items():
        assert x > 0 and sum(column) in windowpack.windows_of(32)
        for length in column:
            left[length] -= x if length else 0
    for column in _columns(32):
        lengths = [x for x in column if x]
        if all(histogram[x] for x in lengths):  # no column, in use or not, could still lower the error
            assert left[lengths].sum() <= 0.05 * len(lengths)
        if counts.get(column, 0) > 0.05:
            assert abs(left[lengths].sum()) <= 0.05 * len(lengths)


def _padding(total, capacity):
    """Tokens that fill a sequence up to the capacity, none at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_everything(seed):
    rng = np.random.default_rng(seed)
    capacity, n = 100 if seed % 2 else 128, (5000, 60, 3)[seed // 2]
    histogram = np.bincount(np.minimum(rng.zipf(1.3, n), capacity), minlength=capacity + 1)
    whole, parts, rest = windowpack.plan(histogram, capacity)
    used, padding = [Counter(), Counter()], 0
    for which, patterns in enumerate((whole, parts)):
        for lengths, times in patterns:
            assert sum(lengths) <= capacity and times > 0
            padding += _padding(sum(lengths), capacity) * times
            for x in lengths:
                used[which][x] += times
    assert padding == 0 or capacity == 100
    assert used[0] == Counter({i: int(x) for i, x in enumerate(histogram - rest) if x})
    assert used[1] == sum((Counter({p: int(x) for p in windowpack.powers(i)}) for i, x in enumerate(rest) if x), Counter())
    assert rest.sum() <= 0.1 * n + 3


def _check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    expected = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in docs)
    by_doc, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= capacity
    whole = Counter()
    for (i, ids), times in expected.items():
        whole[i, len(ids)] += times * len(ids)
        raw = np.array(ids, "<u4").tobytes()
        possible = {(a, n, c) for a, n, c in by_doc[i, len(ids)] if c == zlib.crc32(raw[4 * a : 4 * (a + n)])}
        covered = np.zeros(len(ids), bool)
        for a, n, _ in possible:
            covered[a : a + n] = True
        assert covered.all()
    assert {k: sum(n for _, n, _ in v) for k, v in by_doc.items()} == dict(whole)
    return sum(_padding(sum(n for _, n in x), capacity) for x in sequences.values()), sum(whole.values())


def test_pieces_and_places(odd_docs, no_docs):
    rows = windowpack.pack_windows(odd_docs, capacity=64).collect()
    padding, tokens = _check(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 64)
    assert padding == 0 and tokens
    assert windowpack.pack_windows(no_docs).collect() == []


def test_copies_hold_a_third(spark):
    import random

    rng = random.Random(3)
    docs = [(i, prose(rng, 40) if i % 3 else "the same text in every third row, again and again") for i in range(300)]
    rows = windowpack.pack_windows(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), capacity=256).collect()
    padding, tokens = _check(rows, docs, 256)
    assert padding == 0 and tokens
