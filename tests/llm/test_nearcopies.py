"""Near copies against brute-force Jaccard similarities of five-word shingles."""

import random

import numpy as np
import pytest

from flowlens.llm import nearcopies
from llm_words import prose


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def groups_by_hand(texts):
    """Group number of each text: components of similarities of 0.8 or more."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for k in range(i):
            if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k]) and group[i] != group[k]:
                group = [group[k] if g == group[i] else g for g in group]
    return group


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = prose(rng, 1) + "!"
    return " ".join(words)


def test_keep_one_of_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    kept = nearcopies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = sorted({r["text"] or "" for r in rows})
    assert kept.count() == len(set(groups_by_hand(texts)))
    assert nearcopies.keep_one(no_docs).collect() == []


@pytest.mark.parametrize("leaf", [1024, 8])
def test_keep_one_of_groups_of_near_copies(spark, leaf):
    rng = random.Random(leaf)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(60)]
    bases = [prose(rng, 400) for _ in range(4)]
    texts += [edited(rng, b, rng.choice([0.01, 0.02, 0.08])) for b in bases for _ in range(40)] + [b.upper() for b in bases]
    texts += texts[:20] * 3
    rng.shuffle(texts)
    group = groups_by_hand(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in nearcopies.keep_one(docs, leaf=leaf).collect()}
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    # no two groups are ever merged; a link of just 0.8 may be missed
    assert set(least.values()) <= kept
    assert len(kept) - len(least) <= 0.02 * len(texts)


def test_small_nodes_take_no_join(spark):
    """A row is in one node of each trie, so nodes need no join to find their rows."""
    rng = np.random.default_rng(3)
    words = rng.integers(-(1 << 63), 1 << 63, (300, nearcopies.WORDS))
    words[1] = words[0]
    words[1, 0] ^= 1
    nodes = spark.createDataFrame([(i, [int(x) for x in w]) for i, w in enumerate(words)], "set_key long, words array<long>")
    met = nearcopies._met(nodes, 1024)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # equal fingerprints
    assert {tuple(sorted(r)) for r in met.collect()} == {(0, 1)}


def test_spanning_forest():
    rng = np.random.default_rng(1)
    u, v = np.triu_indices(40, 1)
    near = rng.random(len(u)) < 0.1
    u, v, apart = u[near], v[near], rng.integers(0, 5, near.sum())
    got = set(zip(*(x.tolist() for x in nearcopies.spanning(40, u, v, apart)), strict=True))
    label, expected = list(range(40)), set()
    for _, a, b in sorted(zip(apart.tolist(), u.tolist(), v.tolist(), strict=True)):
        if label[a] != label[b]:
            expected.add((a, b))
            label = [label[b] if x == label[a] else x for x in label]
    assert got == expected
