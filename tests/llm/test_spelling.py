"""Spelling variants against a plain search over all pairs of words, and K-d searches against all pairs of counts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import kdtree, spelling


def _edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain(docs, least_length=6, least_n=5, times=5, spoil=199):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: x for w, x in n.items() if len(w) >= least_length and x >= least_n}
    near = {w: [x for x in n if _edit_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


@pytest.fixture(scope="module")
def variant_docs():
    rng = random.Random(5)
    letters = "abcdeéÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(25)]
    words = stems + [w[:i] + rng.choice(letters) + w[i + k :] for w in stems for i in range(0, len(w), 2) for k in (0, 1)]
    words += [w[::-1] for w in stems] + ["aaaaaaab", "baaaaaaa", "x" * 300, "x" * 299 + "y"]
    weights = [rng.choice([1, 3, 30]) for _ in words]
    docs = [(i, "-".join(x.capitalize() if rng.random() < 0.2 else x for x in rng.choices(words, weights, k=60))) for i in range(80)]
    docs.append((500, "chainab " * 6 + "chainabc " * 30 + "chainabcd " * 160))  # a form that has a form itself
    return docs + [(None, "Übername übername ÀBÉDEF"), (7, None), (8, ""), (9, " 12 中文aaaaaab“bb”")] * 3


def test_variants(spark, variant_docs):
    df = spark.createDataFrame(variant_docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'q' AS word", "2 AS form").repartition(4)
    got = _rows(spelling.group_variants(df))
    assert len(got) == len(set(got))
    assert set(got) == _plain(variant_docs)
    assert any(form for _, form, *_ in got) and any(root not in (word, form) for word, form, root, *_ in got)


def test_many_boxes_and_slices(spark, variant_docs):
    """Boxes of a few words, so that searches cross many of them; slices where a box can't be divided."""
    df = spark.createDataFrame(variant_docs, "doc_id long, text string")
    words = spelling.count_words(df, 6, 199, "doc_id", "text").filter("n >= 5").cache()
    known = [r["word"] for r in words.collect()]
    pairs = {(a, b) for a in known for b in known if _edit_one(a, b)}
    for in_box in (2, 40):
        near = [(r["word"], r["near"]) for r in spelling.near_words(words, len(known), sample=100, in_box=in_box).collect()]
        assert len(near) == len(set(near)) and set(near) == pairs


def test_odd_rows(odd_docs, no_docs):
    assert set(_rows(spelling.group_variants(odd_docs, least_n=2))) == _plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()], least_n=2)
    assert spelling.group_variants(no_docs).collect() == []


def test_searches_meet_each_pair_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(600)})
    points = kdtree.vectors([w.encode() for w in words])
    met = Counter()
    for longer in (False, True):
        for i, j in kdtree.candidates(points, kdtree.Searches(points, longer), bucket=4):
            met.update(zip(i.tolist(), j.tolist()))
    assert set(met.values()) == {1}
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            apart = np.abs(points[i, :-1] - points[j, :-1]).sum()
            expected = apart == 2 if len(a) == len(b) else apart == 1 and abs(len(a) - len(b)) == 1
            assert ((i, j) in met) + ((j, i) in met) == expected
            assert not _edit_one(a, b) or expected
            if expected:
                x, y = (a, b) if (len(a), i) < (len(b), j) else (b, a)
                codes = kdtree.code_points([x]), kdtree.code_points([y])
                assert bool(kdtree.one_edit_apart(*codes)[0]) == kdtree.one_edit(x, y) == _edit_one(a, b)
