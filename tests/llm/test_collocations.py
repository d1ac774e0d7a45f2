"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import collocations, doublearray


def _plain(docs, least=30, top=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    rows = []
    for (lang, p), a in candidates.items():
        inside = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p)
                  and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= share * a for b in inside):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    found = set()
    for lang in n:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        found |= {(lang, i, *r[1:]) for i, r in enumerate(own, 1)}
    return found


def _got(df):
    rows = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _docs():
    rng = random.Random(4)
    words = ["the", "of", "a", "New", "york", "CITY", "é", "ÉTÉ", " x", "中文", "don't", "--", "<b>"]
    stock = ["new York city", "the city of", "a b c d e", "é é é é é"]
    docs = []
    for i in range(400):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(stock) for _ in range(rng.randint(0, 30))]
        docs.append((["en", "fr", None][i % 3], "".join(x + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]) for x in parts)))
    return docs + [("en", None), (None, ""), ("empty", " .. \t"), ("long", "the of " * 20_000), ("x", "w" * 5000 + " b " * 40)]


def test_collocations(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "CAST(NULL AS long) AS doc_id", "1 AS a", "'q' AS phrase").repartition(5)
    expected = _plain(docs)
    assert len(expected) > 20 and {r[0] for r in expected} >= {"en", "fr", "und", "long"}
    assert _got(collocations.mine(df)) == expected
    assert _got(collocations.mine(df, least=5, top=7, share=60)) == _plain(docs, 5, 7, 60)


def test_shards_sum_up(spark, monkeypatch):
    """Several tries: the size of a shard is the driver's."""
    docs = _docs()[:150]
    monkeypatch.setattr(collocations, "SHARD", 150)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert _got(collocations.mine(df, least=8)) == _plain(docs, 8)


def test_text_is_read_as_often_whatever_the_number_of_shards(spark, monkeypatch):
    docs = _docs()[:150]
    monkeypatch.setattr(collocations, "SHARD", 50)
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame(docs, "lang string, text string").withColumn("text", F.udf(seen, "string")("text"))
    assert _got(collocations.mine(df, least=8)) == _plain(docs, 8)
    assert read.value == 5 * len(docs)


def test_windows_are_at_most_one_a_word_whatever_passes(spark):
    """So a group of copies gives as many as its words, not pairs of its rows; equal ones are one row."""
    everything = [b"\xff" * (1 << collocations.BITMAP_BITS - 3)] * collocations.LONGEST
    for copies in (30, 300):
        df = spark.createDataFrame([("en", "a b c d e. f g, h")] * copies, "lang string, text string")
        got = {(r["phrase"], r["n"]) for r in collocations.windows(df, everything).collect()}
        assert got == {(x, copies) for x in ("a b c d", "b c d e", "c d e", "d e", "f g")}


def test_odd_rows(odd_docs, no_docs):
    assert _got(collocations.mine(odd_docs, least=3)) == _plain([(r["lang"], r["text"]) for r in odd_docs.collect()], 3)
    assert collocations.mine(no_docs).collect() == []


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("CAST(9000000000000000000 AS long) AS a", "CAST(9000000000000000000 AS long) AS l", "CAST(9000000000000000001 AS long) AS r")
    assert row.select(collocations.score_of().alias("s")).first()["s"] == 2000000 * 9 * 10**18 // (18 * 10**18 + 1)


def test_double_array():
    rng = np.random.default_rng(1)
    phrases = np.unique(np.where(np.arange(4) < rng.integers(1, 5, (3000, 1)), rng.zipf(1.5, (3000, 4)).clip(1, 400), 0), axis=0)
    coded = doublearray.digits(phrases, 400)
    assert coded.shape == (*phrases.shape, 1) and doublearray.digits(np.array([0, 1, 511, 512, 300_000]), 300_000).tolist() == [
        [0, 0, 0], [1, 1, 2], [1, 1, 512], [1, 2, 1], [2, 74, 481]]
    trie = doublearray.build(coded[:, :, 0])
    asked = np.concatenate([coded[:, :, 0], rng.integers(0, 402, (5000, 4))])
    states, found = np.zeros(len(asked), np.int64), np.full(len(asked), -1)
    alive = np.arange(len(asked))
    for depth in range(4):
        going = asked[alive, depth] > 0
        found[alive[~going]] = trie.accept[states[alive[~going]]]
        alive = alive[going]
        states[alive] = trie.advance(states[alive], asked[alive, depth])
        alive = alive[states[alive] >= 0]
    found[alive] = trie.accept[states[alive]]
    numbers = {tuple(x): i for i, x in enumerate(coded[:, :, 0].tolist())}

    def expected(row):
        stop = row.index(0) if 0 in row else 4
        return numbers.get((*row[:stop], *[0] * (4 - stop)), -1) if stop else -1

    assert found.tolist() == [expected(x) for x in asked.tolist()]
