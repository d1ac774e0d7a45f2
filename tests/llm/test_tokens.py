"""Token counts, token files and packing against the tokenizers library used directly."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowlens.llm import huffman, packing, tokencount, tokenfile
from flowlens.llm.vocab import count_all, default_path, encode_all


def ids_of(name, text):
    return Tokenizer.from_file(default_path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_like_whole_texts(name):
    rng = random.Random(1)
    letters = "ab é́Σσ 'sTt1 2\n\t\x0b\x85  .,!<|endoftext|>中ßİ"
    runs = ["\0", " \0 ", "<|endoftext|>", "'s", "'ll", "́", "Σ", "ΑΣ", "\x1c", "\n", "\n\n", " foo", "bar\nbaz"]
    texts = ["".join(rng.choice(runs) if rng.random() < 0.2 else rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    expected = [e.ids for e in Tokenizer.from_file(default_path(name)).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode_all(texts, default_path(name))] == expected
    assert count_all(texts, default_path(name)) == [len(x) for x in expected]


def test_token_counts(odd_docs, no_docs):
    rows = tokencount.count_tokens(odd_docs).collect()
    expected = Counter((r["doc_id"], len((r["text"] or "").encode()), len(ids_of("word_bpe_49k.json", r["text"]))) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows) and any(r["over_limit"] for r in rows)
    assert tokencount.count_tokens(no_docs).collect() == []


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.2, 50_000)
    ids = ids[ids < 5000]
    for part in (ids, ids[:1], ids[:127], ids[:128], ids[:129], np.zeros(300, np.int64)):
        counts = np.bincount(part)
        for limit in (huffman.bits_needed(counts), max(2, int(np.count_nonzero(counts)).bit_length())):
            lengths = huffman.code_lengths(counts, limit)
            assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
            payload, checkpoints = huffman.encode(part, lengths, huffman.canonical(lengths))
            assert (huffman.decode(payload, checkpoints, len(part), huffman.decode_table(lengths)) == part).all()


def test_code_lengths_are_those_of_huffman():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13])
    assert huffman.code_lengths(counts, 12).tolist() == [0, 6, 6, 5, 4, 3, 2, 1]
    assert huffman.code_lengths(counts, 3).max() == 3


def test_token_file(spark, odd_docs, no_docs, tmp_path):
    tokenfile.write_tokens(odd_docs, str(tmp_path / "a"))
    back = sorted(tokenfile.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    docs = [(r["doc_id"], [*ids_of("word_bpe_49k.json", r["text"]), 1]) for r in odd_docs.collect()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in back) == sorted((i is not None, i or 0, x) for i, x in docs)
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in back]
    assert order == sorted(order)
    assert [r["start"] for r in back] == np.cumsum([0] + [r["n_tokens"] for r in back[:-1]]).tolist()
    digests = {(r["start"], r["ids_crc32"]) for r in tokenfile.read_tokens(spark, str(tmp_path / "a"), digest=True).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back}
    blocks = spark.read.parquet(str(tmp_path / "a" / "blocks")).collect()
    size = sum(len(b["payload"]) for b in blocks)
    assert size < sum(r["n_tokens"] for r in back) * 2
    assert tokenfile.token_digests(no_docs).collect() == []


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=64).collect()
    docs = Counter(((r["doc_id"]), tuple([*ids_of("byte_bpe_50k.json", r["text"]), 0])) for r in odd_docs.collect())
    sequences, found = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= 64
    expected = Counter()
    for (doc_id, ids), times in docs.items():
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += times
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    assert packing.pack(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_everything_and_fill_gaps(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, capacity + 1, 5000 if seed % 2 else 40), return_counts=True))}
    plan = packing.plan_patterns(histogram, capacity)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= capacity and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(histogram)
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    assert sum(times for _, times in plan) <= least * (1.02 if seed % 2 else 1.35) + 1


def test_exact_complements_are_taken():
    assert sum(n for _, n in packing.plan_patterns({60: 5, 40: 5, 50: 2, 30: 1, 20: 1}, 100)) == 7
    assert sum(n for _, n in packing.plan_patterns({70: 2, 20: 2, 10: 2, 5: 0}, 100)) == 2
