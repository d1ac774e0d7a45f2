"""What a worker of the LM scores holds: the most frequent words, and events that it adds up."""

import pickle
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from flowlens.llm import common, ppm


def word_head(words):
    return ppm.WordHead(pa.array(words, pa.binary()), np.ones(len(words), np.int64), np.zeros(len(words)))


def test_parts_of_events_are_added_up(monkeypatch):
    monkeypatch.setattr(ppm, "RANGE", 3)
    rng = np.random.default_rng(4)
    parts, expected = [], Counter()
    for size in (1, 40, 7, 100):
        events = np.unique(rng.integers(0, 120, size).astype(np.uint64))
        c = rng.integers(0, 5, len(events))
        parts.append((events, c))
        for e, n in zip(events.tolist(), c.tolist(), strict=True):
            expected[e] += n
    events, c = ppm.add_up(parts)
    assert not parts and events.tolist() == sorted(expected) and dict(zip(events.tolist(), c.tolist(), strict=True)) == expected


def test_adding_up_holds_the_parts_and_the_sums():
    rng = np.random.default_rng(5)
    parts = [(e := np.unique(rng.integers(0, 1 << 48, 100_000).astype(np.uint64)), np.ones(len(e), np.int64)) for _ in range(10)]
    size = sum(e.nbytes + c.nbytes for e, c in parts)
    tracemalloc.start()
    ppm.add_up(parts)
    more = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert more < 2.2 * size  # 3.6 times the size by np.unique with its inverse


def test_head_words_are_compared_not_only_their_hashes(monkeypatch):
    words = [b"the", b"", b"\xc3\xa9t", b"then"] + [b"w%d" % i for i in range(300)]
    asked = [b"then", b"no", b"w299", b"", b"\xc3\xa9t"]
    assert word_head(words).places(pa.array(asked, pa.binary())).tolist() == [3, -1, 303, 1, 2]
    assert word_head([]).places(pa.array(asked, pa.binary())).tolist() == [-1] * 5
    monkeypatch.setattr(ppm, "hashes", lambda words: np.array([len(x) for x in words.to_pylist()], np.uint64))
    found = word_head(words).places(pa.array([*words, b"no"], pa.binary()))
    assert found[-1] == -1 and all(at in (-1, i) for i, at in enumerate(found[:-1])) and found[1] == 1


def test_most_frequent_words_take_a_worker_little_memory():
    words = [b"word%d" % i for i in range(1 << 17)]
    sent = pickle.dumps(word_head(words))
    tracemalloc.start()
    head = pickle.loads(sent)
    assert head.places(pa.array(words[7:10], pa.binary())).tolist() == [7, 8, 9]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 64 * len(words)


def test_pieces_are_whole_batches_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a" * 5, None, "é" * 4, "", "x" * 40, "b", "c", None, "d" * 9])], ["doc_id", "text"])
    for size in (1, 8, 1000):
        parts = list(common.pieces(batch, size))
        assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([batch]))
        assert [(p.column("doc_id")[0].as_py(), p.column("doc_id")[-1].as_py() + 1) for p in parts] == list(common.chunks(common.texts_of(batch), size))
    assert list(common.pieces(batch.slice(0, 0))) == []
