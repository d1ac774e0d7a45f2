"""Spelling variants: words one edit apart, found in K-d trees over letter counts.

Words are counted in tasks and summed up. A tree fitted on a bounded sample of the distinct words divides the space of
letter counts into boxes; every word is filed in its box, and its searches go to the boxes that a word one edit away can
lie in. A box is a group of its own for one task, divided further there; boxes that hold more than ``in_box`` words are
filed in slices, each searched by all that come, so no group grows without bound.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import kdtree
from flowlens.llm.common import text_rows, texts_of
from flowlens.operators.graph import follow_pointers
from flowlens.session import cut, cut_counted

#: Letters of the contract in UTF-8, A-Z lower-cased before.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: A text without the lead bytes of other characters is split at whatever is blank in this table.
OTHER_LEADS = re.compile(rb"[\xc0-\xc2\xc4-\xff]")
LETTERS_ONLY = bytes(x if x >= 128 else ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in range(256))
HELD_WORDS, HELD_BYTES = 400_000, 32 << 20
MOST_BOXES = 4096
QUERIES_AT_ONCE = 8192


def count_words(docs: DataFrame, least_length: int, spoil: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of all runs of at least ``least_length`` code points, one in ``spoil`` of a document's distinct runs with a
    code point left out."""

    def count(batches):
        total: Counter[bytes] = Counter()
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                found = RUNS.findall(text.lower()) if OTHER_LEADS.search(text) else text.translate(LETTERS_ONLY).split()
                runs = [x for x in found if len(x) >= least_length]
                for i in [i for i, x in enumerate(runs) if not zlib.crc32(x, start) % spoil] if spoil else ():
                    word = runs[i].decode()
                    at = zlib.crc32(runs[i], start) % len(word)
                    runs[i] = (word[:at] + word[at + 1 :]).encode()
                total.update(runs)
                held += len(text)
                if len(total) > HELD_WORDS or held > HELD_BYTES:
                    yield _counted(total, least_length)
                    total, held = Counter(), 0
        yield _counted(total, least_length)

    return text_rows(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter[bytes], least_length: int) -> pa.RecordBatch:
    long = [(x, n) for x, n in total.items() if len(x) - x.count(0xC3) >= least_length]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in long], pa.binary()).cast(pa.string()), pa.array([n for _, n in long], pa.int64())],
                                      ["word", "n"])


def near_words(words: DataFrame, n_words: int, sample: int = 65_536, in_box: int = 1024) -> DataFrame:
    """(word, near, near_n): a row for each word and each word one edit away, from (word, n) with distinct words.

    The tree is fitted on about ``sample`` words, chosen by hash; all words are filed and searched for. Words are of the
    letters a-z and U+00C0-U+00FF.
    """
    share = max(1, n_words // sample)
    known = [r["word"].encode() for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").collect()]
    tree, boxes = kdtree.build(kdtree.vectors(known), max(1, min(MOST_BOXES, n_words // in_box))) if known else (("leaf", 0), 1)

    def file(batches):
        for batch in batches:
            found = texts_of(batch, "word")
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(kdtree.assign(tree, kdtree.vectors(found)))],
                                             ["word", "n", "box"])

    filed = cut(words.select("word", "n").mapInArrow(file, "word string, n long, box int"))
    sizes = {r["box"]: r["n"] for r in filed.groupBy("box").agg(F.count("*").alias("n")).collect()}  # a row for each box
    slices = np.array([-(-sizes.get(box, 1) // (4 * in_box)) for box in range(boxes)], np.int32)

    def send(batches):
        """Rows (box, slice, kind, word, n): kind 0 is filed there, 1 searches words of its own length, 2 of the next."""
        for batch in batches:
            found = texts_of(batch, "word")
            points = kdtree.vectors(found)
            own = batch.column("box").to_numpy()
            mixed = np.fromiter(map(zlib.crc32, found), np.int64, len(found))
            rows, box, part, kind = [np.arange(len(found))], [own], [mixed % slices[own]], [np.zeros(len(found), np.int8)]
            for longer in (False, True):
                for leaf, some in kdtree.visit(tree, kdtree.Searches(points, longer)):
                    for each in range(slices[leaf]):
                        rows.append(some)
                        box.append(np.full(len(some), leaf))
                        part.append(np.full(len(some), each))
                        kind.append(np.full(len(some), 1 + longer, np.int8))
            rows, box, part, kind = map(np.concatenate, (rows, box, part, kind))
            for a in range(0, len(rows), 100_000):
                at = pa.array(rows[a : a + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(box[a : a + 100_000], pa.int32()), pa.array(part[a : a + 100_000], pa.int32()), pa.array(kind[a : a + 100_000], pa.int8()),
                     batch.column("word").take(at), batch.column("n").take(at)], ["box", "slice", "kind", "word", "n"])

    sent = filed.mapInArrow(send, "box int, slice int, kind tinyint, word string, n long")
    dealt = sent.repartition("box", "slice").sortWithinPartitions("box", "slice", "kind")
    return dealt.mapInArrow(_search, "word string, near string, near_n long")


def _search(batches):
    """Rows come by box and slice, those filed there before those that search. Each pair gives a row for either word."""
    group, filed, filed_n, waiting, known = None, [], [], [], []

    def flush(kind: int):
        if not waiting or not filed:
            return
        if not known:
            known.extend((kdtree.vectors([x.encode() for x in filed]), np.array(filed, object), np.array(filed_n, np.int64)))
        points, there, there_n = known
        words, words_n = [x for x, _ in waiting], np.array([n for _, n in waiting], np.int64)
        here = np.array(words, object)
        short = max(map(len, filed)) <= kdtree.WIDEST and max(map(len, words)) <= kdtree.WIDEST
        codes = (kdtree.code_points(words), kdtree.code_points(filed)) if short else None
        for i, j in kdtree.candidates(points, kdtree.Searches(kdtree.vectors([x.encode() for x in words]), kind == 2)):
            for a in range(0, len(i), 65_536):
                some_i, some_j = i[a : a + 65_536], j[a : a + 65_536]
                near = kdtree.one_edit_apart(codes[0][some_i], codes[1][some_j]) if short else \
                    np.array([kdtree.one_edit(words[x], filed[y]) for x, y in zip(some_i.tolist(), some_j.tolist(), strict=True)], bool)
                some_i, some_j = some_i[near], some_j[near]
                if len(some_i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([here[some_i], there[some_j]]), pa.string()),
                         pa.array(np.concatenate([there[some_j], here[some_i]]), pa.string()),
                         pa.array(np.concatenate([there_n[some_j], words_n[some_i]]))], ["word", "near", "near_n"])

    now = 0
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("box", "slice", "kind")), strict=True))
        for (box, part, kind), word, n in zip(keys, batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if (box, part) != group or kind != now or len(waiting) >= QUERIES_AT_ONCE:
                yield from flush(now)
                waiting = []
                now = kind
                if (box, part) != group:
                    group, filed, filed_n, known = (box, part), [], [], []
            if kind == 0:
                filed.append(word)
                filed_n.append(n)
            else:
                waiting.append((word, n))
    yield from flush(now)


def group_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5, spoil: int = 199, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of enough code points and occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z lower-cased; ``spoil`` (0: none) leaves a code point out of one
    in so many. A word's form is its near word of largest n, the least in code-point order among equals, if that n is at
    least ``times`` the word's; forms have more occurrences each, so following them ends. A null text holds no words; a null
    id counts as an empty one; repeated rows count each; words of any length take part; other columns are left aside; an
    empty table gives no rows.
    """
    words, n_words = cut_counted(count_words(docs, least_length, spoil, id_col, text_col).filter(F.col("n") >= least_n))
    near = near_words(words, n_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    formed = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    pointers = formed.select("word", F.when(F.col("form").isNotNull(), F.struct(F.col("form").alias("word"))).alias("to"))
    roots, _ = follow_pointers(pointers, ["word"], "to")
    return formed.join(roots.select("word", F.col("root.word").alias("root")), "word").select("word", "form", "root", "n", "n_near", "form_n")
