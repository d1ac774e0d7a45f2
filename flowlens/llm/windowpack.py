"""Packing by non-negative least squares: shallow combinations of lengths fill a window, residuals are packed greedily.

A sequence costs no padding where its length is the capacity or a power of two, so these are the windows. Only lengths
decide the packing, and there are at most ``capacity`` of them: the plan is made from the histogram of all lengths, on the
driver, and pieces take their places by their rank among those of equal length. What no combination takes is cut into
powers of two, which fill windows by size; pieces carry the checksums of these parts, so the text is encoded once. There
is no padding then where the capacity is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import nnls
from flowlens.llm.common import ENCODE_BYTES, chunks, text_rows, texts_of
from flowlens.llm.packing import places
from flowlens.llm.vocab import default_path, encode_ids
from flowlens.session import cut

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<long>, task long, nth long"
Patterns = list[tuple[tuple[int, ...], int]]


def windows_of(capacity: int) -> list[int]:
    """Lengths without padding, largest first."""
    return sorted({capacity, *(1 << i for i in range(capacity.bit_length()))}, reverse=True)


def powers(total: int) -> list[int]:
    """The powers of two that add up to ``total``, largest first."""
    return [1 << i for i in range(total.bit_length() - 1, -1, -1) if total >> i & 1]


def plan(histogram: np.ndarray, capacity: int) -> tuple[Patterns, Patterns, np.ndarray]:
    """Patterns (lengths of one sequence, number of such sequences) of whole pieces, those of the powers of two that the rest
    is cut into, and how many pieces of each length are that rest.

    Counts of the solution are rounded, most used combinations first, and bounded by what is there. Then greedily: the
    combinations in use take what rounding left, and those that the rest offers are taken until it offers none.
    """
    left = histogram.astype(np.int64)
    patterns: Patterns = []

    def use(column: nnls.Column, most: int | None = None) -> bool:
        lengths = tuple(x for x in column if x)
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        times = times if most is None else min(times, most)
        if times > 0:
            patterns.append((lengths, times))
            for x in lengths:
                left[x] -= times
        return times > 0

    solved = sorted(nnls.solve(histogram, windows_of(capacity)).items(), key=lambda x: (-x[1], x[0]))
    for column, x in solved:
        use(column, int(x + 0.5))
    for column, _ in solved:
        use(column)
    for window in windows_of(capacity):
        while any([use(column) for column in nnls.price(left.astype(float), left > 0, window)]):
            pass
    fill = np.zeros(capacity + 1, np.int64)
    for length in np.flatnonzero(left).tolist():
        for x in powers(length):
            fill[x] += left[length]
    return patterns, _by_size(fill, capacity), left


def _by_size(fill: np.ndarray, capacity: int) -> Patterns:
    """Powers of two in falling order: each window is filled exactly, but for the last where the capacity is no power of two."""
    done: Patterns = []
    sizes = [int(x) for x in np.flatnonzero(fill)[::-1]]
    for window in windows_of(capacity):
        while sizes and sum(x * int(fill[x]) for x in sizes) >= window:
            lengths, gap = [], window
            for x in sizes:
                n = min(gap // x, int(fill[x]))
                lengths += [x] * n
                gap -= n * x
            if gap or not lengths:
                break
            times = min(int(fill[x]) // lengths.count(x) for x in set(lengths))
            for x in lengths:
                fill[x] -= times
            done.append((tuple(lengths), times))
            sizes = [x for x in sizes if fill[x]]
    return done + [((x,), int(fill[x])) for x in sizes]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece, with its task and how many pieces of its length came before it in that task."""

    def split(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in chunks(texts, ENCODE_BYTES):
                ids, at = encode_ids(texts[a:b], vocabulary)
                raw, rows = ids.tobytes(), []
                for doc_id, first, last in zip(doc_ids[a:b], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    coded = raw[4 * first : 4 * last] + end
                    n = last - first + 1
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        sizes = powers(length)
                        ends = [start + sum(sizes[: i + 1]) for i in range(len(sizes))]
                        crcs = [zlib.crc32(coded[4 * (e - size) : 4 * e]) for e, size in zip(ends, sizes, strict=True)]
                        whole = crcs[0] if len(crcs) == 1 else zlib.crc32(coded[4 * start : 4 * (start + length)])
                        rows.append((doc_id, start, length, whole, n, crcs, task, int(seen[length])))
                        seen[length] += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "task", "nth"])

    return text_rows(docs, id_col, text_col).mapInArrow(split, PIECES)


class Places:
    """Sequence and offset of the piece of a given length and rank."""

    def __init__(self, patterns: Patterns, first_sequence: int):
        self.table = places(patterns)
        self.keys = self.table["length"] << 40 | self.table["first"]
        self.first_sequence = first_sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(rank):
            return rank, rank
        at = np.searchsorted(self.keys, length << 40 | rank, "right") - 1
        return self.first_sequence + self.table["sequence"][at] + rank - self.table["first"][at], self.table["offset"][at]


def pack_windows(docs: DataFrame, vocabulary: str | None = None, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    A document is the ids of its text and ``end_id``. Longer ones than ``capacity`` give whole windows first and then the
    rest; rests that no combination takes are cut into powers of two. A null or empty text is one piece of length 1; a null
    id stays null; repeated rows are packed each; pieces of equal length are interchangeable until they are written; other
    columns are left aside; an empty table gives no rows.
    """
    written = cut(pieces(docs, vocabulary or default_path("word_bpe_49k.json"), capacity, end_id, id_col, text_col))
    of_task = written.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = of_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in written.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row for each length at most
        histogram[r["length"]] = r["n"]
    patterns, of_parts, rest = plan(histogram, capacity)
    whole, parts = Places(patterns, 0), Places(of_parts, sum(times for _, times in patterns))
    kept = histogram - rest  # pieces of each length that stay whole: those of lowest rank
    #: parts of size 2**bit that shorter pieces of the rest give
    earlier = [np.cumsum(np.where(np.arange(capacity + 1) >> bit & 1, rest, 0)) for bit in range(capacity.bit_length())]
    earlier = [np.concatenate([[0], x[:-1]]) for x in earlier]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            stays = rank < kept[length]
            at = pa.array(np.flatnonzero(stays))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in names] + list(map(pa.array, whole.of(length[stays], rank[stays]))),
                                             [*names, "sequence_id", "offset"])
            crcs = batch.column("parts")
            firsts, values, start = crcs.offsets.to_numpy(), crcs.values.to_numpy(), batch.column("start").to_numpy()
            for bit in range(capacity.bit_length()):
                at = np.flatnonzero(~stays & (length >> bit & 1 == 1))
                if len(at):
                    size = length[at]
                    above = size >> bit + 1 << bit + 1  # of larger parts, which come first
                    number = np.array([x.bit_count() for x in above.tolist()])
                    rows = pa.array(at)
                    found = parts.of(np.full(len(at), 1 << bit), earlier[bit][size] + rank[at] - kept[size])
                    columns = [start[at] + above, np.full(len(at), 1 << bit), values[firsts[at] + number]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), *map(pa.array, columns), batch.column("doc_tokens").take(rows), *map(pa.array, found)],
                        [*names, "sequence_id", "offset"])

    return written.join(ranked, ["task", "length"]).select(*names, "parts", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
