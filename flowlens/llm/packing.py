"""Best-fit packing of documents into sequences by exact complements.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the plan is made from the histogram of all
lengths: patterns (which lengths fill one sequence) and how many sequences have each pattern. Pieces then take their
places by their rank among the pieces of the same length. The histogram, the patterns and the table of places are
bounded by the capacity; they do not grow with the documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import ENCODE_BYTES, chunks, text_rows, texts_of
from flowlens.llm.vocab import default_path, encode_all
from flowlens.session import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, number of such sequences)], all of ``histogram`` used.

    From the longest length down: the gap that it leaves is looked up among the available lengths, then among sums of
    two, then of three; a combination is used as often as its scarcest length allows. What has no exact complement is
    packed best-fit decreasing, also by counts. Every step uses up a length or closes a kind of gap, so the steps are
    bounded by the lengths.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> bool:
        kinds, need = np.unique(lengths, return_counts=True)
        times = int((left[kinds] // need).min())
        if times:
            left[kinds] -= need * times
            patterns.append((lengths, times))
        return bool(times)

    def pairs(total: int) -> np.ndarray:
        """Larger halves x of the available pairs x + y = total; equal halves may turn out to be one piece only."""
        if total < 2:
            return np.empty(0, np.int64)
        low = np.arange(1, total // 2 + 1)
        return total - low[(left[low] > 0) & (left[total - low] > 0)]

    residual = np.zeros_like(left)
    for length in range(capacity, 0, -1):
        gap = capacity - length
        if left[length] and gap == 0:
            use((length,))
        if left[length] and gap and left[gap]:
            use((length, gap))
        if left[length]:
            for x in pairs(gap).tolist():
                use((length, x, gap - x))
                if not left[length]:
                    break
        third = gap - 2
        while left[length] and third >= 1:
            if left[third]:
                for x in pairs(gap - third).tolist():
                    use((length, third, x, gap - third - x))
                    if not (left[length] and left[third]):
                        break
            third -= 1
        residual[length], left[length] = left[length], 0
    return patterns + _best_fit(residual, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: open sequences of one pattern are kept together under their gap."""
    gaps: dict[int, dict[tuple[int, ...], int]] = {}
    waiting = np.zeros(capacity + 1, bool)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        of = gaps.setdefault(gap, {})
        of[lengths] = of.get(lengths, 0) + times
        waiting[gap] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(waiting[length:])
            if not len(fitting):
                each = capacity // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            gap = length + int(fitting[0])
            lengths, times = gaps[gap].popitem()
            waiting[gap] = bool(gaps[gap])
            taken = min(n, times)
            if times > taken:
                put(lengths, times - taken)
            put((*lengths, length), taken)
            n -= taken
    return [x for of in gaps.values() for x in of.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each pattern and place in it: which ranks of a length go there, the first sequence, and the offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), columns, strict=True))


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece, with its task and how many pieces of its length came before it in that task."""

    def split(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = texts_of(batch)
            for a, b in chunks(texts, ENCODE_BYTES):
                rows = []
                for doc_id, raw in zip(ids[a:b], encode_all(texts[a:b], vocabulary), strict=True):
                    raw += end
                    n, start, piece = len(raw) // 4, 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        rows.append((doc_id, piece, start, length, crc, task, int(seen[length])))
                        seen[length] += 1
                        start += length
                        piece += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return text_rows(docs, id_col, text_col).mapInArrow(split, PIECES)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A document is the ids of its text and ``end_id``; longer ones than ``capacity`` are cut, the first piece taking the
    remainder. A null or empty text is one piece of length 1; a null id stays null; repeated rows are packed each; other
    columns are left aside; an empty table gives no rows. Which of several pieces of equal length takes which place is
    fixed once the pieces are written.
    """
    cut_pieces = cut(pieces(docs, vocabulary or default_path("byte_bpe_50k.json"), capacity, end_id, id_col, text_col))
    of_task = cut_pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = of_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan_patterns(histogram, capacity))
    keys = table["length"] << 40 | table["first"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            found = [table["sequence"][at] + rank - table["first"][at], table["offset"][at]] if len(keys) else [rank, rank]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(x, pa.int64()) for x in found],
                                             [*keep, "sequence_id", "offset"])

    return (
        cut_pieces.join(ranked, ["task", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
        .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
