"""Substring dedup by seed and extend: repeated stretches of words within and between documents.

Seeds are winnowed: of the ``seed``-word hashes in a window of ``window`` words the least is the window's anchor, so equal
windows have equal anchors wherever they stand. The windows of a document fall into runs with one anchor; a run, with the
words on both sides that its windows reach, is the furthest that a match can be extended at this anchor.

1. Every document is written as its runs (anchor, hash of the whole run, place). No text moves.
2. Documents are joined on anchors that occur more than once. Where all runs of an anchor are equal, or a run has an equal
   one, the whole run is repeated: the match extends to both ends.
3. The other runs of a repeated anchor match in part. One of each kind of equal runs and each single run are opened into
   their windows; equal windows of one anchor are repeated. A hot passage so costs one opened run for each different
   surrounding, never a pair for each two copies.
4. Repeated windows that touch are one maximal repeat; the words under them are removed.
"""

from __future__ import annotations

import hashlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import chunks, content_key, row_numbers, text_rows, texts_of
from flowlens.session import cut

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
RUNS = "array<struct<anchor:long,run:long,first:int,windows:int,own:boolean>>"
MARKED = f"row long, doc_id long, id_key long, text_key long, n_words long, sha256 string, runs {RUNS}"


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, m, np.uint64)]))
                                  for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
        return self.up, self.down


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def hash_spans(words: list[list[bytes]]):
    """Hashes of stretches of words: stretch(first, end) for positions in all texts' words, one text after the other."""
    n = sum(map(len, words))
    up, down = POWERS.reach(n)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(each * up[:n], out=sums[1:])
    return lambda first, end: mixed((sums[end] - sums[first]) * down[first])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = pick(values[: len(values) - reach], values[reach:])
        reach *= 2
    rest = width - reach
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(words: list[list[bytes]], window: int, seed: int) -> list[np.ndarray]:
    """Runs of many texts: anchor, run hash, first window, windows, own (a window may repeat within the run).

    Positions count the words of all texts, one text after the other.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    n, width = int(sizes.sum()), window - seed + 1
    empty = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool)]
    if n < window:
        return empty
    stretch = hash_spans(words)
    at = np.arange(n - seed + 1)
    seeds = stretch(at, at + seed)
    ends = np.repeat(np.cumsum(sizes), sizes)
    inside = np.flatnonzero(np.arange(n - window + 1) + window <= ends[: n - window + 1])
    if not len(inside):
        return empty
    least = sliding(seeds, width, np.minimum)[inside]
    first = np.flatnonzero((np.diff(inside, prepend=-2) != 1) | (np.diff(least, prepend=least[0] ^ np.uint64(1)) != 0))
    count = np.diff(np.append(first, len(inside)))
    start, anchor = inside[first], least[first]
    run = stretch(start, start + count - 1 + window) ^ mixed(count.astype(np.uint64))
    # a run whose anchor stands in it more than once may hold the same window twice
    shown = np.zeros(n - window + 1, np.uint64)
    shown[inside] = least
    shown = np.concatenate([np.zeros(width - 1, np.uint64), shown, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(shown, width, np.maximum)[: len(seeds)] == seeds)
    kinds, kind = np.unique(seeds[chosen], return_inverse=True)
    keys = np.sort(kind.astype(np.int64) << 40 | chosen)
    mine = np.searchsorted(kinds, anchor).astype(np.int64) << 40
    own = np.searchsorted(keys, mine | start + count + width - 2, "right") - np.searchsorted(keys, mine | start) > 1
    return [anchor, run, start, count, own]


def mark(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """A row for each document: its runs, and what it returns if nothing repeats."""

    def marked(batches):
        number = row_numbers()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in chunks(texts):
                words = [x.split() for x in texts[a:b]]
                anchor, run, start, count, own = runs_of(words, window, seed)
                before = np.append(0, np.cumsum([len(w) for w in words]))
                bounds = np.searchsorted(start, before)
                base = np.repeat(before[:-1], np.diff(bounds))
                inner = pa.StructArray.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array((start - base).astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(own)], ["anchor", "run", "first", "windows", "own"])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(islice(number, b - a)), pa.int64()), *(part.column(c) for c in ("doc_id", "id_key", "text_key")),
                     pa.array([len(w) for w in words], pa.int64()),
                     pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), inner)],
                    ["row", "doc_id", "id_key", "text_key", "n_words", "sha256", "runs"])

    return docs.mapInArrow(marked, MARKED)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of two longs; rows of one key are equal."""
    rows = text_rows(docs, id_col, text_col)
    return rows.withColumns({"id_key": F.coalesce("doc_id", F.lit(-(1 << 63))), "text_key": content_key(F.col("text"))})


def open_windows(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, row, first, alone) of every window of the runs wanted of each text."""

    def opened(batches):
        for batch in batches:
            texts = texts_of(batch)
            wanted = batch.column("wanted").to_pylist()
            numbers = batch.column("row").to_pylist()
            for a, b in chunks(texts):
                words = [x.split() for x in texts[a:b]]
                stretch = hash_spans(words)
                before = np.append(0, np.cumsum([len(w) for w in words])).tolist()
                runs = [(r["anchor"], at + r["first"], r["windows"], number, r["alone"], at)
                        for at, number, of in zip(before, numbers[a:b], wanted[a:b], strict=False) for r in of]
                anchor, start, count, number, alone, at = (np.array(x) for x in zip(*runs, strict=True))
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first = np.repeat(start, count) + nth
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(anchor, count)), pa.array(stretch(first, first + window).view(np.int64)),
                     pa.array(np.repeat(number, count)), pa.array((first - np.repeat(at, count)).astype(np.int32)),
                     pa.array(np.repeat(alone, count))], ["anchor", "hash", "row", "first", "alone"])

    return rows.mapInArrow(opened, "anchor long, hash long, row long, first int, alone boolean")


def repeated_windows(docs: DataFrame, marked: DataFrame, window: int) -> DataFrame:
    """(row, first, windows): runs of repeated windows, in words of the document ``row``."""
    runs = marked.select("row", F.inline("runs"))
    anchors = (
        runs.groupBy("anchor")
        .agg(F.sum(F.when(F.col("own"), 2).otherwise(1)).alias("n"), F.min("run").alias("low"), F.max("run").alias("high"),
             F.max("own").alias("own"))
        .where("n > 1").selectExpr("anchor", "low <> high OR own AS partly")
    )
    live = cut(runs.drop("own").join(anchors, "anchor"))
    partly = live.where("partly")
    kinds = cut(partly.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "windows")).alias("one")))
    whole = live.where("NOT partly").select("row", "first", "windows").union(
        partly.join(kinds.where("n > 1").select("anchor", "run"), ["anchor", "run"]).select("row", "first", "windows"))
    wanted = kinds.select("one.row", F.struct("anchor", "one.first", "one.windows", F.expr("n = 1").alias("alone")).alias("x")) \
        .groupBy("row").agg(F.collect_list("x").alias("wanted"))
    texts = wanted.join(marked.select("row", "id_key", "text_key"), "row").join(
        docs.select("id_key", "text_key", "text"), ["id_key", "text_key"]).select("row", "wanted", "text")
    windows = cut(open_windows(texts, window))
    place = F.struct("row", "first")
    again = windows.groupBy("anchor", "hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    single = windows.where("alone").join(again.select("anchor", "hash"), ["anchor", "hash"])
    return whole.union(single.select("row", "first", F.lit(1).alias("windows")))


def _covered(n: int, ranges: list, window: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for r in ranges:
        change[r["first"]] += 1
        change[r["first"] + r["windows"] - 1 + window] -= 1
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 6, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, repeats, kept]), one row for each input row.

    A word is removed if a window of ``window`` words over it also starts anywhere else, the same document included.
    ``with_text`` adds the maximal repeats (first word, words) and the kept words joined by blanks. A null or empty text has
    no words; texts below ``window`` words lose nothing; a null id stays null; repeated rows repeat one another, so long ones
    lose all their words; other columns are left aside; an empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col)
    marked = cut(mark(rows, window, seed))
    ranges = repeated_windows(rows, marked, window).join(marked.select("row", "id_key", "text_key"), "row") \
        .groupBy("id_key", "text_key").agg(F.collect_set(F.struct("first", "windows")).alias("ranges"))
    ranges = cut(ranges)
    more = ", repeats array<struct<first:int,words:int>>, kept string" if with_text else ""

    def kept(batches):
        for batch in batches:
            out = []
            for text, of in zip(texts_of(batch), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                gone = _covered(len(words), of, window)
                left = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = [{"first": a, "words": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                out.append((len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), spans, left.decode()))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])), pa.string()]
            names = ["n_words", "n_removed", "kept_sha256", "repeats", "kept"][: 5 if with_text else 3]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t, _ in zip(columns, types, names, strict=False))], ["doc_id", *names])

    cleaned = rows.join(ranges, ["id_key", "text_key"]).select("doc_id", "text", "ranges").mapInArrow(
        kept, "doc_id long, n_words long, n_removed long, kept_sha256 string" + more)
    keys = ranges.select("id_key", "text_key")
    if with_text:
        words = F.filter(F.split("text", "[ \t\n\x0b\f\r]+"), lambda w: w != "")
        whole = rows.join(keys, ["id_key", "text_key"], "left_anti").join(
            marked.select("id_key", "text_key", "n_words", "sha256").distinct(), ["id_key", "text_key"])
        return cleaned.union(whole.select("doc_id", "n_words", F.lit(0).cast("long"), "sha256",
                                          F.expr("cast(array() AS array<struct<first:int,words:int>>)"), F.array_join(words, " ")))
    return cleaned.union(marked.join(keys, ["id_key", "text_key"], "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long"), F.col("sha256").alias("kept_sha256")))
