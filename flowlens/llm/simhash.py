"""SimHash near-duplicates: fingerprints of 3-word shingles, linked by a self-join of binary tries.

The trie of all fingerprints is traversed together with itself: a pair of nodes carries the bits in which its prefixes
differ, and is dropped once they exceed the budget. Two fingerprints that differ in at most ``budget`` bits agree in one
of ``budget + 1`` bit blocks, so the trie is traversed once for each block turned to the front, where no differing bit is
spent on that leading block: the pairs of nodes below it start as the pairs of a node with itself, and only those with
two fingerprints or more matter. Such nodes are the units that Spark spreads. One that holds more than ``leaf``
fingerprints is split: the pairs of its children within the budget take its place, by joins, until all are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import content_key, text_rows, texts_of
from flowlens.llm.components import components
from flowlens.session import cut, cut_counted

BITS = 64
SHINGLE = 3
#: A-Z only, whatever the script of the rest.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bits that a split goes down at once.
STRIDE = 4


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """One unsigned fingerprint for each text; no words: zero."""
    out = np.zeros(len(texts), np.uint64)
    hash_of = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= SHINGLE:
            hashes = np.array([hash_of(line, 42)], np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-SHINGLE] + 1])
            spans = zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
            hashes = np.array([hash_of(line[a:b], 42) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
        out[i] = np.packbits(over).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): fingerprints as signed longs, one row for each input row."""

    def make(batches):
        for batch in batches:
            prints = pa.array(fingerprints_of(texts_of(batch)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), prints], ["doc_id", "text_key", "fp"])

    rows = text_rows(docs, id_col, text_col).withColumn("text_key", content_key(F.col("text")))
    return rows.mapInArrow(make, "doc_id long, text_key long, fp long")


def _prefix(bits) -> F.Column:
    return F.expr(f"shiftrightunsigned(turned, {BITS} - {bits})")


def trie_links(prints: DataFrame, budget: int = 2, leaf: int = 1024) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` so that components are those of all links within ``budget`` bits.

    Within a leaf only links that join its parts are given, so a cluster of n fingerprints gives below n links there.
    """
    width = BITS // (budget + 1)
    turn = "explode(array({})) AS (x)".format(", ".join(
        f"struct({r} AS turn, shiftleft(fp, {r * width}) | shiftrightunsigned(fp, {(BITS - r * width) % BITS or BITS - 1}) AS turned)"
        if r else "struct(0 AS turn, fp AS turned)" for r in range(budget + 1)))
    turned = prints.selectExpr(turn).select("x.turn", "x.turned")
    nodes = turned.groupBy("turn", _prefix(width).alias("a")).agg(F.count("*").alias("n")).where("n > 1")
    pairs, hot = cut_counted(nodes.select("turn", F.lit(width).alias("depth"), "a", F.col("a").alias("b"), F.lit(0).alias("used"),
                                          "n", F.col("n").alias("m")), f"n > {leaf}")
    depth, ready = width, []
    while True:
        ready.append(pairs.where(f"n <= {leaf} AND m <= {leaf}"))
        if not hot or depth >= BITS:
            break
        pairs, hot = cut_counted(_split(pairs.where(f"n > {leaf} OR m > {leaf}"), turned, depth, budget),
                                 f"n > {leaf} OR m > {leaf}")
        depth += STRIDE if depth + STRIDE <= BITS else BITS - depth
    links = None
    for part in ready:
        found = _leaf_links(part, turned, budget, leaf)
        links = found if links is None else links.union(found)
    return links


def _split(pairs: DataFrame, turned: DataFrame, depth: int, budget: int) -> DataFrame:
    """Pairs of children of large pairs, within the budget and holding at least one pair of fingerprints."""
    step = min(STRIDE, BITS - depth)
    large = pairs.select("turn", "a").union(pairs.select("turn", F.col("b").alias("a"))).distinct()
    children = (
        turned.select("turn", "turned", _prefix(depth).alias("a")).join(large, ["turn", "a"])
        .groupBy("turn", "a", _prefix(depth + step).alias("child")).agg(F.count("*").alias("n"))
    )
    left = children.select("turn", "a", F.col("child").alias("ca"), F.col("n").alias("na"))
    right = children.select("turn", F.col("a").alias("b"), F.col("child").alias("cb"), F.col("n").alias("nb"))
    return (
        pairs.select("turn", "a", "b", "used").join(left, ["turn", "a"]).join(right, ["turn", "b"])
        .where("a < b OR ca <= cb")
        .selectExpr("turn", f"{depth + step} AS depth", "ca AS a", "cb AS b", f"used + bit_count((ca ^ cb) & {(1 << step) - 1}) AS used",
                    "na AS n", "nb AS m")
        .where(f"used <= {budget} AND (a < b OR n > 1)")
    )


def _leaf_links(pairs: DataFrame, turned: DataFrame, budget: int, leaf: int) -> DataFrame:
    depths = [r["depth"] for r in pairs.select("depth").distinct().collect()]  # one: pairs of a round share it
    if not depths:
        return turned.sparkSession.createDataFrame([], "u long, v long")
    named = pairs.select("turn", "a", "b")
    sides = named.selectExpr("turn", "a", "b", "a AS node", "0 AS side").union(
        named.where("a <> b").selectExpr("turn", "a", "b", "b AS node", "1 AS side"))
    rows = turned.select("turn", "turned", _prefix(depths[0]).alias("node")).join(sides, ["turn", "node"])
    n = int(turned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = BITS // (budget + 1)

    def walk(batches):
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        turn, a, b, side, value = (table.column(c).to_numpy() for c in ("turn", "a", "b", "side", "turned"))
        first = np.flatnonzero((np.diff(turn, prepend=-1) != 0) | (np.diff(a, prepend=a[0]) != 0) | (np.diff(b, prepend=b[0]) != 0))
        ends = np.append(first[1:], len(turn))
        sizes, start = ends - first, 0
        while start < len(first):
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 4 * leaf)))
            pair_rows = slice(first[start], ends[stop - 1])
            u, v = walk_pairs(value[pair_rows].view(np.uint64), side[pair_rows], first[start:stop] - first[start], budget)
            back = np.repeat(turn[first[start:stop]], sizes[start:stop]).astype(np.uint64) * np.uint64(width)
            plain = _turn_back(value[pair_rows].view(np.uint64), back)
            u, v = forest(len(plain), u, v)
            yield pa.RecordBatch.from_arrays([pa.array(plain[u].view(np.int64)), pa.array(plain[v].view(np.int64))], ["u", "v"])
            start = stop

    return rows.repartition(n, "turn", "a", "b").sortWithinPartitions("turn", "a", "b", "side", "turned").mapInArrow(
        walk, "u long, v long")


def _turn_back(value: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(by == 0, value, value >> by | value << (np.uint64(BITS) - np.maximum(by, np.uint64(1))))


def walk_pairs(value: np.ndarray, side: np.ndarray, first: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Traverse the node pairs of many groups side by side; (rows u, rows v) within the budget.

    A group's rows are those from its ``first`` on: sorted values of its node a (side 0), then of its node b (side 1); a
    group without side 1 is a node with itself. A node is a range of sorted rows; one step goes a bit down in every pair.
    """
    ends = np.append(first[1:], len(value))
    middle = first + np.add.reduceat(side == 0, first)
    selfs = middle == ends
    lo_a, hi_a, lo_b, hi_b = first, middle, np.where(selfs, first, middle), ends
    spent = np.zeros(len(first), np.int64)
    found_u, found_v = [], []
    for bit in range(BITS - 1, -1, -1):
        small = (hi_a - lo_a) * (hi_b - lo_b) <= 16
        u, v = _product(lo_a[small], hi_a[small], lo_b[small], hi_b[small])
        found_u.append(u)
        found_v.append(v)
        lo_a, hi_a, lo_b, hi_b, spent = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, spent))
        if not len(lo_a):
            break
        ones = np.append(0, np.cumsum(value >> np.uint64(bit) & np.uint64(1))).astype(np.int64)
        cut_a, cut_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        apart = (lo_a != lo_b) | (hi_a != hi_b)
        every = np.ones(len(apart), bool)
        lo_a, hi_a, lo_b, hi_b, spent, keep = (np.concatenate(x) for x in (
            (lo_a, cut_a, lo_a, cut_a), (cut_a, hi_a, cut_a, hi_a), (lo_b, cut_b, cut_b, lo_b), (cut_b, hi_b, hi_b, cut_b),
            (spent, spent, spent + 1, spent + 1), (every, every, every, apart)))
        keep &= (spent <= budget) & (lo_a < hi_a) & (lo_b < hi_b)
        lo_a, hi_a, lo_b, hi_b, spent = (x[keep] for x in (lo_a, hi_a, lo_b, hi_b, spent))
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    apart = np.bitwise_count(value[u] ^ value[v])
    keep = (u < v) & (apart <= budget)
    return u[keep], v[keep]


def _product(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of small pairs of ranges."""
    sizes = (hi_a - lo_a) * (hi_b - lo_b)
    of = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = (hi_b - lo_b)[of]
    return lo_a[of] + k // np.maximum(wide, 1), lo_b[of] + k % np.maximum(wide, 1)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) with the components of the links (u, v) of n nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _classes(prints: DataFrame, budget: int, leaf: int) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint."""
    of_print = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(trie_links(of_print.select("fp"), budget, leaf))
    of_node = of_print.join(found, of_print.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    return of_node.select("fp", "component").join(least, "component")


def near_duplicates(docs: DataFrame, budget: int = 2, leaf: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each input row.

    ``component_id`` is the least doc_id that links reach. Equal fingerprints are collapsed before the search, so copies are
    never paired with one another. Texts without words (null, empty, white space) have the fingerprint zero and are linked
    like any other; a null id is ignored for the least one unless no other exists; repeated rows are rows of one component;
    other columns are left aside; an empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    return prints.join(_classes(prints, budget, leaf), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 2, leaf: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each component with the least id (then the least hash of its text), with the columns of ``docs``.

    Rows without an id come first; of rows equal in id and text one stays.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    id_key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    kept = prints.join(_classes(prints, budget, leaf), "fp").groupBy("component").agg(F.min(F.struct(id_key.alias("i"), F.col("text_key").alias("t"))).alias("x"))
    keys = cut(kept.select(F.col("x.i").alias("_kept_id"), F.col("x.t").alias("_kept_text")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"),
                       content_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text"))
    mine = rows.join(keys, (F.col("_id") == F.col("_kept_id")) & (F.col("_text") == F.col("_kept_text")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(0)))
    return mine.withColumn("_nth", nth).where("_nth = 1").select("_row.*")
