"""Near copies by wide SimHash: one text of each group whose five-word shingles have a Jaccard similarity of 0.8 or more.

Two bits of 64 only join texts that are nearly identical: at a similarity of 0.8 some 15 % of the bits differ. So a set of
shingles gets ``WORDS`` fingerprints of 64 bits, and the binary trie of each one is joined with itself in four rotations,
from nodes that share their leading 16 bits, with a budget of 10 bits for the other 48. A pair of 0.8 is met in at least
one of the 48 tries with a probability of 0.96, one of 0.85 with 0.99. A leaf gives the links of a minimum spanning forest of
the pairs that it meets, so a large group never gives all its pairs and its closest ones are those that stay. Links are
checked on all 768 bits, then on the shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import content_key, text_rows, texts_of
from flowlens.llm.components import components
from flowlens.llm.simhash import BITS, LOWER, _prefix, _split, forest, walk_pairs
from flowlens.session import cut, cut_counted

SHINGLE = 5
WORDS = 12
BLOCK = 16
BUDGET = 10
#: Share of the 768 bits; three deviations above that of a pair of 0.8.
APART = 0.19
#: Shingles whose bits are added up at once.
STEP = 4096
NO_ID = -(1 << 63)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles, A-Z lower-cased; of the whole text if it has fewer words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-SHINGLE] + 1])
    spans = zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in spans), np.uint64, len(starts)))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` fingerprints of a set of hashes; a bit is 1 if set in over half of them."""
    ones = np.zeros((WORDS, BITS), np.int64)
    salts = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for start in range(0, len(hashes), STEP):
        mixed = hashes[None, start : start + STEP] + salts
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(WORDS, -1, 8), axis=2)
        ones += bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1).view(">u8")[:, 0].astype(np.uint64)


def spanning(n: int, u: np.ndarray, v: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a minimum spanning forest of n nodes; of links equally long the first one counts."""
    order = np.lexsort((v, u, apart))
    u, v = u[order], v[order]
    taken, label, rank = np.zeros(len(u), bool), np.arange(n), np.arange(len(u))
    while True:
        open_ = rank[label[u[rank]] != label[v[rank]]]
        if not len(open_):
            return u[taken], v[taken]
        best = np.full(n, len(u))
        np.minimum.at(best, label[u[open_]], open_)
        np.minimum.at(best, label[v[open_]], open_)
        taken[best[best < len(u)]] = True
        child, root = forest(n, u[taken], v[taken])
        label = np.arange(n)
        label[child] = root
        rank = open_


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, set_key, words) of every row; texts without words share one set."""

    def make(batches):
        for batch in batches:
            sets = [shingle_set(x) for x in texts_of(batch)]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            words = np.array([wide_print(x) for x in sets], np.uint64).reshape(len(sets), WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys),
                                              pa.array(list(words), pa.list_(pa.int64()))], ["doc_id", "text_key", "set_key", "words"])

    rows = text_rows(docs, id_col, text_col).withColumn("text_key", content_key(F.col("text")))
    return rows.mapInArrow(make, "doc_id long, text_key long, set_key long, words array<long>")


def _met(nodes: DataFrame, leaf: int) -> DataFrame:
    """Pairs (u, v) of sets that some trie brings within the budget: spanning forests of its leaves."""
    words = nodes.select("set_key", F.posexplode("words").alias("word", "value"))
    firsts = cut(words.groupBy("word", "value").agg(F.min("set_key").alias("key"), F.count("*").alias("n")))
    same = words.join(firsts.where("n > 1"), ["word", "value"]).where("set_key <> key").select(F.col("set_key").alias("u"), F.col("key").alias("v"))
    blocks = BITS // BLOCK
    turns = ", ".join(f"struct(word * {blocks} + {r} AS turn, {f'shiftleft(value, {r * BLOCK}) | shiftrightunsigned(value, {BITS - r * BLOCK})' if r else 'value'} AS turned)"
                      for r in range(blocks))
    turned = firsts.selectExpr("key", f"explode(array({turns})) AS x").select("key", "x.turn", "x.turned")
    starts = turned.groupBy("turn", _prefix(BLOCK).alias("a")).agg(F.count("*").alias("n")).where(f"n > {leaf}")
    pairs, hot = cut_counted(starts.selectExpr("turn", f"{BLOCK} AS depth", "a", "a AS b", "0 AS used", "n", "n AS m"))
    own = turned.select("key", "turn", "turned", _prefix(BLOCK).alias("a"))  # every row is in one node, with itself as its pair
    if hot:
        own = own.join(pairs, ["turn", "a"], "left_anti")
    n = int(turned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth, found = BLOCK, same.union(_walked(own.repartition(n, "turn", "a").selectExpr("*", "a AS b", "0 AS side"), leaf))
    while hot and depth < BITS:
        pairs, hot = cut_counted(_split(pairs.where(f"n > {leaf} OR m > {leaf}"), turned, depth, BUDGET), f"n > {leaf} OR m > {leaf}")
        depth += min(4, BITS - depth)
        found = found.union(_leaf_pairs(pairs.where(f"n <= {leaf} AND m <= {leaf}"), turned, depth, leaf))
    return found


def _leaf_pairs(pairs: DataFrame, turned: DataFrame, depth: int, leaf: int) -> DataFrame:
    named = pairs.select("turn", "a", "b")
    sides = named.selectExpr("turn", "a", "b", "a AS node", "0 AS side").union(
        named.where("a <> b").selectExpr("turn", "a", "b", "b AS node", "1 AS side"))
    rows = turned.select("key", "turn", "turned", _prefix(depth).alias("node")).join(sides, ["turn", "node"])
    n = int(turned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _walked(rows.repartition(n, "turn", "a", "b"), leaf)


def _walked(rows: DataFrame, leaf: int) -> DataFrame:
    """Links (u, v) in the pairs of nodes (turn, a, b), each of which one partition holds: (key, turn, turned, a, b, side)."""

    def flush(held):
        turn, a, b, side, value, key = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.flatnonzero((np.diff(turn, prepend=-1) != 0) | (np.diff(a, prepend=a[0]) != 0) | (np.diff(b, prepend=b[0]) != 0))
        u, v = walk_pairs(value, side, first, BUDGET)
        u, v = spanning(len(value), u, v, np.bitwise_count(value[u] ^ value[v]))
        return pa.RecordBatch.from_arrays([pa.array(key[u]), pa.array(key[v])], ["u", "v"])

    def walk(batches):
        held, rows_held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            turn, a, b, side, value, key = (batch.column(c).to_numpy() for c in ("turn", "a", "b", "side", "turned", "key"))
            part = (turn, a, b, side, value.view(np.uint64), key)
            if held and rows_held > 4 * leaf:
                # the group that the batch goes on with ends first
                last = held[-1]
                whole = (turn == last[0][-1]) & (a == last[1][-1]) & (b == last[2][-1])
                stop = len(turn) if whole.all() else int(np.argmin(whole))
                held.append(tuple(x[:stop] for x in part))
                part = tuple(x[stop:] for x in part)
                if len(part[0]):
                    yield flush(held)
                    held, rows_held = [], 0
            if len(part[0]):
                held.append(part)
                rows_held += len(part[0])
        if held:
            yield flush(held)

    return rows.sortWithinPartitions("turn", "a", "b", "side", "turned").mapInArrow(walk, "u long, v long")


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """Pairs with the shingles of one end. A set with many links is given as many copies as it needs, so no task holds them all."""
    copies = pairs.groupBy(F.col(end).alias("set_key")).agg(F.ceil(F.count("*") / 256).cast("int").alias("copies"))
    spread = sets.join(copies, "set_key").select(F.col("set_key").alias(end), "copies", F.col("shingles").alias(f"of_{end}"),
                                                 F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(copies.withColumnRenamed("set_key", end), end).withColumn("copy", F.pmod(F.xxhash64(other), "copies").cast("int")).drop("copies")
    return dealt.join(spread.drop("copies"), [end, "copy"]).drop("copy")


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, text_col: str) -> DataFrame:
    """Pairs whose shingles are similar, counted exactly."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("set_key")).distinct()
    wanted = nodes.join(ends, "set_key").select("set_key", "text_key")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), content_key(text).alias("text_key")).join(wanted, "text_key").select("set_key", "text").dropDuplicates(["set_key"])

    def hashes(batches):
        for batch in batches:
            sets = pa.array([shingle_set(x).tobytes() for x in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), sets], ["set_key", "shingles"])

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("of_u"), batch.column("of_v"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= similarity * (len(x) + len(y) - both)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    sets = cut(texts.mapInArrow(hashes, "set_key long, shingles binary"))
    return _with_sets(_with_sets(pairs, sets, "u", "v"), sets, "v", "u").select("u", "v", "of_u", "of_v").mapInArrow(compare, "u long, v long")


def similar_sets(nodes: DataFrame, docs: DataFrame, similarity: float = 0.8, leaf: int = 1024, text_col: str = "text") -> DataFrame:
    """(u, v): links between sets of ``nodes`` (set_key, words, text_key) whose similarity is at least ``similarity``.

    The tries are laid out for 0.8; a lower similarity is met less often.
    """
    met = cut(_met(nodes, leaf).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    left, right = (nodes.select(F.col("set_key").alias(x), F.col("words").alias(f"w{x}")) for x in "uv")
    apart = " + ".join(f"bit_count(wu[{i}] ^ wv[{i}])" for i in range(WORDS))
    close = met.join(left, "u").join(right, "v").where(f"{apart} <= {int(APART * WORDS * BITS)}").select("u", "v")
    return _checked(cut(close), nodes, docs, similarity, text_col)


def keep_one(docs: DataFrame, similarity: float = 0.8, leaf: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each group of similar texts with the least id (then the least hash of its text), with the columns of ``docs``.

    Groups are the components of links between texts whose sets of five-word shingles (A-Z lower-cased; the whole text if it
    has fewer words) have a Jaccard similarity of ``similarity`` or more. Every link is checked exactly; which are met is a
    matter of chance, see above. Texts without words (null, empty, white space) are one group. Rows without an id come first;
    of rows equal in id and text one stays; other columns come along unchanged; an empty table gives an empty one.
    """
    rows = cut(_sets(docs, id_col, text_col))
    nodes = cut(rows.groupBy("set_key").agg(F.any_value("words").alias("words"), F.min("text_key").alias("text_key"),
                                            F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("text_key").alias("t"))).alias("first")))
    found = components(similar_sets(nodes, docs, similarity, leaf, text_col))
    groups = nodes.join(found, nodes.set_key == found.node, "left").groupBy(F.coalesce("component", "set_key").alias("group")).agg(F.min("first").alias("x"))
    keys = cut(groups.select(F.col("x.i").alias("_kept_id"), F.col("x.t").alias("_kept_text")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    mine = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                       content_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text"))
    mine = mine.join(keys, (F.col("_id") == F.col("_kept_id")) & (F.col("_text") == F.col("_kept_text")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(0)))
    return mine.withColumn("_nth", nth).where("_nth = 1").select("_row.*")
