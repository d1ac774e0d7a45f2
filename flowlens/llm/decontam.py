"""Benchmark decontamination: short test items inside long documents, by sketches of least hashes, then exactly.

Items and documents are sets of hashed shingles of five words (fewer where an item has fewer). An item is contained in a
document that holds at least ``threshold`` of its shingles. Items are partitioned by size, by powers of two. Of an item with
n shingles at most m = floor((1 - threshold) n) may be missing, so of its k shingles with the least hashes at least k - m
must stand in any document that contains it. A partition's k is that of its largest size, with EXTRA hits to spare, so this
MinHash sketch misses no document, and a chance hit or two makes no candidate. Documents are probed only with hashes up to
the highest one in any sketch; hits are counted for each document and item, and pairs with enough of them are verified
with all shingles.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import cut

SHINGLE = 5
#: Hits beyond the missing ones; more make candidates rarer and sketches longer.
EXTRA = 2


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits, whatever stands between them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: str, width: int) -> Column:
    """64-bit hashes of ``width`` neighbouring words."""
    w = F.col(words)
    return F.transform(F.slice(w, 1, F.size(w) - width + 1), lambda x, i: F.xxhash64(x, *[w[i + k] for k in range(1, width)]))


def _item_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, width, hashes): distinct shingles of each item with any word."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    rows = rows.where("size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    by_width = F.coalesce(*[F.when(F.col("width") == k, shingles("w", k)) for k in range(1, SHINGLE + 1)])
    return rows.select("item_id", "width", F.array_distinct(by_width).alias("hashes"))


def _sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """(width, item, need, hash): the least hashes of each item, as many as its partition of sizes takes."""
    size = F.size("hashes")
    largest = F.pow(2, F.floor(F.log2(size)) + 1) - 1
    missing = F.floor((1 - threshold) * size + 1e-9).cast("int")
    kept = F.least(size, (F.floor((1 - threshold) * largest + 1e-9) + EXTRA).cast("int"))
    return sets.select("width", "item", (kept - missing).alias("need"), F.explode(F.slice(F.sort_array("hashes"), 1, kept)).alias("hash"))


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every document and item with containment of ``threshold`` or more.

    A null or empty text or item contains nothing and is nowhere contained; an item below five words is one shingle of all
    its words; items of equal text are found each; documents without an id are found with a null id; repeated documents give
    one row for each; other columns are left aside; an empty table on either side gives an empty result.
    """
    found = _found(docs, items, threshold, id_col, text_col, item_id_col, item_text_col)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    return found.select("doc_id", F.inline("item_ids"), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns; see ``find_items``."""
    found = _found(docs, items, threshold, id_col, text_col, item_id_col, item_text_col)
    if found is None:
        return docs
    bad = cut(found.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_text")).distinct())
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_bad_id")) & (_text_key(text_col) == F.col("_bad_text"))
    return docs.join(bad, same, "left_anti")


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _found(docs, items, threshold, id_col, text_col, item_id_col, item_text_col) -> DataFrame | None:
    """(doc_id, text_key, item_ids, n_item, n_shared), None without any item."""
    sets = cut(_item_sets(items, item_id_col, item_text_col).groupBy("width", F.sort_array("hashes").alias("hashes"))
               .agg(F.collect_list(F.struct("item_id")).alias("item_ids")).withColumn("item", F.xxhash64("width", "hashes")))
    sketches = cut(_sketches(sets, threshold))
    reach = sketches.groupBy("width").agg(F.max("hash").alias("top")).collect()  # a row for each width: five at most
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text_col}`").cast("string")).alias("w"),
                       _text_key(text_col).alias("text_key")).where("size(w) > 0")
    found = None
    for r in sorted(reach):
        part = _of_width(rows, sets, sketches, r["width"], r["top"], threshold)
        found = part if found is None else found.union(part)
    return found


def _of_width(rows: DataFrame, sets: DataFrame, sketches: DataFrame, width: int, top: int, threshold: float) -> DataFrame:
    """Search and verification for the items whose shingles have ``width`` words."""
    long_enough = rows.where(f"size(w) >= {width}")
    low = F.filter(shingles("w", width), lambda h: h <= F.lit(top))
    probes = long_enough.select("doc_id", "text_key", F.explode(F.array_distinct(low)).alias("hash"))
    hits = probes.join(sketches.where(f"width = {width}"), "hash").groupBy("doc_id", "text_key", "item", "need").agg(F.count("*").alias("hits"))
    pairs = cut(hits.where("hits >= need").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "item"))
    wanted = pairs.join(sets.where(f"width = {width}"), "item").select("id", "key", "item_ids", "hashes")
    shared = F.size(F.array_intersect("hashes", shingles("w", width))).cast("long")
    return (
        long_enough.join(wanted, F.expr("doc_id <=> id AND text_key = key"))
        .select("doc_id", "text_key", "item_ids", F.size("hashes").cast("long").alias("n_item"), shared.alias("n_shared"))
        .where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    )
