"""Token ids in compressed files: canonical length-limited Huffman codes, blocks that can be decoded alone.

A file set is two Parquet folders. ``book``: one row for each id with its code length, from the counts of all
documents. ``blocks``: rows (part, block, first_id, doc_ids, lengths, n_ids, payload, checkpoints); parts and blocks are
in ascending document order, and ``checkpoints`` are the bit offsets of every 128th symbol, from which a block is decoded.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm import huffman
from flowlens.llm.common import ENCODE_BYTES, chunks, text_rows, texts_of
from flowlens.llm.vocab import default_path, encode_all
from flowlens.session import cut_dir

RAW = "part int, block int, first_id long, doc_ids array<long>, lengths array<int>, ids binary, seen array<int>, times array<int>"
BLOCKS = "part int, block int, first_id long, doc_ids array<long>, lengths array<int>, n_ids long, payload binary, checkpoints array<long>"
#: Codes are kept in an id's own range of 2**20 at most: all public vocabularies have fewer.
MOST_IDS = 1 << 20


def _raw_blocks(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Documents in ascending id order, encoded, in blocks of about 2 MB of text, with the counts of each block's ids."""
    rows = text_rows(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def encode(batches):
        part, block, first_id = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in chunks(texts, ENCODE_BYTES):
                coded = encode_all(texts[a:b], vocabulary)
                lengths = [len(x) // 4 + 1 for x in coded]
                ids = np.frombuffer(end.join([*coded, b""]), "<u4")
                times = np.bincount(ids)
                seen = np.flatnonzero(times)
                narrow = ids.astype("<u2") if len(times) <= 1 << 16 else ids
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "block": block, "first_id": first_id, "doc_ids": doc_ids[a:b], "lengths": lengths,
                    "ids": narrow.tobytes(), "seen": seen.astype(np.int32), "times": times[seen].astype(np.int32)}], SCHEMA)
                block += 1
                first_id += len(ids)

    return ordered.mapInArrow(encode, RAW)


SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("seen", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write all documents' ids, ``end_id`` after each, to the file set at ``path``.

    Texts are encoded once; the ids of all blocks are kept beside the files, compressed, until the counts of all
    documents are known. Rows without an id come first; rows of equal id are kept each, ordered by a hash of their text;
    a null text is empty; an empty table gives empty folders.
    """
    spark = docs.sparkSession
    _raw_blocks(docs, vocabulary or default_path("word_bpe_49k.json"), end_id, id_col, text_col) \
        .write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(RAW).parquet(f"{path}/raw")
    pairs = raw.select(F.explode(F.arrays_zip("seen", "times")).alias("x")).select("x.seen", "x.times")
    counted = pairs.groupBy("seen").agg(F.sum("times").alias("n")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max((r["seen"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["seen"]] = r["n"]
    if len(counts) > MOST_IDS:
        raise ValueError(f"ids up to {len(counts) - 1}; codes are made for {MOST_IDS} ids")
    lengths = huffman.code_lengths(counts, huffman.bits_needed(counts))
    codes = huffman.canonical(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int") \
        .write.parquet(f"{path}/book")

    def pack(batches):
        for batch in batches:
            sizes = [sum(x) for x in batch.column("lengths").to_pylist()]
            coded = [huffman.encode(_unpacked(x.as_py(), n), lengths, codes)
                     for x, n in zip(batch.column("ids"), sizes, strict=True)]
            keep = ["part", "block", "first_id", "doc_ids", "lengths"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array([x for x, _ in coded], pa.binary()),
                                                   pa.array([x for _, x in coded], pa.list_(pa.int64()))],
                [*keep, "n_ids", "payload", "checkpoints"])

    raw.select("part", "block", "first_id", "doc_ids", "lengths", "ids").mapInArrow(pack, BLOCKS).write.parquet(f"{path}/blocks")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/raw")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>), or their crc32 in place of the ids with ``digest``.

    ``start`` counts the ids of all documents before. Blocks are decoded alone, in any task.
    """
    book = spark.read.schema("id int, bits int").parquet(f"{path}/book").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each part, so no payload is shuffled for it
    placed = blocks.join(F.broadcast(parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))), "part")
    last = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.list_(pa.int32()), "array<int>")

    def unpack(batches):
        table = huffman.decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = huffman.decode(row["payload"], row["checkpoints"], row["n_ids"], table).astype("<u4")
                sizes = np.array(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                each = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"] + row["first_id"]), pa.array(sizes),
                     pa.array([zlib.crc32(x) for x in each] if digest else each, last[1])],
                    ["doc_id", "start", "n_tokens", last[0]])

    return placed.select("before", "first_id", "doc_ids", "lengths", "n_ids", "payload", "checkpoints").mapInArrow(
        unpack, f"doc_id long, start long, n_tokens long, {last[0]} {last[2]}")


def token_digests(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the documents' token file to the shared folder and read (doc_id, start, n_tokens, ids_crc32) back from it."""
    spark = docs.sparkSession
    path = f"{cut_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path, digest=True)
