"""Incremental template ingest: each new or changed file is analysed once; its newest generation supersedes older rows.

A ledger has one entry for each file that a batch looked at. A file's generation is the batch in which its present content
was first seen, after its last entry with another content; only that batch analysed it, so the summary's rows of that batch
are its valid ones. A removed file gets a tombstone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from flowlens.operators.classify import flat_rows
from flowlens.plans.pipeline import records
from flowlens.sources.templates import FILE_SCHEMA, Corpus, shred, template_files, template_key
from flowlens.session import cut, cut_counted

LEDGER_SCHEMA = "path string, template string, checksum string, batch_id long, modificationTime timestamp, length long, removed boolean"


def live_files(ledger: DataFrame) -> DataFrame:
    """(path, checksum, generation, batch_id, ...) of every file that is not removed, by its newest entry.

    ``generation`` is the first batch of the run of equal states that the newest entry ends: content that comes back after
    another one, or after a removal, is a new generation.
    """
    rows = ledger.withColumn("removed", F.coalesce("removed", F.lit(False)))
    rest = [c for c in rows.columns if c != "path"]
    newest = rows.groupBy("path").agg(F.max_by(F.struct(*rest), "batch_id").alias("now")).select("path", "now.*").filter("NOT removed")
    past = rows.join(newest.select("path", F.col("checksum").alias("present")), "path").withColumn(
        "other", F.col("removed") | ~F.col("checksum").eqNullSafe(F.col("present")))
    other = past.groupBy("path").agg(F.max(F.when(F.col("other"), F.col("batch_id"))).alias("last_other"))
    first = past.join(other, "path").filter("last_other IS NULL OR batch_id > last_other").groupBy("path").agg(
        F.min("batch_id").alias("generation"))
    return newest.drop("removed").join(first, "path")


def unchanged_removed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose checksum differs from that of the newest entry of their path, and files without a live one."""
    return files.withColumn("checksum", F.sha2("content", 256)).join(
        live_files(ledger).select("path", "checksum"), ["path", "checksum"], "left_anti"
    )


def read_ledger(spark: SparkSession, location: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(location)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER_SCHEMA)


def current_summary(spark: SparkSession, summary: str, ledger: str) -> DataFrame:
    """Summary rows of the newest generation of every file that is not removed."""
    rows = spark.read.option("header", "true").csv(summary)
    valid = live_files(read_ledger(spark, ledger)).select("template", F.col("generation").alias("batch"))
    return rows.join(valid, ["template", "batch"], "left_semi")


def _write_entries(entries: DataFrame, batch_id: int, ledger: str) -> None:
    entries.withColumn("batch_id", F.lit(batch_id).cast("long")).select(
        "path", "template", "checksum", "batch_id", "modificationTime", "length", "removed").write.mode("overwrite").parquet(
        f"{ledger}/batch={batch_id}")


def process_batch(files: DataFrame, batch_id: int, summary: str, ledger: str) -> None:
    """Analyse one micro-batch. Output folders are named by batch id and overwritten on replay; the ledger is written last."""
    spark = files.sparkSession
    seen = read_ledger(spark, ledger).filter(F.col("batch_id") != batch_id)
    fresh = cut(unchanged_removed(files, seen))
    corpus = Corpus(shred(fresh))
    flat_rows(records(corpus.processors, corpus.connections), corpus.templates).write.mode("overwrite").option(
        "header", "true").csv(f"{summary}/batch={batch_id}")
    _write_entries(files.withColumn("checksum", F.sha2("content", 256)).withColumn("removed", F.lit(False)), batch_id, ledger)


def ingest(
    spark: SparkSession, location: str, summary: str, ledger: str, checkpoint: str, max_files: int = 10_000
) -> StreamingQuery:
    """Start the file stream over a template folder and its sub-folders; stops when all available files are done.

    A file stream reads a path once; ``ingest_changes`` also reads files that changed in place.
    """
    stream = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.xml")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(location)
        .withColumn("template", template_key(spark, location))
    )
    return (
        stream.writeStream.foreachBatch(lambda df, i: process_batch(df, i, summary, ledger))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_changes(spark: SparkSession, location: str, summary: str, ledger: str, max_files: int = 10_000) -> int:
    """Analyse every file that is new or changed since the ledger's newest entry for it; the number of such files.

    The listing (path, time, length) is compared without reading any content, once; then only those files are read, in
    batches of about ``max_files`` dealt by a hash of the path. Files of the ledger that are no longer listed get
    tombstones, so a ledger belongs to one location.
    """
    known = cut(live_files(read_ledger(spark, ledger)))
    listed = cut(template_files(spark, location).select("path", "modificationTime", "length"))
    gone, lost = cut_counted(known.join(listed, "path", "left_anti").withColumn("removed", F.lit(True)))
    fresh, n = cut_counted(listed.join(known, ["path", "modificationTime", "length"], "left_anti"))
    number = read_ledger(spark, ledger).agg(F.max("batch_id")).first()[0] or 0
    if lost:
        number += 1
        _write_entries(gone, number, ledger)
    deals = -(-n // max_files)
    for deal in range(deals):
        paths = [r["path"] for r in fresh.filter(F.pmod(F.xxhash64("path"), F.lit(deals)) == deal).select("path").collect()]
        if paths:
            number += 1
            files = spark.read.format("binaryFile").load(paths).withColumn("template", template_key(spark, location))
            process_batch(files, number, summary, ledger)
    return n


def upsert_stream(stream: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Snippet rows arriving as a stream, merged into the keyed store per micro-batch."""
    from flowlens.operators.store import upsert

    return (
        stream.writeStream.foreachBatch(lambda df, _: upsert(df.sparkSession, store_path, df))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
