"""Keyed snippet store: last write wins, kept as a table."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowlens.functions.text import strip

POINTERS = "_generations"
SNIPPET_FIELDS = [
    "processor_id", "template", "name", "short_type", "parent_group", "parent_group_path", "migration_category",
    "databricks_target", "recommended_target", "migration_needed", "implementation_hint", "blockers", "next_step",
    "code_language", "databricks_code", "confidence", "classification_source", "rule",
]


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Last row per key by version columns: one aggregation with map-side combine, no sort per key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("v")).select(*keys, "v.*")


def snippet_rows(records: DataFrame, endpoint: str, max_tokens: int, batch_index: int) -> DataFrame:
    """Rows worth storing (with code), stamped with batch, endpoint and time."""
    rows = records.filter((F.col("processor_id") != "") & (strip(F.coalesce("databricks_code", F.lit(""))) != ""))
    have = set(records.columns)
    empty = F.array().cast("array<string>")
    ids = lambda side: (
        F.coalesce(f"feature_evidence.connections.{side}", empty) if "feature_evidence" in have else empty
    ).alias(f"{side}_processor_ids")
    field = lambda c: F.col(c) if c in have else F.lit(None).cast("string").alias(c)
    return rows.select(
        *[field(c) if c != "code_language" else F.coalesce(field(c), F.lit("unknown")).alias(c) for c in SNIPPET_FIELDS],
        F.lit(batch_index).alias("batch_index"), F.lit(endpoint).alias("endpoint"), F.lit(max_tokens).alias("max_tokens"),
        F.current_timestamp().alias("cached_at"), ids("incoming"), ids("outgoing"),
    )


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest generation of the store, or None where there is none yet."""
    try:
        generation = spark.read.text(f"{path}/{POINTERS}").agg(F.max("value")).first()[0]
    except AnalysisException:
        return None
    return None if generation is None else spark.read.parquet(f"{path}/{generation}")


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Merge rows into the store; of several rows for a processor the last of the newest batch stays.

    A new generation is written whole, then a pointer to it is added. Generations are named in ascending order and pointers
    are only added, so a job lost at any point leaves the newest complete generation to be found.
    """
    old = load(spark, path)
    rows = rows.withColumn("ordinal", F.monotonically_increasing_id())
    merged = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    generation = f"gen-{time.time_ns():020d}-{uuid.uuid4().hex}"
    latest(merged, ["processor_id"], ["cached_at", "batch_index", "ordinal"]).write.parquet(f"{path}/{generation}")
    spark.createDataFrame([(generation,)], "value string").coalesce(1).write.mode("append").text(f"{path}/{POINTERS}")
    return spark.read.parquet(f"{path}/{generation}")


def view(store: DataFrame, group: str | None = None) -> DataFrame:
    rows = store if group in (None, "All") else store.filter(F.col("parent_group_path") == group)
    return rows.orderBy("template", "parent_group_path", "name")
