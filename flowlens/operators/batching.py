"""Snapshots and size-bounded batches in a fixed order, packed in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import cut

# Default limits.
MAX_ITEMS, MAX_CHARS = 10, 60_000

SUMMARY = (
    "block int, n long, scopes array<string>, sizes array<long>, last_scope string, total long, "
    "starts array<long>, open_items array<long>, open_chars array<long>"
)


def _next_starts(scope: np.ndarray, size: np.ndarray, max_items: int, max_chars: int) -> np.ndarray:
    """For every row as the start of a batch: the row the next batch starts at."""
    n = len(size)
    row = np.arange(n)
    total = np.concatenate([[0], np.cumsum(size)])
    by_chars = np.searchsorted(total, total[:-1] + max_chars, side="right") - 1
    change = np.flatnonzero(scope[1:] != scope[:-1]) + 1
    bounds = np.append(change, n)
    by_scope = bounds[np.searchsorted(change, row, side="right")]
    return np.maximum(np.minimum(np.minimum(row + max_items, by_chars), by_scope), row + 1)


def pack(
    items: DataFrame, order: list[str], size: str, scope: list[str] | None = None,
    max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS,
) -> DataFrame:
    """Adds ``batch_index``: a new batch when the next item would exceed the item or size limit.

    Items are taken in ``order`` (unique), which must begin with the ``scope`` columns; a scope change
    always ends a batch and restarts the index. With no scope the fold runs over the whole corpus.
    The sequential fold is made parallel: rows are range-partitioned into blocks; each block reports,
    for every number of leading rows the batch entering it might still absorb, which batch leaves it
    open; the block reports (a row each, bounded by the partition count) are chained; then every
    block numbers its own rows.
    """
    scope = scope or []
    in_block = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = cut(
        items.withColumn("_scope", F.to_json(F.struct(*scope)) if scope else F.lit(""))
        .withColumn("_size", F.col(size).cast("long"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_pos", in_block)
    )

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        scopes, sizes = pdf["_scope"].to_numpy(), pdf["_size"].to_numpy()
        n = len(sizes)
        nxt = _next_starts(scopes, sizes, max_items, max_chars)
        count, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            inner = nxt[i] < n
            count[i] = 1 + count[nxt[i]] if inner else 1
            last[i] = last[nxt[i]] if inner else i
        head = min(max_items, n)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return pd.DataFrame([{
            "block": int(pdf["_block"].iloc[0]), "n": n, "scopes": list(scopes[:head]), "sizes": list(sizes[:head]),
            "last_scope": scopes[-1], "total": int(total[n]), "starts": list(count[:head]),
            "open_items": list(n - last[:head]), "open_chars": list(total[n] - total[last[:head]]),
        }])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, done, open_ = [], 0, None
        for b in pdf.sort_values("block").itertuples():
            skip = 0
            if open_ is not None:
                where, held, chars = open_
                while (skip < len(b.sizes) and b.scopes[skip] == where and held + 1 <= max_items
                       and chars + b.sizes[skip] <= max_chars):
                    held, chars, skip = held + 1, chars + b.sizes[skip], skip + 1
            out.append({"_block": b.block, "_skip": skip, "_done": done})
            if skip == b.n:
                open_ = (where, held, chars)
            else:
                # a full batch cannot absorb max_items rows, so skip is always a reported entry here
                done += int(b.starts[skip])
                open_ = (b.last_scope, int(b.open_items[skip]), int(b.open_chars[skip]))
        return pd.DataFrame(out, columns=["_block", "_skip", "_done"])

    slim = ordered.select("_block", "_pos", "_scope", "_size")
    reports = slim.groupBy("_block").applyInPandas(report, SUMMARY)
    entries = reports.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(chain, "_block int, _skip long, _done long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        nxt = _next_starts(pdf["_scope"].to_numpy(), pdf["_size"].to_numpy(), max_items, max_chars)
        mark = np.zeros(len(pdf), dtype=np.int64)
        i = int(pdf["_skip"].iloc[0])
        while i < len(pdf):
            mark[i] = 1
            i = nxt[i]
        return pd.DataFrame({"_block": pdf["_block"], "_pos": pdf["_pos"], "_batch": pdf["_done"] + np.cumsum(mark)})

    numbered = slim.join(entries, "_block").groupBy("_block").applyInPandas(number, "_block int, _pos long, _batch long")
    rows = cut(ordered.join(numbered, ["_block", "_pos"]))
    if scope:
        firsts = rows.groupBy(*scope).agg(F.min("_batch").alias("_first"))
        rows = rows.join(firsts, scope).withColumn("batch_index", F.col("_batch") - F.col("_first") + 1)
    else:
        rows = rows.withColumn("batch_index", F.col("_batch"))
    return rows.drop("_scope", "_size", "_block", "_pos", "_batch", "_first")


def snapshots(records: DataFrame, script_details: DataFrame | None = None) -> DataFrame:
    """Typed projection with defaults; rows without an id are dropped; ``prompt_chars`` is its JSON size."""
    text = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    rows = records.filter("processor_id <> ''")
    if script_details is not None:
        detail = script_details.select("template", "processor_id", F.struct("inline_scripts", "external_scripts").alias("scripts"))
        rows = rows.join(detail, ["template", "processor_id"], "left")
    columns = [
        F.col("processor_id"), text("template").alias("template"), text("name").alias("name"),
        text("short_type", "processor_type").alias("short_type"), text("migration_category").alias("migration_category"),
        text("parent_group_path", "parent_group").alias("parent_group_path"),
        text("classification_source").alias("classification_source"), text("rule").alias("rule"),
        text("databricks_target").alias("databricks_target"),
        F.bround(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), normalised_evidence().alias("feature_evidence"),
    ]
    if script_details is not None:
        columns.append(F.col("scripts"))
    snap = rows.select(*columns)
    return snap.withColumn("prompt_chars", F.length(F.to_json(F.struct(*snap.columns))))


def normalised_evidence() -> Column:
    """Feature evidence with defaults for every missing field."""
    e = "feature_evidence"
    none = F.array()
    b = lambda p: F.coalesce(F.col(f"{e}.{p}"), F.lit(False))
    n = lambda p: F.coalesce(F.col(f"{e}.{p}"), F.lit(0))
    a = lambda p: F.coalesce(F.col(f"{e}.{p}"), none)
    return F.struct(
        F.struct(b("sql.has_sql").alias("has_sql"), b("sql.has_dml").alias("has_dml"), b("sql.has_metadata_only").alias("has_metadata_only")).alias("sql"),
        F.struct(n("scripts.inline_count").alias("inline_count"), n("scripts.external_count").alias("external_count"),
                 a("scripts.external_hosts").alias("external_hosts")).alias("scripts"),
        F.struct(a("tables.tables").alias("tables"), a("tables.properties").alias("properties")).alias("tables"),
        F.struct(a("variables.defines").alias("defines"), a("variables.uses").alias("uses")).alias("variables"),
        F.struct(a("connections.incoming").alias("incoming"), a("connections.outgoing").alias("outgoing")).alias("connections"),
        a("controller_services").alias("controller_services"), b("uses_variables").alias("uses_variables"),
    )


def build_batches(
    records: DataFrame, script_details: DataFrame | None = None, max_items: int = MAX_ITEMS,
    max_chars: int = MAX_CHARS, scope: str = "corpus",
) -> DataFrame:
    """Batch payloads: members in order, templates, count and size (at most ``max_items`` members each)."""
    snap = snapshots(records, script_details)
    order = ["template", "parent_group_path", "processor_id"]
    by = ["template"] if scope == "template" else []
    return payloads(pack(snap, order, "prompt_chars", by, max_items, max_chars), [*by, "batch_index"], order)


def payloads(packed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    members = [c for c in packed.columns if c not in ("batch_index", "prompt_chars")]
    templates = [F.array_sort(F.collect_set(F.nullif("template", F.lit("")))).alias("templates")] if "template" not in keys else []
    rows = packed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.to_json(F.struct(*members)).alias("doc"), "processor_id"))).alias("m"),
        *templates, F.count("*").alias("processor_count"), F.sum("prompt_chars").alias("prompt_char_count"),
    )
    return rows.withColumn("processor_ids", F.transform("m", lambda x: x["processor_id"])).withColumn(
        "processors", F.transform("m", lambda x: x["doc"])
    ).drop("m")


def size_band(chars: Column) -> Column:
    """Rough token bands of a payload (three characters a token)."""
    tokens = F.floor(chars / 3)
    return F.when(tokens > 150_000, F.lit("error")).when(tokens > 100_000, F.lit("warning")).when(
        tokens > 50_000, F.lit("info")).otherwise(F.lit("ok"))


def iter_documents(df: DataFrame) -> Iterator[str]:
    """JSON documents one at a time, for a client that posts them."""
    return (r["doc"] for r in df.toLocalIterator())
