"""Optional filters of the interactive tables; ``None`` or "All" means no filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "All"


def _contains(column, text: str):
    return F.contains(F.lower(F.coalesce(column.cast("string"), F.lit(""))), F.lit(text.lower()))


def multi_filter(df: DataFrame, name_contains: str | None = None, **equals: str | None) -> DataFrame:
    """Name contains (case-insensitive) and equality filters; a null cell compares as "(none)"."""
    if name_contains:
        names = [F.col(c) for c in ("processor_name", "name") if c in df.columns]
        df = df.filter(_contains(F.coalesce(*names, F.lit("")), name_contains.strip()))
    for column, wanted in equals.items():
        if wanted is not None and wanted != ALL:
            df = df.filter(F.coalesce(F.col(column).cast("string"), F.lit("(none)")) == wanted)
    return df


def text_search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any column (or any of the given ones) contains the text, ignoring case."""
    if not text:
        return df
    return df.filter(reduce(lambda a, b: a | b, [_contains(F.col(c), text) for c in columns or df.columns]))


def planner_rows(
    records: DataFrame, categories: list[str] | None = None, sources: list[str] | None = None,
    name_contains: str | None = None, type_contains: str | None = None,
) -> DataFrame:
    rows = records
    if categories:
        rows = rows.filter(F.col("migration_category").isin(*categories))
    if sources:
        rows = rows.filter(F.col("classification_source").isin(*sources))
    if name_contains:
        rows = rows.filter(_contains(F.col("name"), name_contains))
    if type_contains:
        rows = rows.filter(_contains(F.col("short_type"), type_contains))
    return rows.orderBy("migration_category", "template", "name")


def table_ref_filter(refs: DataFrame, processor_type: str | None = None, table_contains: str | None = None) -> DataFrame:
    rows = multi_filter(refs, processor_type=processor_type)
    return rows.filter(_contains(F.col("table_name"), table_contains)) if table_contains else rows


def script_filter(items: DataFrame, script_type: str | None = None, kind: str | None = None, text: str | None = None) -> DataFrame:
    rows = multi_filter(items, script_type=script_type, kind=kind)
    return text_search(rows, text, ["processor_name", "property_name", "path"]) if text else rows
