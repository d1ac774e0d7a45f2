"""One wide feature row per processor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.text import el_bodies, el_key, has_any, property_blob, short_type, strip
from flowlens.operators import graph

KEY = ["template", "processor_id"]
DEFINES = "array<struct<variable:string,property:string,value:string>>"
USES = "array<struct<variable:string,property:string,expression:string>>"


def sql_flags(blob: Column) -> Column:
    low = F.lower(blob)
    dml, metadata = blob.rlike("(?i)" + V.DML), blob.rlike("(?i)" + V.METADATA_SQL)
    return F.struct(
        (low.contains("select") | low.contains("insert")).alias("has_sql"),
        dml.alias("has_dml"),
        (metadata & ~dml).alias("has_metadata_only"),
    )


def controller_services(props: Column) -> Column:
    named = F.filter(
        props, lambda p: F.lower(p["name"]).contains("controller service") & (p["value"] != "")
    )
    return F.transform(named, lambda p: p["value"])


def defined_variables(ptype: Column, props: Column) -> Column:
    """Definitions of one processor, from its own row."""
    extracting = ptype.contains("ExtractText")
    usable = F.filter(
        props,
        lambda p: (p["value"] != "")
        & ~(extracting & (p["name"].isin(*V.EXTRACT_TEXT_SETTINGS) | p["name"].rlike(r"(?U)\s")))
        & ~p["name"].rlike(V.EL),
    )
    entries = F.transform(
        usable, lambda p: F.struct(p["name"].alias("variable"), p["name"].alias("property"), p["value"].alias("value"))
    ).cast(DEFINES)
    return F.when(has_any(ptype, V.DEFINING_TYPES), entries).otherwise(F.array().cast(DEFINES))


def used_variables(props: Column) -> Column:
    per_prop = F.transform(
        F.filter(props, lambda p: p["value"].contains("${")),
        lambda p: F.transform(
            el_bodies(p["value"]),
            lambda b: F.struct(
                strip(el_key(b)).alias("variable"), p["name"].alias("property"),
                F.concat(F.lit("${"), b, F.lit("}")).alias("expression"),
            ),
        ),
    )
    return F.flatten(per_prop).cast(USES)


def processor_features(
    processors: DataFrame, connections: DataFrame, refs: DataFrame, script_items: DataFrame,
    hosts: DataFrame | None = None,
) -> DataFrame:
    """Feature rows. SQL flags, services and variables come from the row itself; neighbour lists,
    tables and scripts are left joins on the same (template, processor_id) partitioning."""
    from flowlens.operators.scripts import counts

    empty = F.array().cast("array<string>")
    tables = refs.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("table_name")).alias("t"), F.array_sort(F.collect_set("property_name")).alias("tp")
    )
    blob = processors.withColumn("blob", property_blob(F.col("props")))
    rows = (
        blob.join(graph.neighbor_lists(connections), KEY, "left")
        .join(tables, KEY, "left")
        .join(counts(script_items), KEY, "left")
    )
    rows = rows.join(hosts, KEY, "left") if hosts is not None else rows.withColumn("external_hosts", empty)
    return rows.select(
        *KEY, "proc_ord", "name", F.col("type").alias("processor_type"), short_type(F.col("type")).alias("short_type"),
        F.coalesce("parent_group", F.lit("Root")).alias("parent_group"),
        F.coalesce(F.nullif("parent_group_path", F.lit("")), "parent_group", F.lit("Root")).alias("parent_group_path"),
        "props",
        controller_services(F.col("props")).alias("controller_services"),
        F.struct(F.coalesce("incoming", empty).alias("incoming"), F.coalesce("outgoing", empty).alias("outgoing")).alias("connections"),
        F.struct(
            F.coalesce("inline_count", F.lit(0)).alias("inline_count"),
            F.coalesce("external_count", F.lit(0)).alias("external_count"),
            F.coalesce("external_hosts", empty).alias("external_hosts"),
        ).alias("scripts"),
        sql_flags(F.col("blob")).alias("sql"),
        F.struct(F.coalesce("t", empty).alias("tables"), F.coalesce("tp", empty).alias("properties")).alias("tables"),
        F.struct(
            defined_variables(F.col("type"), F.col("props")).alias("defines"),
            used_variables(F.col("props")).alias("uses"),
        ).alias("variables"),
        F.col("blob").rlike(V.EL).alias("uses_variables"),
        (F.coalesce("comments", F.lit("")) != "").alias("has_comments"),
    )
