"""Row sources of the reports: key details, type inference, dependencies, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.text import el_bodies, has_any, prop, strip
from flowlens.operators import profiles
from flowlens.operators.chains import with_bucket

KEY = ["template", "processor_id"]
DETAILS = "array<struct<label:string,value:string>>"


def key_details(ptype: Column, props: Column) -> Column:
    """The few properties that matter for a manual look, by short type."""
    entry = lambda label, value, keep: F.when(keep, F.struct(F.lit(label).alias("label"), value.alias("value")))
    show = lambda *es: F.array_compact(F.array(*es)).cast(DETAILS)
    filled = lambda label, *names: entry(label, prop(props, *names), prop(props, *names) != "")
    path, args = prop(props, "Command Path"), prop(props, "Command Arguments")
    spaced = F.replace(args, F.lit(";"), F.lit(" "))
    full = F.when(args == "", path).when(path == "", spaced).otherwise(F.concat(path, F.lit(" "), spaced))
    both = F.lower(F.concat(path, F.lit(" "), args))
    purpose = (
        F.when(has_any(both, ["impala-shell", "hive"]), F.lit("Database/SQL operations"))
        .when(has_any(both, ["/bin/mv", "/bin/cp", "/bin/hdfs", "dfs"]), F.lit("File operations"))
        .when(has_any(both, [".sh", "scripts/"]), F.lit("Custom script execution"))
    )
    file_filter = prop(props, "File Filter")
    return (
        F.when(ptype == "ListFile", show(
            filled("Directory", "Input Directory"),
            entry("File Pattern", file_filter, (file_filter != "") & (file_filter != ".*"))))
        .when(ptype == "ExecuteStreamCommand", show(
            entry("Command Path", path, path != ""),
            entry("Arguments", args, args != ""),
            entry("Full Command", full, full != ""),
            filled("Working Dir", "Working Directory"),
            entry("Purpose", purpose, ((path != "") | (args != "")) & purpose.isNotNull())))
        .when(ptype == "PutHDFS", show(
            filled("Output Directory", "Directory", "Output Directory"),
            filled("Conflict Strategy", "Conflict Resolution Strategy")))
        .when(ptype == "FetchFile", show(
            filled("File to Fetch", "File to Fetch"), filled("Completion Strategy", "Completion Strategy")))
        .when(ptype == "SplitContent", show(
            filled("Byte Sequence Format", "Byte Sequence Format"), filled("Byte Sequence", "Byte Sequence")))
        .otherwise(F.array().cast(DETAILS))
    )


def robust_type(raw: Column, full: Column, name: Column) -> Column:
    """Short type from the type, the full type, words in the name, or a cleaned name."""
    usable = lambda c: c.isNotNull() & (strip(c) != "") & (c != "Unknown")
    low = F.lower(name)
    cleaned = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit(" - "), F.lit("_")), " ", "_"), r"[()]", "")
    guess = (
        F.when(~usable(name), F.lit("Unknown"))
        .when(has_any(low, ["add configuration", "add queries"]), F.lit("UpdateAttribute"))
        .when(has_any(low, ["split", "flowfile per", "per type", "separate"]), F.lit("SplitContent"))
        .when(low.contains("move") & low.contains("file"), F.lit("ExecuteStreamCommand"))
        .otherwise(F.concat(F.lit("Custom_"), F.substring(cleaned, 1, 15)))
    )
    short = lambda c: F.substring_index(c, ".", -1)
    picked = F.when(usable(raw), short(raw)).when(usable(full), short(full)).otherwise(guess)
    return F.when(strip(picked) == "", F.lit("Unknown")).otherwise(picked)


def sql_query_props(props: Column) -> Column:
    """Names of query properties that hold SQL."""
    held = F.filter(
        props,
        lambda p: p["name"].contains("query_") & has_any(F.upper(F.coalesce(p["value"], F.lit(""))), ["SELECT", "INSERT", "ALTER", "REFRESH"]),
    )
    return F.transform(held, lambda p: p["name"])


def dependencies(records: DataFrame) -> DataFrame:
    """Processors that set a placeholder used by essential ones, or whose name says they configure."""
    rows = with_bucket(records)
    values = lambda df: df.select(*KEY, F.explode("props").alias("p"))
    needed = values(rows.filter("bucket = 'essential'")).filter(F.col("p.value").contains("${")).select(
        "template", F.explode(el_bodies(F.col("p.value"))).alias("placeholder")
    ).distinct()
    kept = rows.filter("bucket <> 'ambiguous'")
    setting = values(kept).select(*KEY, F.col("p.ord").alias("ord"), F.col("p.name").alias("placeholder")).join(
        needed, ["template", "placeholder"], "left_semi"
    ).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "placeholder"))), lambda x: x["placeholder"]).alias("defines"))
    configures = F.col("processor_type").contains("UpdateAttribute") & has_any(F.col("name"), V.DEPENDENCY_NAME_WORDS)
    any_needed = needed.select("template").distinct()
    out = kept.join(setting, KEY, "left").join(any_needed, "template", "left_semi").filter(
        F.col("defines").isNotNull() | configures
    )
    return out.withColumn(
        "dependency_reason",
        F.when(F.col("defines").isNotNull(), F.concat(F.lit("Defines variables: "), F.array_join("defines", ", ")))
        .otherwise(F.lit("Contains SQL queries/configuration")),
    ).withColumn("dependency_category", dependency_category()).withColumn("sql_queries", sql_query_props(F.col("props"))).select(
        *KEY, "name", "processor_type", "bucket", "dependency_reason", "dependency_category",
        F.size("sql_queries").alias("sql_query_count"),
    )


def dependency_category() -> Column:
    name, kind = F.lower("name"), F.lower("processor_type")
    own = F.size(F.filter("props", lambda p: ~p["name"].startswith("Delete")))
    return (
        F.when(name.contains("add queries"), F.lit("sql_queries"))
        .when(has_any(name, ["add configuration", "add config"]), F.lit("configuration"))
        .when(kind.contains("extracttext") | name.contains("filename breakdown"), F.lit("data_extraction"))
        .when(kind.contains("generateflowfile") | has_any(name, ["time", "timestamp", "current", "mem_limit"]), F.lit("dynamic_values"))
        .when(kind.contains("routeonattribute") | name.contains("split loaders"), F.lit("routing_logic"))
        .when(own > 3, F.lit("configuration"))
        .otherwise(F.lit("data_extraction"))
    )


def essential_counts(records: DataFrame) -> DataFrame:
    """Essential processors per category in a fixed order."""
    order = F.array_position(F.array(*[F.lit(c) for c in V.ESSENTIAL_CATEGORIES]), F.col("migration_category"))
    return with_bucket(records).filter("bucket = 'essential'").groupBy("migration_category").agg(F.count("*").alias("n")).select(
        order.alias("position"), "migration_category", "n"
    )


def neighbor_records(records: DataFrame, connections: DataFrame) -> DataFrame:
    """Upstream and downstream neighbours as {processor_id, name, short_type} structs, in edge order."""
    from flowlens.operators import graph

    info = records.select("template", F.col("processor_id").alias("id"), F.struct("processor_id", "name", "short_type").alias("info"))
    edges = graph.edges_of(connections)
    side = lambda own, other, label: edges.select(
        "template", F.col(own).alias("processor_id"), F.col(other).alias("id"), "conn_ord", F.lit(label).alias("side"))
    both = side("src", "dst", "down").unionByName(side("dst", "src", "up")).join(info, ["template", "id"])
    pick = lambda label: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == label, F.struct("conn_ord", "info")))), lambda x: x["info"])
    near = both.groupBy(*KEY).agg(pick("up").alias("upstream_processors"), pick("down").alias("downstream_processors"))
    none = F.array().cast("array<struct<processor_id:string,name:string,short_type:string>>")
    return records.join(near, KEY, "left").withColumns({
        c: F.coalesce(c, none) for c in ("upstream_processors", "downstream_processors")
    })


def compose_document(rows: DataFrame) -> Column:
    """Slim JSON for rows without code, the full row otherwise."""
    slim = ["processor_id", "name", "short_type", "migration_category", "databricks_target", "recommended_target", "has_code", "databricks_code"]
    return F.when(F.col("has_code"), F.to_json(F.struct(*rows.columns))).otherwise(
        F.to_json(F.struct(*[c for c in slim if c in rows.columns])))


def payload_rows(records: DataFrame, connections: DataFrame, script_details: DataFrame | None = None) -> DataFrame:
    """Per-processor payload: flags, neighbour types, variables, services, script summaries."""
    e = "feature_evidence"
    rows = records.join(profiles.neighbor_types(records, connections), KEY, "left")
    none = F.array().cast("array<string>")
    names = lambda path: F.array_sort(F.array_distinct(F.filter(F.transform(F.col(f"{e}.variables.{path}"), lambda v: v["variable"]), lambda v: v != "")))
    group = F.coalesce(F.nullif("parent_group", F.lit("")), F.lit("Root"))
    columns = [
        "processor_id", "template", "name", F.coalesce(F.nullif("short_type", F.lit("")), "processor_type").alias("short_type"),
        group.alias("group"), F.coalesce(F.nullif("parent_group_path", F.lit("")), group).alias("group_path"),
        F.coalesce("migration_category", F.lit(V.AMBIGUOUS)).alias("migration_category"), "databricks_target",
        "classification_source", "rule", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.struct(
            F.col(f"{e}.sql.has_sql").alias("has_sql"), F.col(f"{e}.sql.has_dml").alias("has_dml"),
            F.col(f"{e}.sql.has_metadata_only").alias("sql_metadata_only"),
            F.col(f"{e}.scripts.inline_count").alias("inline_script_count"),
            F.col(f"{e}.scripts.external_count").alias("external_script_count"),
            F.col(f"{e}.scripts.external_hosts").alias("external_hosts"), F.col(f"{e}.tables.tables").alias("tables"),
            F.col(f"{e}.tables.properties").alias("table_properties"), F.col(f"{e}.uses_variables").alias("uses_variables"),
        ).alias("feature_summary"),
        F.struct(F.coalesce("incoming_types", none).alias("incoming_types"), F.coalesce("outgoing_types", none).alias("outgoing_types")).alias("lineage_summary"),
        F.struct(names("defines").alias("defines"), names("uses").alias("uses")).alias("variables"),
        F.array_sort(F.array_distinct(f"{e}.controller_services")).alias("controller_services"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    ]
    if script_details is not None:
        rows = rows.join(script_details, KEY, "left")
        columns.append(F.struct(
            F.transform("inline_scripts", lambda s: F.struct(
                s["property_name"].alias("property"), s["script_type"].alias("language"), s["line_count"].alias("line_count"),
                s["content"].alias("content"), s["content_preview"].alias("preview"))).alias("inline"),
            F.col("external_scripts").alias("external"),
        ).alias("scripts"))
    return rows.select(*columns)


def payload_document(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """{processor_count, processors[]} JSON per key; meant for batch-sized groups."""
    return payloads.groupBy(*keys).agg(
        F.to_json(F.struct(F.count("*").alias("processor_count"), F.array_sort(F.collect_list(F.struct(*payloads.columns))).alias("processors"))).alias("doc")
    )


def records_frame(records: DataFrame) -> DataFrame:
    """Planner frame: defaults for missing cells, first row per processor id."""
    from pyspark.sql import Window as W

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    w = W.partitionBy("processor_id").orderBy("template", "proc_ord")
    rows = records.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return rows.select(
        text("processor_id"), text("template"), text("name"), text("short_type"), text("parent_group"),
        text("parent_group_path"), F.coalesce("migration_category", F.lit(V.AMBIGUOUS)).alias("migration_category"),
        text("databricks_target"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        text("classification_source"), text("rule"), text("notes"),
    )


def enriched(batch: DataFrame, results: DataFrame) -> DataFrame:
    """Left join of enrichment results on the processor id; their confidence wins."""
    extra = [c for c in results.columns if c not in batch.columns and c != "processor_id"]
    r = results.select("processor_id", *extra, F.col("confidence").alias("new_confidence"))
    return batch.join(r, "processor_id", "left").withColumn("confidence", F.coalesce("new_confidence", "confidence")).drop("new_confidence")
