"""Group profiles, feature matrix and rule suggestions derived from classification records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.text import contains_keyword, flag, strip
from flowlens.operators import graph

KEY = ["template", "processor_id"]
E = "feature_evidence"


def group_path() -> Column:
    """Stable group path: the path, else the group name, else Root."""
    return F.coalesce(F.nullif(strip(F.col("parent_group_path")), F.lit("")),
                      F.nullif(strip(F.col("parent_group")), F.lit("")), F.lit("Root"))


def leaf_name(path: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(F.btrim(path, F.lit("/")), "/"), -1), F.lit("")), F.lit("Root"))


def _dominant(counts: Column) -> Column:
    return F.array_max(F.transform(counts, lambda c: F.struct(c["n"].alias("n"), c["category"].alias("category"))))["category"]


def group_profiles(records: DataFrame, connections: DataFrame) -> DataFrame:
    """One row per (template, group path). Sets are made distinct before they are collected."""
    placed = records.withColumn("group_path", group_path()).withColumn(
        "category", F.coalesce("migration_category", F.lit(V.AMBIGUOUS))
    )
    group = ["template", "group_path"]
    inline, external = F.col(f"{E}.scripts.inline_count"), F.col(f"{E}.scripts.external_count")
    per_category = placed.groupBy(*group, "category").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("category") == V.AMBIGUOUS) | (F.coalesce("confidence", F.lit(0.0)) < 0.5)).alias("unsure"),
        F.sum(inline).alias("inline_n"), F.sum(external).alias("external_n"),
        F.min_by(F.coalesce(F.nullif("parent_group", F.lit("")), leaf_name(F.col("group_path"))), "proc_ord").alias("label"),
        F.min("proc_ord").alias("first_ord"),
    )
    totals = per_category.groupBy(*group).agg(
        F.min_by("label", "first_ord").alias("group"),
        F.sum("n").alias("processor_count"),
        F.array_sort(F.collect_list(F.struct("category", "n"))).alias("counts"),
        F.sum(F.when(F.col("category") != V.INFRASTRUCTURE, F.col("n")).otherwise(0)).alias("needs_migration_count"),
        F.sum("unsure").alias("ambiguous_count"),
        F.sum("inline_n").alias("inline_script_total"), F.sum("external_n").alias("external_script_total"),
    )
    tag = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    members = placed.select(*group, F.explode(F.concat(
        F.transform(f"{E}.variables.defines", lambda d: tag("defined", d["variable"])),
        F.transform(f"{E}.variables.uses", lambda u: tag("used", u["variable"])),
        F.transform(f"{E}.controller_services", lambda s: tag("service", s)),
        F.when(external > 0, F.array(tag("external", F.to_json(F.struct(F.col("processor_id").alias("id"), "name")))))
        .otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
    )).alias("m")).select(*group, "m.*")
    homes = placed.select("template", F.col("processor_id").alias("pid"), "group_path")
    edges = graph.edges_of(connections).select("template", "src", "dst")
    crossing = (
        edges.join(homes.select("template", F.col("pid").alias("src"), F.col("group_path").alias("src_path")), ["template", "src"])
        .join(homes.select("template", F.col("pid").alias("dst"), F.col("group_path").alias("dst_path")), ["template", "dst"])
        .filter("src_path <> dst_path")
        .select("template", F.explode(F.array(
            F.struct(F.col("dst_path").alias("group_path"), F.lit("incoming").alias("kind"), F.col("src_path").alias("value")),
            F.struct(F.col("src_path").alias("group_path"), F.lit("outgoing").alias("kind"), F.col("dst_path").alias("value")),
        )).alias("x")).select("template", "x.*")
    )
    pick = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(name)
    sets = members.filter("value <> ''").unionByName(crossing).distinct().groupBy(*group).agg(
        pick("external", "external_script_processors"), pick("defined", "variables_defined"), pick("used", "variables_used"),
        pick("service", "controller_services"), pick("incoming", "incoming_groups"), pick("outgoing", "outgoing_groups"),
    )
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    return totals.join(sets, group, "left").select(
        "template", "group", "group_path", "processor_count",
        F.map_from_entries("counts").alias("migration_category_counts"),
        _dominant(F.col("counts")).alias("dominant_category"),
        "needs_migration_count", "ambiguous_count", "inline_script_total", "external_script_total",
        (F.col("external_script_total") > 0).alias("has_external_scripts"),
        F.transform(listed("external_script_processors"), lambda j: F.from_json(j, "id string, name string")).alias("external_script_processors"),
        *[listed(c).alias(c) for c in ("variables_defined", "variables_used", "controller_services", "incoming_groups", "outgoing_groups")],
        F.size(listed("incoming_groups")).alias("incoming_group_count"),
        F.size(listed("outgoing_groups")).alias("outgoing_group_count"),
    )


def group_overview(profiles: DataFrame, width: int = 120) -> DataFrame:
    """Display rows: category mix as text and lists joined, cut to the column width."""
    cut = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
    mix = F.array_join(
        F.transform(F.map_entries("migration_category_counts"), lambda e: F.concat_ws(": ", e["key"], e["value"].cast("string"))), ", "
    )
    return profiles.select(
        "template", "group", "group_path", "processor_count", mix.alias("category_mix"), "dominant_category",
        "needs_migration_count", "ambiguous_count",
        *[cut(F.array_join(c, ", ")).alias(c) for c in ("variables_defined", "variables_used", "controller_services")],
        "incoming_group_count", "outgoing_group_count",
    )


def neighbor_types(records: DataFrame, connections: DataFrame) -> DataFrame:
    """Distinct short types upstream and downstream of each processor."""
    kinds = records.select("template", F.col("processor_id").alias("pid"), F.coalesce(F.nullif("short_type", F.lit("")), "processor_type").alias("t"))
    edges = graph.edges_of(connections).select("template", "src", "dst")
    typed = (
        edges.join(kinds.select("template", F.col("pid").alias("src"), F.col("t").alias("src_type")), ["template", "src"], "left")
        .join(kinds.select("template", F.col("pid").alias("dst"), F.col("t").alias("dst_type")), ["template", "dst"], "left")
    )
    sides = typed.select("template", F.explode(F.array(
        F.struct(F.col("dst").alias("processor_id"), F.lit("in").alias("side"), F.col("src_type").alias("t")),
        F.struct(F.col("src").alias("processor_id"), F.lit("out").alias("side"), F.col("dst_type").alias("t")),
    )).alias("x")).select("template", "x.*")
    pick = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("t"))))
    return sides.groupBy(*KEY).agg(pick("in").alias("incoming_types"), pick("out").alias("outgoing_types"))


def feature_matrix(
    records: DataFrame, connections: DataFrame, include_ambiguous: bool = False, min_confidence: float = 0.0
) -> DataFrame:
    """33 base columns, 10 keyword flags and 25 x 2 neighbour flags per processor."""
    category = F.coalesce("migration_category", F.lit(V.AMBIGUOUS))
    confidence = F.coalesce("confidence", F.lit(0.0))
    rows = records.join(neighbor_types(records, connections), KEY, "left")
    if not include_ambiguous:
        rows = rows.filter((category != V.AMBIGUOUS) & (confidence >= min_confidence))
    c = lambda path: F.col(f"{E}.{path}")
    incoming, outgoing = F.size(c("connections.incoming")), F.size(c("connections.outgoing"))
    values = F.transform(F.filter("props", lambda p: p["value"].isNotNull()), lambda p: F.lower(p["value"]))
    text = F.concat_ws(" ", F.array_join(F.transform(c("controller_services"), F.lower), " "), F.array_join(values, " "))
    base = [
        "template", "processor_id", F.col("name").alias("processor_name"), "processor_type", "short_type", "parent_group",
        "parent_group_path", category.alias("migration_category"), confidence.alias("confidence"), "classification_source",
        "databricks_target", "rule", flag(F.col("classification_source") == "promotion").alias("promotion_applied"),
        flag(F.exists("props", lambda p: F.coalesce(p["value"], F.lit("")).contains("${"))).alias("uses_expression_language"),
        flag(c("uses_variables")).alias("uses_variables"), flag(c("sql.has_sql")).alias("sql_has_sql"),
        flag(c("sql.has_dml")).alias("sql_has_dml"), flag(c("sql.has_metadata_only")).alias("sql_has_metadata_only"),
        c("scripts.inline_count").alias("scripts_inline_count"), c("scripts.external_count").alias("scripts_external_count"),
        flag(c("scripts.inline_count") > 0).alias("scripts_has_inline"), flag(c("scripts.external_count") > 0).alias("scripts_has_external"),
        F.size(F.array_distinct(c("scripts.external_hosts"))).alias("scripts_external_hosts_count"),
        F.size(c("tables.tables")).alias("table_count"), F.size(c("tables.properties")).alias("table_property_reference_count"),
        F.size(c("variables.defines")).alias("variables_define_count"), F.size(c("variables.uses")).alias("variables_use_count"),
        F.size(c("controller_services")).alias("controller_service_count"), incoming.alias("incoming_count"),
        outgoing.alias("outgoing_count"), flag(incoming > 1).alias("is_fanin"), flag(outgoing > 1).alias("is_fanout"),
        flag(outgoing == 0).alias("is_terminal"),
    ]
    words = [flag(contains_keyword(text, ks)).alias(n) for n, ks in V.CONTROLLER_KEYWORDS.items()]
    words += [flag(contains_keyword(F.col("name"), ks)).alias(n) for n, ks in V.NAME_KEYWORDS.items()]
    words += [flag(contains_keyword(F.col("parent_group"), ks)).alias(n) for n, ks in V.GROUP_KEYWORDS.items()]
    near = [
        flag(F.array_contains(f"{side}_types", t)).alias(f"{side}_has_{t.lower()}")
        for side in ("incoming", "outgoing") for t in V.NEIGHBOR_TYPES
    ]
    return rows.select(*base, *words, *near)


def rule_suggestions(
    flat: DataFrame, covered: list[str] | None = None, evidence: int = 0
) -> DataFrame:
    """Suggested rule per processor type from the summary rows.

    ``covered`` lists full or short types to leave out; ``evidence`` attaches that many example rows.
    """
    if "processor_type" not in flat.columns:
        raise ValueError("summary rows must include a 'processor_type' column")
    rows = flat.filter("processor_type <> ''")
    short = F.substring_index("processor_type", ".", -1)
    if covered:
        rows = rows.filter(~F.col("processor_type").isin(*covered) & ~short.isin(*covered))
    number = lambda c: F.avg(F.col(c).cast("double"))
    means = rows.groupBy("processor_type").agg(
        F.count("*").alias("processors"), number("sql_has_dml").alias("dml"), number("sql_has_metadata_only").alias("meta"),
        number("scripts_inline_count").alias("inline"), number("scripts_external_count").alias("external"),
        number("uses_variables").alias("vars"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    ladder = (
        (z("dml") > 0.2, V.BUSINESS, "SQL transformation"),
        (z("external") > 0.5, V.SOURCE, "External script"),
        ((z("inline") == 0) & (z("dml") == 0) & (z("external") == 0), V.SINK, "Delta write"),
        (z("vars") > 0.5, V.ORCHESTRATION, "Workflow control"),
        (F.lit(True), V.INFRASTRUCTURE, "Workflow plumbing"),
    )
    category = target = F.lit(None).cast("string")
    for condition, cat, tgt in reversed(ladder):
        category = F.when(condition, F.lit(cat)).otherwise(category)
        target = F.when(condition, F.lit(tgt)).otherwise(target)
    labels = (("sql_has_dml", "dml"), ("sql_has_metadata_only", "meta"), ("inline_scripts", "inline"),
              ("external_scripts", "external"), ("uses_variables", "vars"))
    notes = F.concat_ws(
        "; ", F.format_string("Derived from %d processor(s)", "processors"),
        *[F.when(F.col(c).isNotNull(), F.format_string(f"avg {label}=%.2f", F.bround(F.col(c), 2))) for label, c in labels],
    )
    out = means.select(
        F.concat(F.lit("Auto: "), short).alias("name"), "processor_type", category.alias("migration_category"),
        target.alias("databricks_target"), notes.alias("notes"),
    )
    if evidence:
        w = W.partitionBy("processor_type").orderBy("template", "processor_id")
        examples = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= evidence).groupBy("processor_type").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", F.struct(
                "processor_id", F.col("processor_name").alias("name"), "template", "migration_category", "confidence").alias("e")))),
                lambda x: x["e"]).alias("evidence")
        )
        out = out.join(examples, "processor_type")
    return out


def covered_types(rules: list[dict]) -> list[str]:
    return sorted({t for r in rules for f in ("processor_types", "processor_short_types") for t in (r.get(f) or [])})
