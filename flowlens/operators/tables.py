"""Table references of processors: property, SQL and warehouse-path steps, inheritance, dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions import scoring, sqltext
from flowlens.functions.text import (
    canonical_type, el_bodies, el_key, has_any, normalize_el, resolve_el, strip,
)
from flowlens.operators import variables
from flowlens.operators.graph import resolve_variables
from flowlens.session import cut

REFS = (
    "array<struct<table_name:string,source:string,sql_clause:string,io_type:string,confidence:double>>"
)


def variable_maps(processors: DataFrame, connections: DataFrame) -> DataFrame:
    """Per processor, the resolved values of just the variables its own properties mention.

    Only variables that some property of the template mentions are resolved at all.
    """
    needed = cut(
        variables.properties(processors)
        .filter(F.col("prop_value").contains("${"))
        .select("template", "processor_id", F.explode(el_bodies(F.col("prop_value"))).alias("body"))
        .select("template", "processor_id", el_key(F.col("body")).alias("variable"))
        .distinct()
    )
    literals = variables.literals(variables.definitions(processors)).join(
        needed.select("template", "variable").distinct(), ["template", "variable"], "left_semi"
    ).select("template", "processor_id", "variable", "value")
    values = resolve_variables(literals, connections, processors)
    return values.join(needed, ["template", "processor_id", "variable"]).groupBy("template", "processor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "value"))).alias("values")
    )


def resolved_properties(processors: DataFrame, connections: DataFrame) -> DataFrame:
    """Flat non-empty properties with trimmed ``prop_value`` after expression resolution."""
    props = variables.properties(processors).filter(F.col("prop_value") != "")
    maps = variable_maps(processors, connections)
    empty = F.create_map().cast("map<string,string>")
    return (
        props.join(maps, ["template", "processor_id"], "left")
        .withColumn("prop_value", strip(F.col("prop_value")))
        .withColumn("prop_value", resolve_el(F.col("prop_value"), F.coalesce("values", empty), passes=1))  # values hold no ${
        .drop("values")
    )


def plain_properties(processors: DataFrame) -> DataFrame:
    return (
        variables.properties(processors)
        .filter(F.col("prop_value") != "")
        .withColumn("prop_value", strip(F.col("prop_value")))
    )


def property_ref(learned: Column | None = None) -> Column:
    """Direct table-name properties; io by processor type."""
    low, ptype = F.col("prop_lower"), F.lower("type")
    score = scoring.table_score(normalize_el(F.col("prop_value")), F.col("ptype"), low, None, learned)
    wanted = (
        ~F.col("type").contains("GenerateFlowFile")
        & (low != "entity")
        & has_any(low, V.TABLE_PROPERTY_WORDS)
        & (F.col("prop_value") != "")
        & (score >= V.SCORE_THRESHOLD)
    )
    io = (
        F.when(has_any(ptype, V.WRITER_TYPES), F.lit("write"))
        .when(has_any(ptype, V.READER_TYPES), F.lit("read"))
        .otherwise(F.lit("unknown"))
    )
    return _one(wanted, F.col("prop_value"), "property", io)


def path_ref() -> Column:
    table = sqltext.warehouse_table(F.col("prop_value"))
    io = F.when(has_any(F.col("prop_lower"), V.TARGET_PROPERTY_WORDS), F.lit("write")).otherwise(F.lit("unknown"))
    return _one(table.isNotNull(), table, "path", io)


def _one(condition: Column, table: Column, source: str, io: Column) -> Column:
    null = F.lit(None)
    ref = F.array(F.struct(table.alias("table_name"), F.lit(source).alias("source"), null.cast("string").alias("sql_clause"),
                           io.alias("io_type"), null.cast("double").alias("confidence"))).cast(REFS)
    return F.when(F.coalesce(condition, F.lit(False)), ref).otherwise(F.array().cast(REFS))


def extract(props: DataFrame, compat: bool = False) -> DataFrame:
    """References per property in scan order (property, SQL, path). Narrow: no shuffle."""
    staged = props.withColumn("prop_lower", F.lower("prop_name")).withColumn("ptype", canonical_type(F.col("type")))
    is_sql = has_any(F.col("prop_lower"), V.SQL_PROPERTY_WORDS)
    staged = staged.withColumn("sql_clean", F.when(is_sql, sqltext.clean_sql(F.col("prop_value"))))
    staged = staged.withColumn(
        "hits", F.when(F.col("sql_clean") != "", sqltext.clause_hits(F.col("sql_clean"), compat))
    )
    staged = staged.withColumn(
        "good",
        F.when(F.size("hits") > 0, sqltext.accepted(F.col("hits"), F.col("ptype"), F.col("prop_lower"))),
    )
    none = F.array().cast(REFS)
    sql_refs = F.when(F.size("good") > 0, sqltext.folded_refs(F.col("good")).cast(REFS)).otherwise(none)
    refs = F.concat(property_ref(), sql_refs, path_ref())
    return staged.select(
        "template", "proc_ord", "processor_id", F.col("name").alias("processor_name"),
        F.col("ptype").alias("processor_type"), "prop_ord", F.col("prop_name").alias("property_name"),
        F.posexplode(refs).alias("step", "r"),
    ).select(
        "template", "proc_ord", "processor_id", "processor_name", "processor_type", "prop_ord",
        "property_name", "step", "r.*",
    )


def first_per_io(refs: DataFrame) -> DataFrame:
    """First reference per (processor, table, io) in scan order.

    Rows are partitioned by processor, which also serves the aggregations and joins that follow.
    """
    refs = refs.repartition("template", "processor_id")
    order = W.partitionBy("template", "processor_id", "table_name", "io_type").orderBy("proc_ord", "prop_ord", "step")
    return refs.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def inherited(refs: DataFrame, processors: DataFrame) -> DataFrame:
    """References passed to SQL-running consumers of a variable set by a processor with SQL.

    Tables are made distinct per variable, and users distinct per variable, before the two meet.
    """
    defs, uses = variables.definitions(processors), variables.usages(processors)
    order = F.struct("proc_ord", "prop_ord", "step")
    sources = (
        refs.filter("source = 'sql'")
        .join(defs.select("template", "processor_id", "variable"), ["template", "processor_id"])
        .groupBy("template", "variable", "table_name", "io_type")
        .agg(
            F.min_by(
                F.struct(
                    F.col("sql_clause"), F.col("confidence"), F.col("processor_id").alias("origin_processor_id"),
                    F.col("property_name").alias("origin_property_name"),
                ),
                order,
            ).alias("o")
        )
        .select("template", "variable", "table_name", "io_type", "o.*")
    )
    takers = (
        uses.withColumn("ptype", canonical_type(F.col("processor_type")))
        .filter(F.col("ptype").isin(*V.INHERITING_TYPES))
        .groupBy("template", "variable", "processor_id")
        .agg(
            F.min_by(
                F.struct("proc_ord", "prop_ord", "property_name", "processor_name", F.col("ptype").alias("processor_type")),
                F.struct("prop_ord", "use_ord"),
            ).alias("u")
        )
        .select("template", "variable", "processor_id", "u.*")
    )
    offered = takers.join(sources, ["template", "variable"]).select(
        "template", "proc_ord", "processor_id", "processor_name", "processor_type",
        F.col("prop_ord"), "property_name", F.lit(1_000_000).alias("step"), "table_name",
        F.lit("sql").alias("source"), "sql_clause", "io_type", "confidence", "origin_processor_id", "origin_property_name",
        "variable",
    )
    key = ["template", "processor_id", "table_name", "io_type"]
    fresh = offered.join(refs.select(*key), key, "left_anti")
    best = W.partitionBy(*key).orderBy("variable", "origin_processor_id")
    return fresh.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn", "variable")


def table_refs(
    processors: DataFrame,
    connections: DataFrame,
    resolve: bool = True,
    inherit: bool = True,
    inventory: bool = False,
    compat: bool = False,
) -> DataFrame:
    """All table references of a corpus.

    ``inventory`` keeps one row per (template, lower(table), processor type), as the reference's table list does.
    """
    props = resolved_properties(processors, connections) if resolve else plain_properties(processors)
    refs = first_per_io(extract(props, compat))
    if inherit:
        refs = cut(refs)  # read three times below: as sources, as known keys, and as output
        refs = refs.unionByName(inherited(refs, processors), allowMissingColumns=True)
    refs = refs.filter(~F.lower("table_name").isin(*V.NOT_TABLES))
    return inventory_of(refs) if inventory else refs


def inventory_of(refs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """First row per (lower(table), processor type) within the scope (a template by default)."""
    scope = ["template"] if scope is None else scope
    order = W.partitionBy(*scope, F.lower("table_name"), "processor_type").orderBy(
        F.col("source").isNull(), "template", F.col("step") >= 1_000_000, "proc_ord", "prop_ord", "step", "table_name"
    )
    return refs.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


# --- summaries -----------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts of a column, most frequent first; ``k`` is the report's top-k."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts if k is None else counts.orderBy(F.desc("n"), "value").limit(k)


def summary(refs: DataFrame, k: int = 5) -> DataFrame:
    """Total plus top processor types and property names, as (section, value, n)."""
    total = refs.agg(F.count("*").alias("n")).select(F.lit("total_tables").alias("section"), F.lit("").alias("value"), "n")
    tops = [
        value_counts(refs, column, k).select(F.lit(section).alias("section"), "value", "n")
        for section, column in (("top_processors", "processor_type"), ("property_types", "property_name"))
    ]
    return total.unionByName(tops[0]).unionByName(tops[1])


def corpus_summary(refs: DataFrame, templates: DataFrame) -> DataFrame:
    """Files scanned, files with tables, references and distinct counts."""
    counted = refs.agg(
        F.count_distinct("template").alias("templates_with_tables"),
        F.count("*").alias("total_refs"),
        F.count_distinct("table_name").alias("distinct_tables"),
        F.count_distinct("template", "processor_id").alias("distinct_processors"),
    )
    scanned = templates.agg(F.count_distinct("template").alias("templates"))
    both = scanned.unionByName(counted, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
