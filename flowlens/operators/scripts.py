"""Script references of processors: inline, decoded and external, one flat row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions import code
from flowlens.functions.text import (
    decode_base64_text, ends_with_any, normalize_el, prop, redact, short_type, strip,
)
from flowlens.operators import variables

ITEMS = (
    "array<struct<kind:string,property_name:string,path:string,script_type:string,content:string,"
    "content_preview:string,line_count:int>>"
)
KEY = ["template", "processor_id"]


def _item(kind: str, name: Column, path: Column, stype: Column, content: Column, preview: Column, lines: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), name.alias("property_name"), path.alias("path"), stype.alias("script_type"),
        content.alias("content"), preview.alias("content_preview"), lines.cast("int").alias("line_count"),
    )


def _inline(name: Column, stype: Column, content: Column) -> Column:
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return _item("inline", name, F.lit(None).cast("string"), stype, content,
                 redact(F.substring(content, 1, V.PREVIEW_CHARS)), lines)


def _external(name: Column, path: Column) -> Column:
    null = F.lit(None).cast("string")
    return _item("external", name, path, code.script_type(path), null, null, F.lit(None).cast("int"))


def script_items(processors: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Every script of every processor; contents are redacted unless ``keep_raw``."""
    none = F.array().cast(ITEMS)
    props = variables.properties(processors)
    stream = F.lower("type").contains("executestreamcommand")
    name, value = F.col("prop_name"), F.col("prop_value")
    rest = props.filter(~(stream & name.isin("Command Path", "Command Arguments")))
    rest = rest.withColumn("decoded", decode_base64_text(value))
    empty_query = F.coalesce(F.length(strip(value)) <= 1, F.lit(True))
    blank = _item("inline", name, F.lit(None).cast("string"), F.lit("sql"),
                  F.when(F.coalesce(value, F.lit("")) == "", F.lit("(empty)")).otherwise(value),
                  F.lit("(empty)"), F.lit(0))
    query_items = F.when(empty_query, F.array(blank).cast(ITEMS)).otherwise(
        F.array(_inline(name, F.lit("sql"), value)).cast(ITEMS)
    )
    plain = F.when(
        code.looks_like_code(name, value, F.col("type")),
        F.array(_inline(name, code.guess_language(value)["lang"], value)).cast(ITEMS),
    ).otherwise(none)
    decoded = F.when(
        code.looks_like_code(name, F.col("decoded"), F.col("type")),
        F.array(
            _inline(F.concat(name, F.lit(" (decoded)")), code.guess_language(F.col("decoded"))["lang"], F.col("decoded"))
        ).cast(ITEMS),
    ).otherwise(none)
    whole = F.when(
        ends_with_any(value, V.SCRIPT_EXTENSIONS) & value.contains("/") & ~code.not_a_script(value),
        F.array(_external(name, value)).cast(ITEMS),
    ).otherwise(none)
    inside = F.coalesce(
        F.transform(code.script_paths(value), lambda p: _external(name, p)).cast(ITEMS), none
    )
    items = F.when(code.is_query_prop(name), query_items).otherwise(F.concat(plain, decoded, whole, inside))
    from_props = rest.select(
        *KEY, "proc_ord", F.col("name").alias("processor_name"), "type", "parent_group", "prop_ord",
        F.posexplode(items).alias("item_ord", "i"),
    )
    command = strip(F.concat(prop(F.col("props"), "Command Path"), F.lit(" "), prop(F.col("props"), "Command Arguments")))
    from_commands = processors.filter(stream).withColumn("command", command).select(
        *KEY, "proc_ord", F.col("name").alias("processor_name"), "type", "parent_group",
        F.lit(-1).alias("prop_ord"),
        F.posexplode(
            F.transform(code.command_scripts(F.col("command")), lambda p: _external(F.lit("Command Path"), p)).cast(ITEMS)
        ).alias("item_ord", "i"),
    )
    rows = from_commands.unionByName(from_props).select(
        *KEY, "proc_ord", "processor_name", short_type(F.col("type")).alias("processor_type"),
        F.col("parent_group").alias("processor_group"), "prop_ord", "item_ord", "i.*",
    )
    rows = dedupe_inline(rows)
    return rows if keep_raw else rows.withColumn("content", redact(F.col("content")))


def dedupe_inline(rows: DataFrame) -> DataFrame:
    """Inline scripts, one pass: first per (processor, property without the decode mark, whole normalised content)."""
    base = F.replace(F.lower("property_name"), F.lit(" (decoded)"), F.lit(""))
    start = F.sha2(normalize_el(F.col("content"), "ELVAR"), 256)
    own = F.when(F.col("kind") == "external", F.struct("prop_ord", "item_ord"))  # external ones are all kept
    w = W.partitionBy(*KEY, "kind", base, start, own).orderBy("prop_ord", "item_ord")
    placed = rows.repartition(*KEY)  # by processor: also serves the counts and joins that follow
    return placed.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def counts(items: DataFrame) -> DataFrame:
    return items.groupBy(*KEY).agg(
        F.count_if(F.col("kind") == "inline").cast("int").alias("inline_count"),
        F.count_if(F.col("kind") == "external").cast("int").alias("external_count"),
    )


def details(items: DataFrame) -> DataFrame:
    """Scripts re-nested per processor, external ones with a default review note."""
    order = F.struct("prop_ord", "item_ord")
    inline = F.struct(order.alias("o"), F.struct("property_name", "script_type", "content", "line_count", "content_preview").alias("s"))
    external = F.struct(
        order.alias("o"),
        F.struct("path", F.col("script_type").alias("type"), F.col("property_name").alias("property_source"),
                 F.lit(V.REVIEW_NOTE).alias("manual_review_note")).alias("s"),
    )
    pick = lambda kind, s: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, s))), lambda x: x["s"]
    )
    return items.groupBy(*KEY).agg(
        pick("inline", inline).alias("inline_scripts"), pick("external", external).alias("external_scripts")
    )


def processor_hosts(processors: DataFrame) -> DataFrame:
    """External hosts named by processor properties (off in the feature row by default)."""
    found = variables.properties(processors).select(
        *KEY, F.explode(F.concat(code.external_hosts(F.col("prop_value")), code.impala_hosts(F.col("prop_value")))).alias("host")
    )
    return found.groupBy(*KEY).agg(F.array_sort(F.collect_set("host")).alias("external_hosts"))


def query_links(processors: DataFrame) -> DataFrame:
    """Uses of ``${query_N...}`` joined to the query property of the same group that holds the SQL."""
    props = variables.properties(processors)
    queries = props.filter(code.is_query_prop(F.col("prop_name"))).select(
        "template", "parent_group", F.col("prop_name").alias("query"),
        F.struct("proc_ord", F.col("processor_id").alias("id"), F.col("prop_value").alias("sql")).alias("p"),
    ).groupBy("template", "parent_group", "query").agg(F.max("p").alias("p"))
    refs = props.select(
        "template", "parent_group", "processor_id", "prop_name", F.explode(code.query_refs(F.col("prop_value"))).alias("query")
    )
    return refs.join(queries, ["template", "parent_group", "query"]).select(
        "template", "processor_id", "prop_name", "query", F.col("p.id").alias("provider_id"), F.col("p.sql").alias("sql")
    )


def summary(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(F.col("kind") == "external").alias("external_scripts"),
        F.count_if(F.col("kind") == "inline").alias("inline_scripts"),
        F.count_distinct(*KEY).alias("processors"),
        F.count_distinct("script_type").alias("script_types"),
    )


def external_paths(items: DataFrame) -> DataFrame:
    """Distinct script paths per template, for the text sink."""
    return items.filter("kind = 'external'").select("template", "path").distinct()
