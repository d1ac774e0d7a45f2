"""Variable definitions, usages, summaries and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.text import el_bodies, el_key, has_any, strip
from flowlens.operators.graph import components, flattened_edges, reached, simple_paths, walks
from flowlens.session import cut, cut_counted, off_driver


def properties(processors: DataFrame) -> DataFrame:
    """Flat properties in document order (a narrow explode of the nested rows)."""
    return processors.select(
        "template", "proc_ord", "processor_id", "name", "type", "parent_group", F.explode("props").alias("p")
    ).select(
        "template", "proc_ord", "processor_id", "name", "type", "parent_group",
        F.col("p.ord").alias("prop_ord"), F.col("p.name").alias("prop_name"), F.col("p.value").alias("prop_value"),
    )


def definitions(processors: DataFrame) -> DataFrame:
    """Attribute-setting properties: one row per (processor, variable)."""
    kind, name, value = F.col("type"), F.col("prop_name"), F.col("prop_value")
    extracting = kind.contains("ExtractText")
    usable = (
        (value != "")
        & ~(extracting & (name.isin(*V.EXTRACT_TEXT_SETTINGS) | name.rlike(r"(?U)\s")))
        & ~name.rlike(V.EL)
    )
    defining = processors.filter(has_any(kind, V.DEFINING_TYPES))
    return properties(defining).filter(usable).select(
        "template", "proc_ord", "processor_id", F.col("name").alias("processor_name"),
        kind.alias("processor_type"), F.col("parent_group").alias("parent_group_name"), "prop_ord",
        name.alias("variable"), name.alias("property_name"), value.alias("property_value"),
        F.when(value.contains("${"), F.lit("dynamic")).otherwise(F.lit("static")).alias("definition_type"),
    )


def usages(processors: DataFrame) -> DataFrame:
    """Every ``${...}`` occurrence: one row each, named by the text before the first colon."""
    return (
        properties(processors)
        .filter(F.col("prop_value").contains("${"))
        .select("*", F.posexplode(el_bodies(F.col("prop_value"))).alias("use_ord", "full_expression"))
        .select(
            "template", "proc_ord", "processor_id", F.col("name").alias("processor_name"),
            F.col("type").alias("processor_type"), F.col("parent_group").alias("parent_group_name"),
            "prop_ord", "use_ord", strip(el_key(F.col("full_expression"))).alias("variable"),
            F.col("prop_name").alias("property_name"), F.col("prop_value").alias("property_value"),
            F.concat(F.lit("${"), "full_expression", F.lit("}")).alias("variable_expression"),
            "full_expression", F.col("full_expression").contains(":").alias("has_functions"),
        )
    )


def literals(defs: DataFrame) -> DataFrame:
    """Static values a processor assigns, as (template, processor_id, variable, value); of repeated ones the last wins."""
    return defs.filter("definition_type = 'static'").groupBy("template", "processor_id", "variable").agg(
        F.max_by("property_value", F.struct("proc_ord", "prop_ord")).alias("value")
    )


def events(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Definitions and usages as one slim stream of (template, variable, processor_id, is_def)."""
    pick = lambda df, is_def: df.select("template", "variable", "processor_id", F.lit(is_def).alias("is_def"))
    return pick(defs, True).unionByName(pick(uses, False))


def summary(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Counts per variable; the full outer join of definitions and usages as one aggregation."""
    return (
        events(defs, uses)
        .groupBy("template", "variable", "processor_id")
        .agg(F.count_if("is_def").alias("d"), F.count_if(~F.col("is_def")).alias("u"))
        .groupBy("template", "variable")
        .agg(
            F.sum("d").alias("definition_count"),
            F.sum("u").alias("usage_count"),
            F.count("*").alias("processor_count"),
        )
        .withColumn("is_defined", F.col("definition_count") > 0)
        .withColumn("is_external", F.col("definition_count") == 0)
    )


def totals(variable_summary: DataFrame) -> DataFrame:
    return variable_summary.groupBy("template").agg(
        F.count("*").alias("total_variables"),
        F.count_if("is_defined").alias("defined_variables"),
        F.count_if("is_external").alias("external_variables"),
    )


def actions(variable_summary: DataFrame, status: str | None = None, min_usage: int = 0) -> DataFrame:
    """Action table: status label, minimum usage, busiest variables first."""
    rows = variable_summary.withColumn(
        "status", F.when(F.col("is_external"), F.lit("External")).otherwise(F.lit("Defined"))
    ).filter(F.col("usage_count") >= min_usage)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("processor_count"), "template", "variable")


def details(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Definition and usage rows side by side, tagged by role."""
    d = defs.select("template", "variable", "processor_id", "processor_name", "processor_type", "property_name",
                    F.lit("Defines").alias("action"), F.col("property_value").alias("value"))
    u = uses.select("template", "variable", "processor_id", "processor_name", "processor_type", "property_name",
                    F.lit("Uses").alias("action"), F.col("variable_expression").alias("value"))
    return d.unionByName(u)


#: Variables are followed within a template and apart from each other.
KEYS = ["template", "variable"]


def flows(
    processors: DataFrame, connections: DataFrame, through: str = "ports", max_nodes: int | None = None, stride: int = 4
) -> DataFrame:
    """All simple paths from a definer of a variable to any of its users.

    A variable is followed only along edges that lie between its definers and its users: nodes that definers
    reach, then of these the ones that reach a user. Without cycles every path walked so is the beginning
    of a row of the result.
    """
    return _flows(*_flow_graph(processors, connections, through), max_nodes, stride)


def _flow_graph(processors: DataFrame, connections: DataFrame, through: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between processors; definers and users (template, variable, node) of variables that have both."""
    at = lambda rows: rows.select(*KEYS, F.col("processor_id").alias("node")).distinct()
    set_by, ends = cut(at(definitions(processors))), at(usages(processors))
    ends = cut(ends.join(set_by, KEYS, "left_semi"))
    starts = set_by.join(ends, KEYS, "left_semi")
    return cut(flattened_edges(connections, processors, through).select("template", "src", "dst", "relationships")), starts, ends


def _flows(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_nodes: int | None, stride: int) -> DataFrame:
    ahead = reached(edges, starts, KEYS)
    onward = cut(edges.join(ahead.withColumnRenamed("node", "src"), ["template", "src"]))
    back = onward.select(*KEYS, F.col("dst").alias("src"), F.col("src").alias("dst"))
    live = reached(back, ends, KEYS)
    useful = onward.join(live.withColumnRenamed("node", "dst"), [*KEYS, "dst"], "left_semi")
    begin = starts.join(live, [*KEYS, "node"], "left_semi").withColumnRenamed("node", "start")
    paths = simple_paths(useful, begin, max_nodes, stride, KEYS)
    return paths.join(ends.withColumnRenamed("node", "last"), [*KEYS, "last"], "left_semi").select(
        "template", "variable", "start", "last", F.col("path").alias("flow_chain"),
        F.col("rels").alias("relationships"), F.size("path").alias("chain_length"),
    )


def flow_hops(processors: DataFrame, connections: DataFrame, through: str = "ports", stride: int = 4) -> DataFrame:
    """(template, variable, from_processor, to_processor, n, first_hop, relationships): how many flows pass a hop, the earliest
    place it has in one, and the relationships of one.

    In a template without cycles every walk is a simple path, so the flows through a hop are the walks from definers to it
    times those from it to users, and none is written out. Templates with a cycle have their flows listed.
    """
    edges, starts, ends = _flow_graph(processors, connections, through)
    cyclic, n = cut_counted(components(edges, stride).select("template").distinct())
    if n == 0:
        return _counted_hops(edges, starts, ends, stride)
    some = lambda how: [rows.join(cyclic, "template", how) for rows in (edges, starts, ends)]
    listed = hop_pairs(_flows(*some("left_semi"), None, stride)).groupBy(*KEYS, "from_processor", "to_processor").agg(
        F.count("*").alias("n"), F.min("hop").alias("first_hop"), F.min(F.array_join("relationships", ",")).alias("relationships"))
    return _counted_hops(*some("left_anti"), stride).unionByName(listed)


def _counted_hops(edges: DataFrame, starts: DataFrame, ends: DataFrame, stride: int) -> DataFrame:
    arcs = cut(edges.filter("src <> dst").groupBy("template", "src", "dst").agg(
        F.count("*").alias("times"), F.min(F.array_join("relationships", ",")).alias("relationships")))
    ahead = walks(arcs, starts, KEYS, stride).groupBy(*KEYS, F.col("node").alias("src")).agg(
        F.sum("n").alias("before"), (F.min("hops") + 1).alias("first_hop"))
    onward = cut(ahead.join(off_driver(arcs), ["template", "src"]))
    back = onward.select(*KEYS, F.col("dst").alias("src"), F.col("src").alias("dst"), "times")
    after = walks(back, ends, KEYS, stride).groupBy(*KEYS, F.col("node").alias("dst")).agg(F.sum("n").alias("after"))
    return onward.join(off_driver(after), [*KEYS, "dst"]).select(
        *KEYS, F.col("src").alias("from_processor"), F.col("dst").alias("to_processor"),
        (F.col("before") * F.col("times") * F.col("after")).cast("long").alias("n"), "first_hop", "relationships",
    )


def hop_pairs(flow_rows: DataFrame) -> DataFrame:
    """Consecutive node pairs of each flow with the relationships of that hop."""
    hops = F.sequence(F.lit(1), F.col("chain_length") - 1)
    pairs = F.transform(
        hops,
        lambda i: F.struct(
            i.alias("hop"), F.element_at("flow_chain", i).alias("from_processor"),
            F.element_at("flow_chain", i + 1).alias("to_processor"),
            F.element_at("relationships", i).alias("relationships"),
        ),
    )
    return flow_rows.filter("chain_length > 1").select(
        "template", "variable", "start", "last", "flow_chain", F.explode(pairs).alias("h")
    ).select("template", "variable", "start", "last", "flow_chain", "h.*")
