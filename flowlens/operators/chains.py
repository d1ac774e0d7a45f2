"""Pruning buckets, linear chains of essential processors, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.text import has_any
from flowlens.operators import graph
from flowlens.session import cut

KEY = ["template", "processor_id"]
# Removal reasons and pattern words.
REMOVAL_REASONS = {"essential": "", "support": "Support orchestration", "infrastructure": "Infrastructure", "ambiguous": "Needs review"}
LEGACY_KEPT = ["data_transformation", "data_movement", "external_processing"]
LEGACY_LABELS = ["data_transformation", "data_movement", "infrastructure_only", "external_processing", "unknown"]
PATTERNS = [
    (["getfile", "listfile"], [(["puthdfs", "putfile"], "file_ingestion"), (["putsql", "putdatabase"], "file_to_database")], "file_processing"),
    (["consumekafka", "listenkafka"], [(["publishkafka", "putkafka"], "stream_processing"), (["puthdfs", "putfile"], "stream_to_file")], "stream_ingestion"),
    (["executesql", "queryrecord"], [(["putsql", "putdatabase"], "database_transformation"), (["puthdfs", "putfile"], "database_export")], "database_processing"),
    (["listenhttp", "invokehttp"], [], "api_processing"),
]


def with_bucket(records: DataFrame) -> DataFrame:
    """Adds bucket (essential / support / infrastructure / ambiguous) and removal_reason."""
    category = F.coalesce("migration_category", F.lit(V.INFRASTRUCTURE))
    bucket = (
        F.when(category.isin(*V.ESSENTIAL_CATEGORIES), F.lit("essential"))
        .when(category == V.ORCHESTRATION, F.lit("support"))
        .when(category == V.AMBIGUOUS, F.lit("ambiguous"))
        .otherwise(F.lit("infrastructure"))
    )
    reasons = F.create_map(*[F.lit(x) for kv in REMOVAL_REASONS.items() for x in kv])
    return records.withColumn("bucket", bucket).withColumn("removal_reason", reasons[F.col("bucket")])


def prune_summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    rows = with_bucket(records)
    return rows.groupBy(*(by or [])).agg(
        *[F.count_if(F.col("bucket") == b).alias(f"{b}_count") for b in REMOVAL_REASONS]
    )


def legacy_prune(rows: DataFrame) -> DataFrame:
    """Legacy labels: kept, quarantined ('unknown') or removed, with the reason."""
    label = F.coalesce("data_manipulation_type", F.lit("unknown"))
    return rows.withColumn(
        "bucket",
        F.when(label.isin(*LEGACY_KEPT), F.lit("kept")).when(label == "unknown", F.lit("quarantined")).otherwise(F.lit("removed")),
    ).withColumn(
        "removal_reason",
        F.when(F.col("bucket") == "quarantined", F.lit("Classified as 'unknown' - requires manual review"))
        .when(F.col("bucket") == "removed", F.concat(F.lit("Classified as '"), label, F.lit("' - infrastructure only"))),
    )


def legacy_prune_summary(pruned: DataFrame) -> DataFrame:
    out = F.count_if(F.col("bucket") != "kept")
    return pruned.agg(
        F.count("*").alias("original_count"), F.count_if(F.col("bucket") == "kept").alias("kept_count"),
        out.alias("pruned_count"), F.count_if(F.col("bucket") == "quarantined").alias("unknown_count"),
        F.round(F.lit(100.0) * out / F.count("*"), 1).alias("reduction_percentage"),
    )


def legacy_prune_counts(pruned: DataFrame) -> DataFrame:
    """Counts per bucket, legacy label and impact."""
    return pruned.groupBy("bucket", "data_manipulation_type", "data_impact_level").agg(F.count("*").alias("n"))


def business_pattern(source_type: Column, sink_type: Column) -> Column:
    """Label by first and last type; a chain of one has an empty sink type."""
    src, snk = F.lower(source_type), F.lower(sink_type)
    label = F.lit("data_transformation")
    for words, sinks, default in reversed(PATTERNS):
        inner = F.lit(default)
        for sink_words, name in reversed(sinks):
            inner = F.when(has_any(snk, sink_words), F.lit(name)).otherwise(inner)
        label = F.when(has_any(src, words), inner).otherwise(label)
    return label


def chain_members(processors: DataFrame, connections: DataFrame, complete: bool = False) -> DataFrame:
    """(template, chain_root, position, processor_id): every node on at most one linear chain.

    ``processors`` are the kept ones with (template, processor_id, proc_ord); edges count only
    between them. A link runs from a node with one outgoing edge to a node with one incoming edge;
    a chain starts at a node without incoming or with several outgoing edges. A branching node that
    comes first in document order starts its own chain instead of ending another.
    ``complete`` also starts chains at fan-in nodes and branch bodies.
    """
    nodes = cut(processors.select(*KEY, "proc_ord"))
    ids = lambda end: nodes.select("template", F.col("processor_id").alias(end))
    edges = cut(
        graph.edges_of(connections).select("template", "src", "dst")
        .join(ids("src"), ["template", "src"], "left_semi").join(ids("dst"), ["template", "dst"], "left_semi")
    )
    out_degree = edges.groupBy("template", F.col("src").alias("processor_id")).agg(F.count("*").alias("outs"), F.max("dst").alias("to_id"))
    in_degree = edges.groupBy("template", F.col("dst").alias("processor_id")).agg(F.count("*").alias("ins"))
    degrees = cut(
        nodes.join(out_degree, KEY, "left").join(in_degree, KEY, "left").select(
            *KEY, "proc_ord", F.coalesce("outs", F.lit(0)).alias("outs"), F.coalesce("ins", F.lit(0)).alias("ins"), "to_id")
    )
    single = degrees.filter("outs = 1").select("template", F.col("processor_id").alias("pred"), F.col("to_id").alias("processor_id"))
    links = single.join(degrees.filter("ins = 1").select(*KEY), KEY, "left_semi")
    pointers = degrees.join(links, KEY, "left").select(
        *KEY, F.when(F.col("pred").isNotNull(), F.struct("template", F.col("pred").alias("processor_id"))).alias("to")
    )
    placed, _ = graph.follow_pointers(pointers, KEY, "to")
    facts = degrees.select(*KEY, "proc_ord", "outs", "ins")
    heads = facts.select(
        "template", F.col("processor_id").alias("root_id"), F.col("proc_ord").alias("root_ord"),
        F.lit(True).alias("starts") if complete else ((F.col("ins") == 0) | (F.col("outs") > 1)).alias("starts"),
    )
    rows = placed.select(*KEY, F.col("root.processor_id").alias("root_id"), "dist").join(heads, ["template", "root_id"]).join(facts, KEY)
    own = (F.col("dist") > 0) & (F.col("outs") > 1) & (~F.col("starts") | (F.col("proc_ord") < F.col("root_ord")))
    return rows.filter(own | F.col("starts")).select(
        "template", F.when(own, F.col("processor_id")).otherwise(F.col("root_id")).alias("chain_root"),
        F.when(own, F.lit(0)).otherwise(F.col("dist")).cast("long").alias("position"), "processor_id",
    )


def chains(members: DataFrame, processors: DataFrame, numbered: bool = False) -> DataFrame:
    """One row per chain: source, sink, length and pattern, without collecting the members."""
    named = members.join(processors.select(*KEY, "proc_ord", "name", "processor_type"), KEY)
    end = F.struct(F.col("processor_id").alias("id"), "name", F.col("processor_type").alias("type"))
    rows = named.groupBy("template", "chain_root").agg(
        F.min_by(end, "position").alias("source"), F.max_by(end, "position").alias("sink"), F.count("*").alias("length"),
        F.min_by("proc_ord", "position").alias("source_ord"),
    ).withColumn(
        "business_pattern",
        business_pattern(F.col("source.type"), F.when(F.col("length") > 1, F.col("sink.type")).otherwise(F.lit(""))),
    )
    if numbered:
        w = W.partitionBy("template").orderBy("source_ord")
        rows = rows.withColumn("chain_id", F.concat(F.lit("flow_"), F.row_number().over(w).cast("string")))
    return rows


def chain_summary(chain_rows: DataFrame, processors: DataFrame) -> DataFrame:
    """Totals over the corpus: chains, average length, processors in chains, isolated ones."""
    found = chain_rows.agg(F.count("*").alias("total_chains"), F.coalesce(F.sum("length"), F.lit(0)).alias("processors_in_chains"))
    both = found.unionByName(processors.agg(F.count("*").alias("kept")), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "total_chains",
        F.when(F.col("total_chains") > 0, F.round(F.col("processors_in_chains") / F.col("total_chains"), 1)).otherwise(F.lit(0.0)).alias("avg_chain_length"),
        "processors_in_chains", (F.col("kept") - F.col("processors_in_chains")).alias("isolated_processors"),
    )
