"""Named queries over the driver tables: one per operator family, each over its whole input.

Shared silver tables (references, scripts, records, table sets) are written once per session and
input folder, as a nightly job would, and reused by the queries that start from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions import code, scoring, text
from flowlens.operators import (
    batching, chains, classify, ddl, features, filters, graph, legacy, lineage, patterns, profiles, reports, scripts, store,
    tables, variables,
)
from flowlens.plans import views
from flowlens.session import cut, dealt
from flowlens.sources.templates import Corpus, shred
from flowlens.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_silver: dict[tuple[str, str, str], DataFrame] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def forget_silver() -> None:
    _silver.clear()


def silver(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _silver:
        _silver[key] = cut(build())
    return _silver[key]


def part(spark, sf):
    """The part table in as many files as keep all cores busy; a file of few row groups is read by as few tasks, whatever its rows cost."""
    return silver(spark, sf, "part", lambda: dealt(views.read_table(spark, sf, "part"), "p_partkey"))


def procs(spark, sf):
    return views.processors(part(spark, sf))


def conns(spark, sf):
    return views.connections(part(spark, sf))


def refs(spark, sf):
    return silver(spark, sf, "refs", lambda: tables.table_refs(procs(spark, sf), conns(spark, sf)))


def plain_refs(spark, sf):
    return tables.table_refs(procs(spark, sf), conns(spark, sf), resolve=False, inherit=False)


def items(spark, sf):
    return silver(spark, sf, "scripts", lambda: scripts.script_items(procs(spark, sf)))


def feature_rows(spark, sf):
    return silver(spark, sf, "features", lambda: features.processor_features(
        procs(spark, sf), conns(spark, sf), tables.inventory_of(refs(spark, sf)), items(spark, sf)))


def base_records(spark, sf):
    return classify.classify(feature_rows(spark, sf))


def records(spark, sf):
    return silver(spark, sf, "records", lambda: classify.promote(base_records(spark, sf)))


def sets(spark, sf):
    return silver(spark, sf, "sets", lambda: lineage.lineage_sources(procs(spark, sf), conns(spark, sf), plain_refs(spark, sf)))


def shared_sets(spark, sf):
    """Table sets over the view with few table names, where neighbours share tables."""
    def build():
        p, c = views.processors(part(spark, sf), 5), conns(spark, sf)
        return lineage.lineage_sources(p, c, tables.table_refs(p, c, resolve=False, inherit=False))

    return silver(spark, sf, "shared_sets", build)


def joined(column: str):
    return F.array_join(column, ",").alias(column)


# --- tables and lineage ---------------------------------------------------------------------


@query
def table_lineage_edges(spark, sf):
    found = lineage.lineage_sources(procs(spark, sf), conns(spark, sf), plain_refs(spark, sf))
    return lineage.lineage_edges(found).select("template", "src", "dst", F.col("processor_ids")[0].alias("processor_id"))


@query
def sql_table_refs(spark, sf):
    return plain_refs(spark, sf).select(
        "template", "processor_id", "processor_type", "property_name", "table_name", "source",
        F.coalesce("sql_clause", F.lit("")).alias("sql_clause"), "io_type", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query
def resolved_table_refs(spark, sf):
    return refs(spark, sf).select(
        "template", "processor_id", "processor_type", "property_name", "table_name", "source", "io_type",
        F.coalesce("origin_processor_id", F.lit("")).alias("origin_processor_id"))


@query
def table_inventory(spark, sf):
    return tables.inventory_of(refs(spark, sf)).select("template", "processor_type", "table_name", "processor_id", "property_name")


@query
def table_name_scores(spark, sf):
    names = part(spark, sf).select(F.col("p_partkey").alias("id"), F.concat_ws(
        "", F.replace("p_name", F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("_", ".", "", "_fact_", " ")]), (F.col("p_partkey") % 5 + 1).cast("int"))),
        F.when(F.col("p_size") % 4 == 0, F.lit("_log")).otherwise(F.lit(""))).alias("name"))
    ptype, prop = F.lit("executesql"), F.lit("table name")
    return names.select("id", "name", F.round(scoring.table_score(F.col("name"), ptype, prop), 9).alias("score"))


@query
def resolved_properties(spark, sf):
    return tables.resolved_properties(procs(spark, sf), conns(spark, sf)).select("template", "processor_id", "prop_name", "prop_value")


@query
def processor_tables(spark, sf):
    return sets(spark, sf).select("template", "processor_id", joined("reads"), joined("writes"))


@query
def inter_processor_edges(spark, sf):
    return lineage.inter_edges(shared_sets(spark, sf), conns(spark, sf)).distinct().select(
        "template", "src", "dst", F.array_join("processor_ids", " -> ").alias("processor_ids"))


@query
def domain_edges(spark, sf):
    return lineage.domain_only(lineage.lineage_edges(shared_sets(spark, sf), conns(spark, sf))).select("template", "src", "dst", joined("processor_ids"))


@query
def lineage_chain_report(spark, sf):
    edges = lineage.lineage_edges(shared_sets(spark, sf), conns(spark, sf))
    return lineage.chain_report(edges, procs(spark, sf))


@query
def table_flow_links(spark, sf):
    return lineage.table_flow_links(shared_sets(spark, sf), conns(spark, sf))


@query
def lineage_metrics(spark, sf):
    return lineage.metrics(sets(spark, sf))


@query
def critical_tables(spark, sf):
    return lineage.critical_tables(sets(spark, sf))


@query
def critical_tables_topk(spark, sf):
    return lineage.critical_tables(sets(spark, sf), 20)


@query
def longest_table_paths(spark, sf):
    edges = lineage.lineage_edges(shared_sets(spark, sf), conns(spark, sf))
    return graph.longest_paths(edges).select("template", "rank", F.array_join("path", ">").alias("path"), "nodes", "hops")


@query
def table_summary_topk(spark, sf):
    return tables.summary(refs(spark, sf))


@query
def corpus_summary(spark, sf):
    return tables.corpus_summary(refs(spark, sf), procs(spark, sf))


@query
def top_tables(spark, sf):
    return tables.value_counts(refs(spark, sf), "table_name", 10)


# --- graph ----------------------------------------------------------------------------------


@query
def adjacency(spark, sf):
    return graph.adjacency(conns(spark, sf), procs(spark, sf)).select("template", "processor_id", joined("incoming"), joined("outgoing"))


@query
def downstream_closure(spark, sf):
    return graph.closure(graph.edges_of(conns(spark, sf)))


@query
def cycle_pairs(spark, sf):
    return graph.cycle_pairs(graph.edges_of(views.connections(part(spark, sf), cyclic=True)))


@query
def connection_cycles(spark, sf):
    rows = graph.cycles(graph.edges_of(views.connections(part(spark, sf), cyclic=True)))
    return rows.select("template", "component", "size", F.array_join("members", ">").alias("members"))


@query
def table_cycles(spark, sf):
    rows = graph.cycles(lineage.lineage_edges(shared_sets(spark, sf), conns(spark, sf)).select("template", "src", "dst"))
    return rows.select("template", "component", "size", F.array_join("members", ">").alias("members"))


@query
def flattened_edges(spark, sf):
    p = part(spark, sf)
    return graph.flattened_edges(views.ported_connections(p), views.processors(p)).select(
        "template", "src", "dst", joined("relationships"), F.coalesce("via_port", F.lit("")).alias("via_port"))


@query
def group_paths(spark, sf):
    n = views.read_table(spark, sf, "nation").select(F.lit("world").alias("template"), F.col("n_name").alias("group_id"), F.col("n_name").alias("name"),
                                                     F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    r = views.read_table(spark, sf, "region").select(F.lit("world").alias("template"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("group_id"),
                                                     F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    s = views.read_table(spark, sf, "supplier").select(
        F.lit("world").alias("template"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("group_id"),
        F.col("s_name").alias("name"), F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 3).cast("string")).alias("up"), "s_nationkey", "s_suppkey")
    nation = n.join(views.read_table(spark, sf, "nation"), F.col("n_name") == F.col("group_id")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("group_id").alias("home"))
    s = s.join(nation, "s_nationkey").select("template", "group_id", "name", F.when(F.col("s_suppkey") % 7 == 0, F.col("home")).otherwise(F.col("up")).alias("parent_id"))
    return graph.group_paths(n.unionByName(r).unionByName(s))


# --- variables ------------------------------------------------------------------------------


@query
def variable_defs(spark, sf):
    return variables.definitions(procs(spark, sf)).select("template", "processor_id", "variable", "property_value", "definition_type")


@query
def variable_usages(spark, sf):
    return variables.usages(procs(spark, sf)).select(
        "template", "processor_id", "variable", "property_name", "variable_expression", "has_functions")


@query
def variable_summary(spark, sf):
    p = procs(spark, sf)
    return variables.summary(variables.definitions(p), variables.usages(p))


@query
def variable_totals(spark, sf):
    return variables.totals(variable_summary(spark, sf))


@query
def variable_resolution(spark, sf):
    p = procs(spark, sf)
    return graph.resolve_variables(variables.literals(variables.definitions(p)), conns(spark, sf), p)


@query
def variable_flow_paths(spark, sf):
    return variables.flows(procs(spark, sf), conns(spark, sf)).select(
        "template", "variable", "start", "last", F.array_join("flow_chain", ">").alias("flow_chain"), "chain_length")


@query
def variable_flow_hops(spark, sf):
    return variables.flow_hops(procs(spark, sf), conns(spark, sf))


# --- scripts and text ------------------------------------------------------------------------


@query
def script_refs(spark, sf):
    return items(spark, sf).select("template", "processor_id", "kind", "property_name", F.coalesce("path", F.lit("")).alias("path"),
                                   "script_type", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("line_count", F.lit(-1)).alias("line_count"))


@query
def script_summary(spark, sf):
    return scripts.summary(items(spark, sf))


@query
def script_types(spark, sf):
    return items(spark, sf).groupBy("kind", "script_type").agg(F.count("*").alias("n"))


@query
def document_languages(spark, sf):
    d = views.read_table(spark, sf, "documents")
    return d.select("doc_id", code.guess_language(F.col("text")).alias("g")).select("doc_id", F.col("g.lang").alias("lang"), F.round("g.confidence", 6).alias("confidence"))


@query
def redact_secrets(spark, sf):
    d = views.read_table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"), (text.redact(F.col("text")) != F.col("text")).alias("changed"))


@query
def url_hosts(spark, sf):
    p = views.read_table(spark, sf, "pages")
    return p.select("page_id", F.explode(code.hosts(F.concat_ws(" ", "url", "html"))).alias("host"))


@query
def impala_hosts(spark, sf):
    return variables.properties(procs(spark, sf)).select("template", "processor_id", F.explode(code.impala_hosts(F.col("prop_value"))).alias("host"))


@query
def base64_text(spark, sf):
    d = views.read_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
            F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")).alias("value"))
    return d.select("doc_id", F.md5(text.decode_base64_text(F.col("value"))).alias("digest")).filter("digest IS NOT NULL")


@query
def query_links(spark, sf):
    return scripts.query_links(procs(spark, sf)).select("template", "processor_id", "prop_name", "query", "provider_id")


@query
def inline_script_candidates(spark, sf):
    p = variables.properties(procs(spark, sf))
    return p.select("template", "processor_id", "prop_name", code.inline_script(F.col("prop_name"), F.col("prop_value")).alias("s")).filter("s IS NOT NULL").select(
        "template", "processor_id", "prop_name", "s.script_type", "s.content_length", "s.line_count")


@query
def text_search(spark, sf):
    return filters.text_search(procs(spark, sf).select("template", "processor_id", "name", "type"), "Gear").select("template", "processor_id", "name")


@query
def filtered_processors(spark, sf):
    return filters.multi_filter(base_records(spark, sf), name_contains="RING", short_type="PutSQL", parent_group="All").select("template", "processor_id", "name")


# --- features and classification -------------------------------------------------------------


@query
def processor_features(spark, sf):
    f = feature_rows(spark, sf)
    return f.select(
        "template", "processor_id", "short_type", joined("controller_services"),
        F.col("scripts.inline_count").alias("inline_count"), F.col("scripts.external_count").alias("external_count"),
        F.col("sql.has_sql").alias("has_sql"), F.col("sql.has_dml").alias("has_dml"), F.col("sql.has_metadata_only").alias("has_metadata_only"),
        F.array_join("tables.tables", ",").alias("tables"), F.size("variables.defines").alias("defines"), F.size("variables.uses").alias("uses"),
        F.size("connections.incoming").alias("incoming"), F.size("connections.outgoing").alias("outgoing"), "uses_variables", "has_comments")


def outcome(df):
    return df.select("template", "processor_id", "migration_category", "databricks_target", "confidence", "classification_source", "rule")


@query
def rule_classification(spark, sf):
    return outcome(base_records(spark, sf))


@query
def override_classification(spark, sf):
    p = part(spark, sf)
    rows = p.filter("p_size % 10 = 0").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("processor_id"), F.lit(V.BUSINESS).alias("migration_category"),
        F.lit(None).cast("string").alias("databricks_target"),
        F.when(F.col("p_size") % 20 == 0, F.lit(1.0)).alias("confidence"), F.lit("reviewed").alias("notes"))
    return outcome(classify.classify(feature_rows(spark, sf), overrides=rows))


@query
def promotion(spark, sf):
    return outcome(classify.promote(base_records(spark, sf), cascade=False))


@query
def promotion_cascade(spark, sf):
    rows = records(spark, sf)
    return rows.select("template", "processor_id", "migration_category", "classification_source", F.coalesce("promotion_reason", F.lit("")).alias("promotion_reason"))


@query
def category_counts(spark, sf):
    return classify.category_counts(records(spark, sf), ["template"])


@query
def flat_classification(spark, sf):
    return classify.flat_rows(records(spark, sf))


@query
def group_profiles(spark, sf):
    g = profiles.group_profiles(base_records(spark, sf), conns(spark, sf))
    lists = ["variables_defined", "variables_used", "controller_services", "incoming_groups", "outgoing_groups"]
    return g.select("template", "group_path", "processor_count", "dominant_category", "needs_migration_count", "ambiguous_count",
                    "inline_script_total", "external_script_total", F.size("external_script_processors").alias("external_processors"),
                    *[joined(c) for c in lists])


@query
def feature_matrix(spark, sf):
    return profiles.feature_matrix(base_records(spark, sf), conns(spark, sf), include_ambiguous=True).drop(
        "processor_name", "processor_type", "parent_group_path", "databricks_target", "rule")


@query
def rule_suggestions(spark, sf):
    return profiles.rule_suggestions(classify.flat_rows(base_records(spark, sf)), covered=["LogMessage", "PutHDFS"])


@query
def legacy_classification(spark, sf):
    return legacy.legacy_classify(views.labelled_processors(part(spark, sf))).select(
        "template", "processor_id", "name", "data_manipulation_type", "data_impact_level", F.coalesce("key_operation", F.lit("")).alias("key_operation"))


@query
def legacy_final_overrides(spark, sf):
    rows = legacy.final_overrides(legacy.legacy_classify(views.labelled_processors(part(spark, sf))))
    return rows.groupBy("data_manipulation_type", "data_impact_level").agg(F.count("*").alias("n"))


@query
def legacy_label_counts(spark, sf):
    return legacy.label_counts(legacy.legacy_classify(views.labelled_processors(part(spark, sf))))


@query
def legacy_prune_summary(spark, sf):
    return chains.legacy_prune_summary(chains.legacy_prune(legacy.legacy_classify(views.labelled_processors(part(spark, sf)))))


@query
def unknown_processors(spark, sf):
    return legacy.unknown_report(legacy.legacy_classify(views.labelled_processors(part(spark, sf)))).select(
        "template", "id", F.array_join("property_preview", "|").alias("property_preview"))


@query
def prune_summary(spark, sf):
    return chains.prune_summary(base_records(spark, sf), ["template"])


def essential(spark, sf):
    return chains.with_bucket(base_records(spark, sf)).filter("bucket = 'essential'")


@query
def essential_chains(spark, sf):
    kept = essential(spark, sf)
    return chains.chain_members(kept, conns(spark, sf))


@query
def linear_chains(spark, sf):
    return chains.chain_members(procs(spark, sf), conns(spark, sf))


@query
def chain_patterns(spark, sf):
    p = procs(spark, sf).withColumn("processor_type", text.short_type(F.col("type")))
    found = chains.chains(chains.chain_members(p, conns(spark, sf)), p)
    return found.select("template", "chain_root", F.col("source.type").alias("source_type"), F.col("sink.id").alias("sink_id"),
                        F.col("sink.type").alias("sink_type"), "length", "business_pattern")


@query
def chain_summary(spark, sf):
    p = procs(spark, sf).withColumn("processor_type", text.short_type(F.col("type")))
    return chains.chain_summary(chains.chains(chains.chain_members(p, conns(spark, sf)), p), p)


@query
def key_details(spark, sf):
    d = procs(spark, sf).select("template", "processor_id", F.inline(reports.key_details(text.short_type(F.col("type")), F.col("props"))))
    return d.select("template", "processor_id", "label", "value")


@query
def placeholder_dependencies(spark, sf):
    return reports.dependencies(base_records(spark, sf)).select("template", "processor_id", "bucket", "dependency_reason", "dependency_category", "sql_query_count")


@query
def neighbor_records(spark, sf):
    r = reports.neighbor_records(base_records(spark, sf), conns(spark, sf))
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["processor_id"], x["short_type"])), ",").alias(c)
    return r.select("template", "processor_id", names("upstream_processors"), names("downstream_processors"))


@query
def payload_rows(spark, sf):
    p = reports.payload_rows(base_records(spark, sf), conns(spark, sf))
    return p.select("template", "processor_id", F.array_join("lineage_summary.incoming_types", ",").alias("incoming_types"),
                    F.array_join("lineage_summary.outgoing_types", ",").alias("outgoing_types"),
                    F.array_join("variables.defines", ",").alias("defines"), F.array_join("variables.uses", ",").alias("uses"))


# --- batching, store, DDL, patterns ------------------------------------------------------------


@query
def batch_packing(spark, sf):
    d = views.read_table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    packed = batching.pack(d, ["source", "doc_id"], "n_chars", ["source"], 10, 20_000)
    return packed.groupBy("source", "batch_index").agg(F.count("*").alias("members"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query
def batch_packing_corpus(spark, sf):
    d = views.read_table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    packed = batching.pack(d, ["source", "doc_id"], "n_chars", [], 10, 60_000)
    return packed.groupBy("batch_index").agg(F.count("*").alias("members"), F.sum("n_chars").alias("chars"))


@query
def record_batches(spark, sf):
    b = batching.build_batches(base_records(spark, sf), scope="template", max_items=5)
    return b.select("template", "batch_index", "processor_count", joined("processor_ids"))


@query
def keyed_upsert(spark, sf):
    e = views.read_table(spark, sf, "events")
    return store.latest(e.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query
def ingest_generations(spark, sf):
    """Documents as the entries of a ledger: each one is a version of the file named by its source and language."""
    d = views.read_table(spark, sf, "documents").filter("n_chars IS NOT NULL")
    entries = d.select(F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("und"))).alias("path"), F.md5((F.col("n_chars") % 2).cast("string")).alias("checksum"),
                       F.col("doc_id").alias("batch_id"), (F.col("n_chars") % 7 == 0).alias("removed"))
    return ingest.live_files(entries).select("path", "checksum", "batch_id", "generation")


@query
def ddl_columns(spark, sf):
    return ddl.ddl_columns(ddl.optimised(ddl.parsed(views.ddl_texts(part(spark, sf)))))


@query
def ddl_statements(spark, sf):
    s = ddl.rendered(ddl.parsed(views.ddl_texts(part(spark, sf))), catalog="main")
    return s.select("file", "full_name", "step", F.md5("statement").alias("digest"))


@query
def route_counts(spark, sf):
    e = views.read_table(spark, sf, "events")
    r = patterns.with_route(e, {"failure": F.col("event_type") == "error", "paid": (F.col("event_type") == "purchase") & (F.col("value") > 20),
                                "large": F.col("value") > 50})
    return r.groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def funnel(spark, sf):
    e = views.read_table(spark, sf, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), "value")
    o = views.read_table(spark, sf, "orders").select(F.lit("order").alias("origin"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return patterns.funnel(e, o).groupBy("origin").agg(F.count("*").alias("n"), F.count("value").alias("values"), F.count("status").alias("statuses"))


@query
def dataset_diff(spark, sf):
    o = views.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey"))
    l = views.read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"), F.max(F.lit(None).cast("long")).alias("o_custkey"))
    return patterns.diff_counts(patterns.dataset_diff(o.drop("o_custkey"), l.drop("o_custkey"), ["o_orderkey"]))


@query
def asset_inventory(spark, sf):
    return patterns.asset_inventory(procs(spark, sf), refs(spark, sf), items(spark, sf)).groupBy("template", "kind").agg(F.count("*").alias("n"))


@query
def template_shred(spark, sf):
    """Templates rendered to XML text by Spark, shredded back to typed rows."""
    corpus = Corpus(shred(views.template_documents(part(spark, sf))))
    return variables.properties(corpus.processors).select("template", "processor_id", "name", "type", "parent_group", "prop_name", "prop_value")


@query
def shredded_connections(spark, sf):
    corpus = Corpus(shred(views.template_documents(part(spark, sf))))
    return corpus.connections.select("template", "source", "destination", joined("relationships"))
