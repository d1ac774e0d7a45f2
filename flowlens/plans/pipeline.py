"""End-to-end pipelines over a corpus, as named DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from flowlens.operators import chains, classify, features, lineage, profiles, reports, scripts, tables, variables
from flowlens.session import cut


def records(
    processors: DataFrame, connections: DataFrame, rules: Any = None, overrides: DataFrame | None = None,
    resolve: bool = True, cascade: bool = True,
) -> DataFrame:
    """Processors to final classification records."""
    refs = tables.table_refs(processors, connections, resolve=resolve, inventory=True)
    rows = features.processor_features(processors, connections, refs, scripts.script_items(processors))
    return classify.classify_corpus(rows, rules, overrides, cascade)


def classify_workflows(processors: DataFrame, connections: DataFrame, rules: Any = None, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    rows = cut(records(processors, connections, rules, overrides))
    return {
        "classifications": rows,
        "summary": classify.category_counts(rows, ["template"]),
        "ambiguous": classify.ambiguous(rows),
        "group_profiles": profiles.group_profiles(rows, connections),
        "flat": classify.flat_rows(rows),
        "stats": classify.corpus_stats(rows),
    }


def full_analysis(processors: DataFrame, connections: DataFrame) -> dict[str, DataFrame]:
    """Classification, tables, scripts, lineage and variables. References and scripts are written once."""
    refs = cut(tables.table_refs(processors, connections))
    items = cut(scripts.script_items(processors))
    rows = cut(classify.classify_corpus(
        features.processor_features(processors, connections, tables.inventory_of(refs), items)))
    defs, uses = variables.definitions(processors), variables.usages(processors)
    return {
        "classifications": rows,
        "summary": classify.category_counts(rows, ["template"]),
        "group_profiles": profiles.group_profiles(rows, connections),
        "tables": tables.inventory_of(refs),
        "scripts": items,
        **{f"lineage_{k}": v for k, v in lineage.analysis(processors, connections, refs).items()},
        "variables": variables.summary(defs, uses),
        "variable_flows": variables.flows(processors, connections),
    }


def migration_plan(processors: DataFrame, connections: DataFrame, analysis_only: bool = False) -> dict[str, DataFrame]:
    """Classify, prune, find chains, count."""
    result = classify_workflows(processors, connections)
    rows = chains.with_bucket(result["classifications"])
    result |= {"pruned": rows, "prune_summary": chains.prune_summary(rows)}
    if analysis_only:
        return result
    essential = rows.filter("bucket = 'essential'")
    members = chains.chain_members(essential, connections)
    found = chains.chains(members, essential)
    return result | {
        "chain_members": members, "chains": found, "chain_summary": chains.chain_summary(found, essential),
        "dependencies": reports.dependencies(result["classifications"]),
        "essential_counts": reports.essential_counts(result["classifications"]),
    }
