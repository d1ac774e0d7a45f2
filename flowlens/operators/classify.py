"""Rule-based classification: ordered rules, overrides, promotion."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import vocab as V
from flowlens.session import cut, cut_counted

KEY = ["template", "processor_id"]
EVIDENCE = ["sql", "scripts", "tables", "connections", "controller_services", "uses_variables", "variables"]
OVERRIDE_SCHEMA = (
    "processor_id string, migration_category string, databricks_target string, confidence double, notes string"
)


def normalise_rules(payload: Any) -> list[dict]:
    """Rulebook content (a list, or a mapping with ``rules``) with defaults filled in."""
    raw = payload.get("rules") if isinstance(payload, dict) else payload
    if not raw:
        raise ValueError("the rulebook holds no rules")
    as_list = lambda x: x if x is None or isinstance(x, list) else [x]
    return [
        {
            "name": r.get("name", "Unnamed Rule"),
            "migration_category": r.get("migration_category", V.INFRASTRUCTURE),
            "databricks_target": r.get("databricks_target", "N/A"),
            "confidence": float(r.get("confidence", 0.0)),
            "notes": r.get("notes", ""),
            "processor_types": as_list(r.get("processor_types")),
            "processor_short_types": as_list(r.get("processor_short_types")),
            "conditions": r.get("conditions", []),
        }
        for r in raw
    ]


def _field(df: DataFrame, path: str) -> tuple[Column, T.DataType | None]:
    """Column and type of a dotted path; a null column where the feature row has no such field."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return F.lit(None), None
        kind = kind[part].dataType
    return F.col(path), kind


def condition_column(df: DataFrame, condition: dict) -> Column:
    """One rule condition as a boolean Column; its operators are ANDed."""
    value, kind = _field(df, condition["field"])
    listy, texty = isinstance(kind, T.ArrayType), isinstance(kind, T.StringType)
    tests = [F.lit(True)]
    if condition.get("equals") is not None:
        tests.append(value.eqNullSafe(F.lit(condition["equals"])))
    if condition.get("not_equals") is not None:
        tests.append(~value.eqNullSafe(F.lit(condition["not_equals"])))
    for op, compare in (("gt", lambda a, b: a > b), ("lt", lambda a, b: a < b)):
        if condition.get(op) is None:
            continue
        if listy or isinstance(kind, T.StructType):
            number = F.lit(None).cast("double")
        elif texty:
            number = F.when(F.coalesce(value, F.lit("")) == "", F.lit(0.0)).otherwise(value.try_cast("double"))
        else:
            number = F.coalesce(value.cast("double"), F.lit(0.0))
        tests.append(F.coalesce(compare(number, float(condition[op])), F.lit(False)))
    if condition.get("contains") is not None:
        wanted = F.lit(condition["contains"])
        hit = F.array_contains(value, wanted) if listy else value.contains(wanted.cast("string")) if texty else F.lit(False)
        tests.append(F.coalesce(hit, F.lit(False)))
    if condition.get("contains_any") is not None:
        wanted = F.array(*[F.lit(x) for x in condition["contains_any"]])
        tests.append(F.coalesce(F.arrays_overlap(value, wanted), F.lit(False)) if listy else F.lit(False))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def rule_column(df: DataFrame, rules: Sequence[dict]) -> Column:
    """The first matching rule's outcome as a struct, or the no-match outcome."""
    outcome = lambda r: F.struct(
        F.lit(r["migration_category"]).alias("migration_category"),
        F.lit(r["databricks_target"]).alias("databricks_target"),
        F.lit(float(r["confidence"])).alias("confidence"),
        F.lit(r["name"]).alias("rule"),
        F.lit(r["notes"]).alias("notes"),
    )
    chosen = outcome(V.NO_MATCH)
    for rule in reversed(rules):
        match = F.lit(True)
        if rule["processor_types"]:
            match = match & F.coalesce(F.col("processor_type").isin(*rule["processor_types"]), F.lit(False))
        if rule["processor_short_types"]:
            match = match & F.coalesce(F.col("short_type").isin(*rule["processor_short_types"]), F.lit(False))
        for condition in rule["conditions"]:
            match = match & condition_column(df, condition)
        chosen = F.when(match, outcome(rule)).otherwise(chosen)
    return chosen


def override_rows(spark, overrides: dict[str, dict]) -> DataFrame:
    """A mapping keyed by processor id as an override table."""
    fields = ("migration_category", "databricks_target", "confidence", "notes")
    rows = [
        (pid, *[float(o[f]) if f == "confidence" and o.get(f) is not None else o.get(f) for f in fields])
        for pid, o in overrides.items()
    ]
    return spark.createDataFrame(rows, OVERRIDE_SCHEMA)


def classify(features: DataFrame, rules: Any = None, overrides: DataFrame | None = None) -> DataFrame:
    """Classification records before promotion: rule outcome, then override fields where given."""
    rules = normalise_rules(V.DEFAULT_RULES if rules is None else rules)
    if "short_type" not in features.columns:
        from flowlens.functions.text import short_type

        features = features.withColumn("short_type", short_type(F.col("processor_type")))
    rows = features.withColumn("r", rule_column(features, rules))
    if overrides is None:
        final = {f: F.col(f"r.{f}") for f in ("migration_category", "databricks_target", "confidence", "notes")}
        source = F.lit("rule")
    else:
        o = overrides.select(
            "processor_id",
            F.struct("migration_category", "databricks_target", "confidence", "notes").alias("o"),
        )
        rows = rows.join(o, "processor_id", "left")
        final = {f: F.coalesce(f"o.{f}", f"r.{f}") for f in ("migration_category", "databricks_target", "notes")}
        final["confidence"] = F.when(F.col("o").isNull(), F.col("r.confidence")).otherwise(
            F.coalesce("o.confidence", F.greatest("r.confidence", F.lit(V.OVERRIDE_FLOOR)))
        )
        source = F.when(F.col("o").isNotNull(), F.lit("override")).otherwise(F.lit("rule"))
    return rows.select(
        *KEY, "proc_ord", "name", "processor_type", "short_type", "parent_group", "parent_group_path",
        *[final[f].alias(f) for f in ("migration_category", "databricks_target", "confidence", "notes")],
        source.alias("classification_source"), F.col("r.rule").alias("rule"),
        F.struct(*EVIDENCE).alias("feature_evidence"), "props",
    )


def promote(records: DataFrame, cascade: bool = True, require_downstream: bool = False, connections: DataFrame | None = None) -> DataFrame:
    """Promote processors that set a variable read by Business Logic or Sink Adapter processors.

    Records are evaluated in document order and a promotion counts for later records (``cascade``),
    which is a fixpoint with the condition that the promoted reader comes first. Readers are folded
    per variable before they meet the setters, so no setter-reader pairs are formed to decide.
    """
    slim = cut(
        records.select(
            *KEY, "proc_ord", F.coalesce("name", "processor_id").alias("name"), "migration_category", "classification_source",
            F.array_distinct(F.transform("feature_evidence.variables.defines", lambda d: d["variable"])).alias("sets"),
            F.array_distinct(F.transform("feature_evidence.variables.uses", lambda u: u["variable"])).alias("reads"),
        )
    )
    readers = slim.filter(F.size("reads") > 0).select(
        *KEY, "proc_ord", "name", "migration_category", F.explode("reads").alias("variable")
    )
    setters = slim.filter(
        F.col("migration_category").isin(*V.PROMOTABLE_CATEGORIES) & (F.col("classification_source") != "override")
    ).select(*KEY, "proc_ord", F.explode("sets").alias("variable"))
    base_readers = readers.filter(F.col("migration_category").isin(*V.CONSUMER_CATEGORIES))
    if require_downstream:
        from flowlens.operators import graph

        reach = graph.closure(graph.edges_of(connections), starts=setters.select("template", F.col("processor_id").alias("src")))
        pairs = (
            base_readers.withColumnRenamed("processor_id", "dst").select("template", "variable", "dst", "name")
            .join(reach.select("template", F.col("src").alias("processor_id"), "dst"), ["template", "dst"])
            .join(setters, ["template", "processor_id", "variable"])
        )
        reasons = pairs.groupBy(*KEY).agg(
            F.array_sort(F.collect_set("variable")).alias("vars"), F.array_sort(F.collect_set("name")).alias("names")
        )
        return _apply_promotion(records, reasons)
    live = base_readers.select("template", "variable").distinct()
    found = [cut(setters.join(live, ["template", "variable"], "left_semi").select(*KEY, "proc_ord").distinct())]
    fresh = found[0]
    while cascade:
        seen = fresh.select(*KEY).join(readers, KEY).groupBy("template", "variable").agg(F.min("proc_ord").alias("first_reader"))
        step = setters.join(seen, ["template", "variable"]).filter("first_reader < proc_ord").select(*KEY, "proc_ord").distinct()
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        fresh, n = cut_counted(step.join(known, KEY, "left_anti"))
        if n == 0:
            break
        found.append(fresh)
    promoted = found[0]
    for f in found[1:]:
        promoted = promoted.unionByName(f)
    early = promoted.select(*KEY, F.lit(True).alias("promoted"))
    sources = (
        readers.join(early, KEY, "left")
        .filter(F.col("migration_category").isin(*V.CONSUMER_CATEGORIES) | F.col("promoted"))
        .groupBy("template", "variable", F.when(F.col("promoted"), F.col("proc_ord")).otherwise(F.lit(-1)).alias("from_ord"))
        .agg(F.collect_set("name").alias("names"))
        .groupBy("template", "variable")
        .agg(F.collect_list(F.struct("from_ord", "names")).alias("by_ord"))
    )
    if not cascade:
        sources = sources.withColumn("by_ord", F.filter("by_ord", lambda x: x["from_ord"] < 0))
    reasons = (
        setters.join(promoted.select(*KEY), KEY, "left_semi")
        .join(sources, ["template", "variable"])
        .withColumn("names", F.flatten(F.transform(
            F.filter("by_ord", lambda x: x["from_ord"] < F.col("proc_ord")), lambda x: x["names"])))
        .filter(F.size("names") > 0)
        .groupBy(*KEY)
        .agg(
            F.array_sort(F.collect_set("variable")).alias("vars"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
        )
    )
    return _apply_promotion(records, reasons)


def _apply_promotion(records: DataFrame, reasons: DataFrame) -> DataFrame:
    rows = records.join(reasons, KEY, "left")
    hit = F.col("vars").isNotNull()
    reason = F.concat(  # fixed values: the sentence is part of the result
        F.lit("Promoted from "), F.col("migration_category"), F.lit(" after detecting variables "),
        F.array_join("vars", ", "), F.lit(" consumed by downstream processors "), F.array_join("names", ", "), F.lit("."),
    )
    notes = F.when(F.coalesce("notes", F.lit("")) == "", reason).otherwise(F.concat("notes", F.lit(" | "), reason))
    changed = {
        "migration_category": F.when(hit, F.lit(V.BUSINESS)).otherwise(F.col("migration_category")),
        "databricks_target": F.when(hit, F.lit(V.PROMOTION_TARGET)).otherwise(F.col("databricks_target")),
        "confidence": F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(V.PROMOTION_FLOOR))).otherwise(F.col("confidence")),
        "classification_source": F.when(hit, F.lit("promotion")).otherwise(F.col("classification_source")),
        "notes": F.when(hit, notes).otherwise(F.col("notes")),
        "promotion_reason": F.when(hit, reason),
    }
    return rows.withColumns(changed).drop("vars", "names")


def category_counts(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = [] if by is None else by
    return records.groupBy(*keys, F.coalesce("migration_category", F.lit(V.AMBIGUOUS)).alias("migration_category")).agg(
        F.count("*").alias("n")
    )


def ambiguous(records: DataFrame) -> DataFrame:
    return records.filter(
        (F.coalesce("migration_category", F.lit(V.AMBIGUOUS)) == V.AMBIGUOUS)
        | (F.coalesce("confidence", F.lit(0.0)) < 0.5)
    )


def corpus_stats(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_distinct("template").alias("templates"), F.count("*").alias("processors"),
        F.count_if((F.coalesce("migration_category", F.lit(V.AMBIGUOUS)) == V.AMBIGUOUS)
                   | (F.coalesce("confidence", F.lit(0.0)) < 0.5)).alias("ambiguous"),
    )


def flat_rows(records: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """The 20-column summary row per processor."""
    e = "feature_evidence"
    rows = records if templates is None else records.join(templates.select("template", F.col("path").alias("template_path")), "template", "left")
    if templates is None:
        rows = rows.withColumn("template_path", F.col("template"))
    return rows.select(
        "template", "template_path", "processor_id", F.col("name").alias("processor_name"), "processor_type", "short_type",
        "parent_group", "parent_group_path", "migration_category", "databricks_target", "confidence",
        "classification_source", "rule", F.col(f"{e}.sql.has_dml").alias("sql_has_dml"),
        F.col(f"{e}.sql.has_metadata_only").alias("sql_has_metadata_only"),
        F.col(f"{e}.scripts.inline_count").alias("scripts_inline_count"),
        F.col(f"{e}.scripts.external_count").alias("scripts_external_count"),
        F.col(f"{e}.uses_variables").alias("uses_variables"),
        F.size(f"{e}.connections.incoming").alias("incoming_count"),
        F.size(f"{e}.connections.outgoing").alias("outgoing_count"),
    )


def quick_override(records: DataFrame, category: str, processor_ids: list[str]) -> DataFrame:
    """Override rows that set a category: current target kept unless it needs review."""
    default = V.OVERRIDE_TARGETS.get(category)
    current = F.coalesce(F.nullif("databricks_target", F.lit("")), F.lit("Needs review"))
    return records.filter(F.col("processor_id").isin(*processor_ids)).select(
        "processor_id", F.lit(category).alias("migration_category"),
        F.when(current != "Needs review", current).otherwise(F.lit(default) if default else current).alias("databricks_target"),
        F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(V.OVERRIDE_FLOOR)).alias("confidence"),
        F.lit("Quick action override").alias("notes"),
    )


def classify_corpus(
    features: DataFrame, rules: Any = None, overrides: DataFrame | None = None, cascade: bool = True
) -> DataFrame:
    """Rules, overrides and promotion over the whole corpus."""
    return promote(classify(features, rules, overrides), cascade)
