"""Saved results, summaries and DDL texts in; JSON, CSV and text results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlens import vocab as V
from flowlens.functions.text import strip

BUCKETS = 64
SUMMARY_SCHEMA = ", ".join(
    f"{c} " + ("double" if c == "confidence" else "boolean" if c in ("sql_has_dml", "sql_has_metadata_only", "uses_variables")
               else "int" if c.endswith("_count") else "string")
    for c in V.SUMMARY_COLUMNS
)


def saved_records(spark: SparkSession, location: str, schema: StructType | None = None) -> DataFrame:
    """Classification records: of result documents, tagged with their template, or of what ``write_template_json`` wrote.

    ``schema`` is that of the written records; without it types are inferred.
    """
    reader = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
    if schema is not None:
        return reader.schema(schema).json(location)
    rows = reader.json(location)
    if "template" in rows.columns and "classifications" not in rows.columns and "_corrupt_record" not in rows.columns:
        return rows
    docs = reader.option("multiLine", "true").json(location)
    template = F.col("_metadata.file_name")
    if "workflow" in docs.columns:
        template = F.coalesce("workflow.filename", template)
    return docs.select(template.alias("template"), F.explode("classifications").alias("r")).select("template", "r.*")


def saved_template(spark: SparkSession, location: str, template: str) -> DataFrame:
    """One template's rows of what ``write_template_json`` wrote (only its bucket's folder is read)."""
    return spark.read.json(location).filter((F.col("bucket") == bucket_of(F.lit(template))) & (F.col("template") == template)).drop("bucket")


def bucket_of(template: Column) -> Column:
    return F.pmod(F.hash(template), F.lit(BUCKETS))


def with_sources(rows: DataFrame, processors: DataFrame) -> DataFrame:
    """Adds the file, path and group that each row's processor stands in."""
    tags = processors.select("template", "processor_id", "source_file", "source_path", F.col("parent_group").alias("processor_group"))
    own = [c for c in rows.columns if c not in ("source_file", "source_path", "processor_group")]
    return rows.select(*own).join(tags.dropDuplicates(["template", "processor_id"]), ["template", "processor_id"], "left")


def summary_csv(spark: SparkSession, location: str) -> DataFrame:
    header = spark.read.option("header", "true").csv(location)
    if "processor_type" not in header.columns:
        raise ValueError("summary CSV must include a 'processor_type' column")
    return spark.read.option("header", "true").schema(SUMMARY_SCHEMA).csv(location) if header.columns == V.SUMMARY_COLUMNS else header


def ddl_files(spark: SparkSession, file: str | None = None, folder: str | None = None) -> DataFrame:
    """(file, ddl) of one file or of a folder's ``*.sql``; blank texts are skipped."""
    if (file is None) == (folder is None):
        raise ValueError("give either a file or a folder")
    texts = spark.read.text(file, wholetext=True) if file else spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("ddl")).filter(strip(F.col("ddl")) != "")


def write_template_json(records: DataFrame, location: str, mode: str = "overwrite") -> None:
    """One JSON row for each record, in a folder for each bucket of templates, so many templates don't make many folders."""
    records.withColumn("bucket", bucket_of(F.col("template"))).hint("rebalance", "bucket").write.mode(mode).option(
        "ignoreNullFields", "false").partitionBy("bucket").json(location)


def write_summary_csv(flat: DataFrame, location: str, append: bool = False) -> None:
    rows = flat.select(*V.SUMMARY_COLUMNS)
    if not rows.isEmpty():
        rows.write.mode("append" if append else "overwrite").option("header", "true").csv(location)


def write_table_refs_csv(refs: DataFrame, location: str, processors: DataFrame | None = None) -> None:
    """The fixed columns first, then the rest. ``processors`` gives the source tags that the references lack."""
    refs = refs if processors is None else with_sources(refs, processors)
    first = [c for c in V.TABLE_REF_COLUMNS if c in refs.columns]
    refs.select(*first, *[c for c in refs.columns if c not in first]).write.mode("overwrite").option("header", "true").csv(location)


def write_scripts_csv(items: DataFrame, location: str, processors: DataFrame | None = None) -> None:
    """The six fixed columns; ``source`` tells external scripts from inline ones."""
    rows = items.withColumn("source_file", F.col("template")) if processors is None else with_sources(items, processors)
    rows.withColumn("source", F.col("kind")).select(*V.SCRIPT_COLUMNS).write.mode("overwrite").option("header", "true").option("escape", '"').csv(location)


def write_lineage_csv(report: DataFrame, location: str) -> None:
    """Sorted within range partitions, so the files concatenate in (source, target, hops) order."""
    report.orderBy("source_table", "target_table", "hop_count").write.mode("overwrite").option("header", "true").csv(location)


def write_external_paths(paths: DataFrame, location: str, templates: DataFrame | None = None) -> None:
    """One text folder per template; with ``templates`` also those without any path."""
    rows = paths if templates is None else templates.select("template").join(paths, "template", "left")
    named = rows.select("template", F.coalesce("path", F.lit("")).alias("value"))
    named.repartitionByRange("template", "value").sortWithinPartitions("template", "value").write.mode("overwrite").partitionBy(
        "template").text(location)


def write_matrix_csv(matrix: DataFrame, location: str) -> None:
    if matrix.isEmpty():
        raise ValueError("no rows were generated; the input holds no classification records")
    matrix.write.mode("overwrite").option("header", "true").csv(location)


def write_workflow_json(counts: DataFrame, location: str) -> None:
    """Per-template metadata documents: name, counts, time of analysis."""
    counts.withColumn("analysis_timestamp", F.current_timestamp()).write.mode("overwrite").partitionBy("template").json(location)
