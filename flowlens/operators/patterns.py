"""What common processors mean as Spark jobs, and two corpus-wide reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import code
from flowlens.functions.sqltext import jdbc_source
from flowlens.operators import variables


def with_route(df: DataFrame, routes: dict[str, Column]) -> DataFrame:
    """First matching route per row, else "unmatched"; outputs are filters on ``route``."""
    chosen = F.when(F.lit(False), F.lit(""))
    for name, condition in routes.items():
        chosen = chosen.when(condition, F.lit(name))
    return df.withColumn("route", chosen.otherwise(F.lit("unmatched")))


def routed(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("route") == name).drop("route")


def funnel(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def convert(spark: SparkSession, source: str, source_format: str, target: str, target_format: str, schema: str | None = None) -> None:
    reader = spark.read.format(source_format).option("header", "true")
    (reader.schema(schema) if schema else reader).load(source).write.mode("overwrite").option("header", "true").format(target_format).save(target)


def put_table(df: DataFrame, location: str, partition_by: list[str]) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(location)


def execute_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over named DataFrames."""
    return spark.sql(sql, **tables)


def jdbc_options(url: str, table: str, column: str | None = None, partitions: int = 1, **bounds: str) -> dict[str, str]:
    """Options of a JDBC read; partitioned where a column and its bounds are given."""
    options = {"url": url, "dbtable": table}
    if column:
        options |= {"partitionColumn": column, "numPartitions": str(partitions), **bounds}
    return options


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    return (df.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint))


def dataset_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Key-wise diff status: missing (left only), extra (right only), changed, same."""
    values = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.struct(*values).alias("l"))
    r = right.select(*keys, F.struct(*values).alias("r"))
    return l.join(r, keys, "full").withColumn(
        "status",
        F.when(F.col("r").isNull(), F.lit("missing")).when(F.col("l").isNull(), F.lit("extra"))
        .when(F.col("l").eqNullSafe(F.col("r")), F.lit("same")).otherwise(F.lit("changed")),
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def asset_inventory(processors: DataFrame, refs: DataFrame, script_items: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Distinct (template, kind, asset): scripts, HDFS paths, hosts, tables, database sources."""
    props = variables.properties(processors)
    hdfs = F.regexp_extract_all(F.col("prop_value"), F.lit(r"((?:hdfs://[^\s;,\"']+|/(?:user|warehouse|data|tmp)/[^\s;,\"']+))"), F.lit(1))
    found = props.select("template", F.explode(F.concat(
        F.transform(hdfs, lambda p: F.struct(F.lit("hdfs_path").alias("kind"), p.alias("asset"))),
        F.transform(code.external_hosts(F.col("prop_value")), lambda h: F.struct(F.lit("host").alias("kind"), h.alias("asset"))),
    )).alias("x")).select("template", "x.*")
    urls = props if services is None else services.select("template", F.explode("props").alias("p")).select(
        "template", F.col("p.value").alias("prop_value"))
    databases = urls.filter(F.col("prop_value").startswith("jdbc:")).select(
        "template", F.lit("database").alias("kind"), jdbc_source(F.col("prop_value")).alias("asset"))
    scripts = script_items.filter("kind = 'external'").select("template", F.lit("script").alias("kind"), F.col("path").alias("asset"))
    tables = refs.select("template", F.lit("table").alias("kind"), F.col("table_name").alias("asset"))
    return funnel(found, databases, scripts, tables).distinct()


def service_map(services: DataFrame) -> DataFrame:
    """Readable source per controller service: connection URL, else Hadoop files, else host name."""
    from flowlens.functions.text import prop

    p = lambda n: F.nullif(prop(F.col("props"), n), F.lit(""))
    return services.filter("service_id IS NOT NULL").select(
        "template", "service_id", F.col("name").alias("service_name"), F.col("type").alias("service_type"),
        F.coalesce(
            F.when(p("Database Connection URL").isNotNull(), jdbc_source(p("Database Connection URL"))),
            F.concat(F.lit("HBase Cluster ("), p("Hadoop Configuration Files"), F.lit(")")),
            F.concat(F.lit("SFTP: "), p("Hostname")),
        ).alias("source_detail"),
    )


def processor_services(processors: DataFrame, services: DataFrame) -> DataFrame:
    """First property of each processor that names a known controller service."""
    named = variables.properties(processors).select("template", "processor_id", "prop_ord", F.col("prop_value").alias("service_id"))
    return named.join(service_map(services), ["template", "service_id"]).groupBy("template", "processor_id").agg(
        F.min_by(F.struct("service_id", "service_name", "service_type", "source_detail"), "prop_ord").alias("s")
    ).select("template", "processor_id", "s.*")
