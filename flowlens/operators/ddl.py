"""Schema migration: legacy CREATE TABLE texts to catalogue columns and managed-table DDL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.text import flag, strip

CREATE = r"CREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"
NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
COLUMNS = r"\(([^)]+(?:\([^)]*\)[^)]*)*)\)\s*(?:PARTITIONED BY|STORED AS|LOCATION|\z)"
PARTITIONS = r"PARTITIONED\s+BY\s*\(([^)]+)\)"
COLUMN_TYPE = "array<struct<ord:int,column:string,type:string,is_partition:boolean>>"


def split_definitions(text: Column) -> Column:
    """Split on commas outside parentheses and angle brackets, folding over brackets and commas."""
    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + flag(ch.isin("(", "<")) - flag(ch.isin(")", ">"))
        return F.struct(
            depth.alias("depth"),
            F.concat(s["text"], F.when((ch == ",") & (depth == 0), F.lit("\x01")).otherwise(ch)).alias("text"),
        )

    marked = F.aggregate(F.split(text, r"(?<=[,()<>])|(?=[,()<>])"), F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step)
    return F.filter(F.transform(F.split(marked["text"], "\x01"), strip), lambda d: d.rlike(r"\S\s+\S"))


def _column(definition: Column, ord_: Column, partition: bool) -> Column:
    rest = F.regexp_extract(definition, r"(?s)^\S+\s+(.*)\z", 1)
    bare = F.when(F.upper(rest).contains("COMMENT"), F.substring_index(rest, "COMMENT", 1)).otherwise(rest)
    return F.struct(
        ord_.alias("ord"), F.regexp_extract(definition, r"^(\S+)", 1).alias("column"),
        F.btrim(strip(bare), F.lit("'\"")).alias("type"), F.lit(partition).alias("is_partition"),
    )


def parsed(files: DataFrame) -> DataFrame:
    """(file, schema, table, columns, error) per DDL text; partition columns come last."""
    ddl = strip(F.col("ddl"))
    schema = F.nullif(F.regexp_extract(ddl, rf"(?i){CREATE}({NAME})\.{NAME}", 1), F.lit(""))
    table = F.nullif(F.regexp_extract(ddl, rf"(?i){CREATE}(?:{NAME}\.)?({NAME})", 1), F.lit(""))
    body, keys = F.regexp_extract(ddl, f"(?is){COLUMNS}", 1), F.regexp_extract(ddl, f"(?is){PARTITIONS}", 1)
    rows = files.select(
        "file", schema.alias("schema"), table.alias("table"),
        split_definitions(body).alias("data"), split_definitions(keys).alias("keys"), (body == "").alias("no_body"),
    )
    columns = F.concat(
        F.transform("data", lambda d, i: _column(d, i, False)),
        F.transform("keys", lambda d, i: _column(d, i + F.size("data"), True)),
    ).cast(COLUMN_TYPE)
    return rows.select(
        "file", "schema", "table", columns.alias("columns"),
        F.when(F.col("table").isNull(), F.lit("no table name")).when(F.col("no_body"), F.lit("no column definitions")).alias("error"),
    )


def optimised(tables: DataFrame) -> DataFrame:
    """Data columns: upper-case types, ``*_ts`` STRING to TIMESTAMP. Partition columns stay."""
    better = lambda c: F.when(c["is_partition"], c["type"]).when(
        c["column"].endswith("_ts") & F.upper(c["type"]).contains("STRING"), F.lit("TIMESTAMP")
    ).otherwise(F.upper(c["type"]))
    return tables.withColumn("columns", F.transform("columns", lambda c: F.struct(
        c["ord"].alias("ord"), c["column"].alias("column"), better(c).alias("type"), c["is_partition"].alias("is_partition"))))


def ddl_columns(tables: DataFrame) -> DataFrame:
    return tables.select("file", "schema", "table", F.inline("columns"))


def rendered(
    tables: DataFrame, catalog: str | None = None, target_schema: str | None = None, using: str = "parquet",
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Statements per table: (file, full_name, step, statement, optional)."""
    schema = F.lit(target_schema) if target_schema else F.coalesce("schema", F.lit("default"))
    home = F.concat(F.lit(f"{catalog}."), schema) if catalog else schema
    full = F.concat(home, F.lit("."), F.col("table"))
    columns = F.array_join(F.transform("columns", lambda c: F.concat(F.lit("  "), c["column"], F.lit(" "), c["type"])), ",\n")
    keys = F.filter("columns", lambda c: c["is_partition"])
    partition = F.when(
        F.size(keys) > 0, F.concat(F.lit("\nPARTITIONED BY ("), F.array_join(F.transform(keys, lambda c: c["column"]), ", "), F.lit(")"))
    ).otherwise(F.lit(""))
    props = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
    create = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS "), full, F.lit(" (\n"), columns, F.lit(f"\n)\nUSING {using}"), partition,
        F.lit(f"\nTBLPROPERTIES ({props})" if props else ""),
    )
    step = lambda s, optional: F.struct(s.alias("statement"), F.lit(optional).alias("optional"))
    steps = [
        step(F.concat(F.lit("CREATE SCHEMA IF NOT EXISTS "), home), False), step(create, False),
        step(F.concat(F.lit("DESCRIBE EXTENDED "), full), True),
    ]
    if using.lower() == "delta":
        steps.append(step(F.concat(F.lit("OPTIMIZE "), full), True))
    return tables.filter("error IS NULL").select(
        "file", full.alias("full_name"), F.posexplode(F.array(*steps)).alias("step", "s")
    ).select("file", "full_name", "step", "s.statement", "s.optional")


def apply(spark: SparkSession, statements: DataFrame, dry_run: bool = True) -> DataFrame:
    """Run the statements table by table; a dry run returns them as they are.

    DDL is a driver-side catalogue call, so statements are streamed to the driver in order.
    """
    if dry_run:
        return statements
    outcome: dict[str, tuple] = {}
    for row in statements.orderBy("full_name", "file", "step").toLocalIterator():
        key = (row["file"], row["full_name"])
        if outcome.get(key, ("success",))[0] == "failed":
            continue
        try:
            spark.sql(row["statement"])
            outcome.setdefault(key, ("success", None))
        except Exception as exc:
            if not row["optional"]:
                outcome[key] = ("failed", str(exc).splitlines()[0])
    return spark.createDataFrame(
        [(f, t, s, e) for (f, t), (s, e) in outcome.items()], "file string, full_name string, status string, error string"
    )


def batch_stats(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("status").agg(F.count("*").alias("n"))
