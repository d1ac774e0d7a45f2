"""Flow-shaped views over the star-schema test tables.

``part`` rows become processors of 32-step templates. Everything is a narrow projection of
``part`` except the edge views, which keep only edges whose target part exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = 32
TYPE_BY_REMAINDER = [
    "ExecuteSQL",
    "PutSQL",
    "UpdateAttribute",
    "ExecuteStreamCommand",
    "RouteOnAttribute",
    "ListFile",
    "PutHDFS",
    "ExtractText",
]
TYPE_PREFIX = "org.example.processors."


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, read in its own splits."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prop(name: Column | str, value: Column | str) -> Column:
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(as_col(name).alias("name"), as_col(value).alias("value"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def processors(part: DataFrame, table_names: int | None = None) -> DataFrame:
    """One row per processor with its ordered properties nested (no shuffle).

    ``table_names`` folds the table numbers to that many, so that more processors share tables.
    """
    key, size = F.col("p_partkey"), F.col("p_size")
    step = key % STEPS
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    brand = brand if table_names is None else brand % table_names
    color = F.substring_index("p_name", " ", 1)
    schema = F.lower("p_type")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPE_BY_REMAINDER]), size % 8 + 1)
    own_table = _text(schema, ".t_", brand)
    warehouse = _text("/user/hive/warehouse/", schema, ".db/t_", brand, "/")
    service = _prop("JDBC Controller Service", _text("svc_dbcp_", brand % 5))
    select_sql = _text(
        "INSERT INTO ", own_table, " SELECT * FROM ", schema, ".t_", (brand + 1) % 25,
        " JOIN stage.", color,
        F.when(size % 3 == 0, _text(" JOIN ${tbl_", step % 4, "} v")).otherwise(F.lit("")),
        " WHERE 1 = 1",
    )
    merge_sql = _text(
        "MERGE INTO ", own_table, " USING stage.", color,
        " ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1",
    )
    arguments = _text(
        "-i impala-", brand, '.example.org:21000 -q "REFRESH ${tbl_1}" -e "${query_2}"',
        F.when(key % 11 == 0, _text(" password=passw0rd", step)).otherwise(F.lit("")),
    )
    props = (
        F.when(kind == "ExecuteSQL", F.array(_prop("SQL select query", select_sql), service))
        .when(kind == "PutSQL", F.array(_prop("SQL statement", merge_sql), service))
        .when(
            kind == "UpdateAttribute",
            F.array(
                _prop(
                    _text("tbl_", step % 4),
                    F.when(size % 5 == 0, _text("${tbl_", (step + 1) % 4, "}")).otherwise(own_table),
                ),
                _prop(
                    _text("query_", step % 4),
                    _text("INSERT INTO ", own_table, " SELECT * FROM stage.", color),
                ),
            ),
        )
        .when(
            kind == "ExecuteStreamCommand",
            F.array(
                _prop("Command Path", _text("/opt/jobs/", color, ".sh")),
                _prop("Command Arguments", arguments),
            ),
        )
        .when(kind == "RouteOnAttribute", F.array(_prop("big", "${tbl_2:isEmpty():not()}")))
        .when(kind == "ListFile", F.array(_prop("Input Directory", warehouse)))
        .when(kind == "PutHDFS", F.array(_prop("Directory", warehouse)))
        .otherwise(
            F.array(
                _prop("Character Set", "UTF-8"),
                _prop(_text("var_", step % 4), "(.*)"),
            )
        )
    )
    return part.select(
        _text("flow_", F.floor(key / STEPS)).alias("template"),
        key.alias("proc_ord"),
        _text("p", key).alias("processor_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit(TYPE_PREFIX), kind).alias("type"),
        F.when(size % 9 == 0, F.lit("reviewed")).otherwise(F.lit("")).alias("comments"),
        schema.alias("parent_group"),
        F.concat(F.lit("Root/"), schema).alias("parent_group_path"),
        F.transform(
            props,
            lambda p, i: F.struct(i.alias("ord"), p["name"].alias("name"), p["value"].alias("value")),
        ).alias("props"),
    )


def connections(part: DataFrame, cyclic: bool = False) -> DataFrame:
    """Edges n -> n+1 and n -> n+5 inside a template; ``cyclic`` adds back edges n -> n-3."""
    key, size = F.col("p_partkey"), F.col("p_size")
    step = key % STEPS
    hop = lambda delta, ord_, cond: F.when(
        cond, F.struct((key + delta).alias("target"), (key * 2 + ord_).alias("conn_ord"))
    )
    hops = [
        hop(1, 0, (size % 7 != 0) & (step + 1 < STEPS)),
        hop(5, 1, (size % 3 == 0) & (step + 5 < STEPS)),
    ]
    if cyclic:
        hops.append(hop(-3, 1_000_000_000, (key % 97 == 0) & (step >= 3)))
    edges = part.select(
        key.alias("from_key"),
        F.when(size % 2 == 0, F.array(F.lit("success")))
        .otherwise(F.array(F.lit("success"), F.lit("failure")))
        .alias("relationships"),
        F.explode(F.array_compact(F.array(*hops))).alias("h"),
    )
    existing = part.select(F.col("p_partkey").alias("to_key"))
    return edges.join(existing, F.col("h.target") == F.col("to_key"), "left_semi").select(
        _text("flow_", F.floor(F.col("from_key") / STEPS)).alias("template"),
        F.col("h.conn_ord").alias("conn_ord"),
        _text("p", F.col("from_key")).alias("source"),
        _text("p", F.col("h.target")).alias("destination"),
        F.lit("PROCESSOR").alias("source_type"),
        F.lit("PROCESSOR").alias("destination_type"),
        "relationships",
    )


def ported_connections(part: DataFrame) -> DataFrame:
    """The same edges, every third one routed through an input or output port."""
    edges = connections(part)
    port_kind = F.when(F.col("conn_ord") % 6 == 0, F.lit("INPUT_PORT")).otherwise(F.lit("OUTPUT_PORT"))
    port = F.concat(F.lit("port_"), F.col("conn_ord").cast("string"))
    routed = F.col("conn_ord") % 3 == 0
    leg = lambda src, dst, src_t, dst_t, rels: F.struct(
        src.alias("source"), dst.alias("destination"),
        src_t.alias("source_type"), dst_t.alias("destination_type"), rels.alias("relationships"),
    )
    proc = F.lit("PROCESSOR")
    src, dst, rels = F.col("source"), F.col("destination"), F.col("relationships")
    legs = F.when(
        routed,
        F.array(
            leg(src, port, proc, port_kind, rels),
            leg(port, dst, port_kind, proc, F.array().cast("array<string>")),
        ),
    ).otherwise(F.array(leg(src, dst, proc, proc, rels)))
    return edges.select("template", "conn_ord", F.posexplode(legs).alias("leg", "c")).select(
        "template", (F.col("conn_ord") * 2 + F.col("leg")).alias("conn_ord"), "c.*"
    )


def labelled_processors(part: DataFrame) -> DataFrame:
    """Processors whose names carry operational phrases, for the legacy rule ladder."""
    phrases = ["", "wait for ", "log error ", "dummy ", "refresh table ", "manual trigger ",
               "route on error ", "kerberos ", "clear content ", "custom_copy ", "split loaders "]
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("proc_ord") % 11 + 1).cast("int"))
    return processors(part).withColumn("name", F.concat(phrase, F.col("name")))


def ddl_texts(part: DataFrame) -> DataFrame:
    """One legacy CREATE TABLE text per part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    body = _text(
        "%sql\nCREATE EXTERNAL TABLE ",
        F.when(size % 2 == 0, F.lit("IF NOT EXISTS ")).otherwise(F.lit("")),
        F.lower("p_type"), ".t_", key, " (\n  id BIGINT,\n  load_ts STRING,\n  amount DECIMAL(10,2) COMMENT 'net',\n  ",
        F.substring_index("p_name", " ", 1),
        F.when(size % 3 == 0, F.lit(" STRUCT<a:INT,b:STRING>")).otherwise(F.lit(" MAP<STRING,INT>")),
        "\n)\n",
        F.when(size % 5 == 0, F.lit("")).otherwise(F.lit("PARTITIONED BY (\n  day_ts STRING,\n  region STRING\n)\n")),
        "STORED AS PARQUET\nLOCATION '/warehouse/x'",
    )
    return part.select(_text("ddl_", key, ".sql").alias("file"), body.alias("ddl"))


def _xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def template_documents(part: DataFrame) -> DataFrame:
    """(template, path, content) per template: the processors and connections rendered as one XML document."""
    entry = lambda p: _text("<entry><key>", _xml(p["name"]), "</key><value>", _xml(p["value"]), "</value></entry>")
    rows = processors(part).select(
        "template", F.col("proc_ord").alias("o"), F.lit(0).alias("k"),
        _text("<processors><config><descriptors><entry><key>x</key></entry></descriptors><comments>", F.col("comments"),
              "</comments><properties>", F.array_join(F.transform("props", entry), ""), "</properties></config><id>",
              F.col("processor_id"), "</id><name>", F.col("name"), "</name><type>", F.col("type"), "</type><parentGroupId>",
              F.col("parent_group"), "</parentGroupId></processors>").alias("x"),
    )
    edges = connections(part).select(
        "template", F.col("conn_ord").alias("o"), F.lit(1).alias("k"),
        _text("<connections>", F.array_join(F.transform("relationships", lambda r: _text("<selectedRelationships>", r, "</selectedRelationships>")), ""),
              "<source><id>", F.col("source"), "</id></source><destination><id>", F.col("destination"), "</id></destination></connections>").alias("x"),
    )
    groups = processors(part).select("template", "parent_group").distinct().select(
        "template", F.lit(0).cast("long").alias("o"), F.lit(-1).alias("k"),
        _text("<processGroups><id>", F.col("parent_group"), "</id><name>", F.initcap("parent_group"), "</name></processGroups>").alias("x"),
    )
    body = rows.unionByName(edges).unionByName(groups).groupBy("template").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "x"))), lambda r: r["x"]), "").alias("body"))
    return body.select(
        "template", _text("memory:/", F.col("template")).alias("path"),
        F.encode(_text("<template><snippet>", F.col("body"), "</snippet></template>"), "UTF-8").alias("content"),
    )
