import pytest
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.operators import chains, ddl, lineage, patterns, scripts, tables
from flowlens.plans import pipeline
from flowlens.sources import files
from flowlens.sources.templates import Corpus, light_processors, template_files
from flowlens.streaming.ingest import current_summary, ingest, ingest_changes, live_files, process_batch, read_ledger

PROC = """<processors><id>{id}</id><name>{name}</name><type>org.x.{kind}</type><parentGroupId>{group}</parentGroupId><config><comments> note </comments>
<descriptors><entry><key>Hidden</key><value>1</value></entry></descriptors><properties>{props}</properties></config></processors>"""
ENTRY = "<entry><key>{k}</key><value>{v}</value></entry>"
LINK = """<connections><id>{id}</id><source><id>{a}</id></source><destination><id>{b}</id></destination>
<selectedRelationships>success</selectedRelationships><selectedRelationships></selectedRelationships></connections>"""


def template(tag=""):
    props = ENTRY.format(k="SQL select query", v="INSERT INTO db.out_log SELECT * FROM db.in_log" + tag) + "<entry><key>Empty</key></entry>"
    inner = "<processGroups><id>g2</id><name>Inner</name><parentGroupId>g1</parentGroupId><contents>" + PROC.format(
        id="p1", name="Load", kind="ExecuteSQL", group="g2", props=props) + "</contents></processGroups>"
    outer = "<processGroups><id>g1</id><name>Outer</name><contents>" + inner + "<inputPorts><id>in</id><name>In</name></inputPorts></contents></processGroups>"
    return "<template><snippet>" + outer + PROC.format(id="p2", name="Put", kind="PutHDFS", group="none", props="") + LINK.format(
        id="c1", a="p1", b="p2") + "<controllerServices><id>s1</id><name>db</name><properties>" + ENTRY.format(
        k="Database Connection URL", v="jdbc:hive2://h:1/d") + "</properties></controllerServices></snippet></template>"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.xml").write_text(template())
    (tmp_path / "in" / "sub" / "b.xml").write_text(template())
    (tmp_path / "in" / "bad.xml").write_text("<template><oops>")
    (tmp_path / "in" / "note.txt").write_text("x")
    return tmp_path


def test_shred(spark, folder):
    corpus = Corpus.read(spark, str(folder / "in"))
    assert [r["template"] for r in corpus.errors.collect()] == ["bad.xml"]
    rows = {(r["template"], r["processor_id"]): r for r in corpus.processors.collect()}
    assert set(rows) == {("a.xml", "p1"), ("a.xml", "p2"), ("sub/b.xml", "p1"), ("sub/b.xml", "p2")}
    p1, p2 = rows["a.xml", "p1"], rows["a.xml", "p2"]
    assert (p1["parent_group"], p1["parent_group_path"], p1["comments"]) == ("Inner", "Outer/Inner", "note")
    assert [(x["name"], x["value"]) for x in p1["props"]][1] == ("Empty", None) and len(p1["props"]) == 2
    assert (p2["parent_group"], p2["parent_group_path"]) == ("Root", "Root")
    assert [(r["connection_id"], r["relationships"]) for r in corpus.connections.filter("template = 'a.xml'").collect()] == [("c1", ["success"])]
    assert corpus.ports.filter("template = 'a.xml'").first()["kind"] == "INPUT_PORT"
    counts = {r["template"]: (r["processor_count"], r["connection_count"]) for r in corpus.templates.collect()}
    assert counts == {"a.xml": (2, 1), "sub/b.xml": (2, 1), "bad.xml": (0, 0)}
    assert patterns.service_map(corpus.services).first()["source_detail"] == "Hive: h:1/d"
    with pytest.raises(ValueError):
        Corpus.read(spark, str(folder / "in"), fail_fast=True)


def test_light_scan(spark, folder):
    (folder / "in" / "bad.xml").unlink()
    rows = light_processors(spark, str(folder / "in")).filter("template = 'a.xml'").collect()
    assert {(r["id"], r["name"]) for r in rows} == {("p1", "Load"), ("p2", "Put")}


def test_pipelines_and_sinks(spark, folder):
    corpus = Corpus.read(spark, str(folder / "in"))
    p, c = corpus.processors, corpus.connections
    plan = pipeline.migration_plan(p, c)
    found = plan["chains"].filter("template = 'a.xml'").collect()
    assert [(r["source"]["id"], r["sink"]["id"], r["length"], r["business_pattern"]) for r in found] == [("p1", "p2", 2, "database_export")]
    summary = plan["chain_summary"].first()
    assert (summary["total_chains"], summary["avg_chain_length"], summary["isolated_processors"]) == (2, 2.0, 0)
    refs = tables.table_refs(p, c)
    found = lineage.analysis(p, c, refs)
    assert {(r["src"], r["dst"]) for r in found["chains"].collect()} == {("db.in_log", "db.out_log")}
    out = str(folder / "out")
    files.write_lineage_csv(found["chain_report"], out + "/lineage")
    assert spark.read.option("header", "true").csv(out + "/lineage").count() == 2
    files.write_summary_csv(plan["flat"], out + "/summary")
    files.write_summary_csv(plan["flat"], out + "/summary", append=True)
    assert files.summary_csv(spark, out + "/summary").count() == 8
    files.write_template_json(plan["classifications"], out + "/json")
    assert files.saved_template(spark, out + "/json", "a.xml").count() == 2
    back = files.saved_records(spark, out + "/json", plan["classifications"].schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, plan["classifications"].collect())) and back.count() == 4
    files.write_table_refs_csv(refs, out + "/refs", p)
    row = spark.read.option("header", "true").csv(out + "/refs").filter("source_file = 'b.xml'").first()
    assert list(row.asDict())[:8] == V.TABLE_REF_COLUMNS and row["source_path"].endswith("sub/b.xml") and row["processor_group"] == "Inner"
    files.write_scripts_csv(scripts.script_items(p), out + "/scripts", p)
    assert [f.name for f in (folder / "out" / "scripts").iterdir()]
    with pytest.raises(ValueError):
        files.write_matrix_csv(plan["flat"].limit(0), out + "/matrix")


def test_external_path_sink(spark, tmp_path):
    paths = spark.createDataFrame([("a", "/x/2.sh"), ("a", "/x/1.sh")], "template string, path string")
    templates = spark.createDataFrame([("a",), ("b",)], "template string")
    files.write_external_paths(paths, str(tmp_path / "p"), templates)
    rows = spark.read.text(str(tmp_path / "p")).collect()
    assert {(r["template"], r["value"]) for r in rows} == {("a", "/x/1.sh"), ("a", "/x/2.sh"), ("b", "")}


def test_saved_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"workflow": {"filename": "w.xml"},\n "classifications": [{"processor_id": "1"}, {"processor_id": "2"}]}')
    assert {(r["template"], r["processor_id"]) for r in files.saved_records(spark, str(tmp_path)).collect()} == {("w.xml", "1"), ("w.xml", "2")}


def test_stream_skips_unchanged_files(spark, folder):
    location, out = str(folder / "in"), str(folder / "out")
    run = lambda: ingest(spark, location, out + "/summary", out + "/ledger", out + "/chk").awaitTermination()
    count = lambda: spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(out + "/summary").count()
    run()
    assert count() == 4 and read_ledger(spark, out + "/ledger").count() == 3
    (folder / "in" / "c.xml").write_text(template())
    run()
    assert count() == 6


def test_changed_and_nested_files_are_read_again(spark, folder):
    location, out = str(folder / "in"), str(folder / "out")
    run = lambda: ingest_changes(spark, location, out + "/summary", out + "/ledger", max_files=2)
    assert run() == 3 and run() == 0
    (folder / "in" / "team").mkdir()
    (folder / "in" / "team" / "a.xml").write_text(template())
    (folder / "in" / "b.xml").write_text(template() + " ")
    assert run() == 2 and run() == 0
    assert read_ledger(spark, out + "/ledger").count() == 5


def test_newest_generation_supersedes_and_removed_files_vanish(spark, folder):
    location, out = str(folder / "in"), str(folder / "out")
    run = lambda: ingest_changes(spark, location, out + "/summary", out + "/ledger")
    rows = lambda: sorted((r["template"], r["processor_id"], r["batch"]) for r in current_summary(spark, out + "/summary", out + "/ledger").collect())
    file = folder / "in" / "a.xml"
    first, second = template(), template().replace("<id>p2</id>", "<id>p22</id>")
    assert run() == 3
    file.write_text(second)
    assert run() == 1
    assert [r[1] for r in rows() if r[0] == "a.xml"] == ["p1", "p22"]
    file.write_text(first + "\n")
    file.write_text(first)
    (folder / "in" / "sub" / "b.xml").unlink()
    assert run() == 1 and run() == 0
    now = rows()
    assert [r[1] for r in now] == ["p1", "p2"] and {r[0] for r in now} == {"a.xml"}
    ledger = read_ledger(spark, out + "/ledger")
    newest = ledger.agg({"batch_id": "max"}).first()[0]
    files = template_files(spark, str(file)).withColumn("template", F.lit("a.xml"))
    process_batch(files, newest, out + "/summary", out + "/ledger")
    assert rows() == now
    # seen again with the same content: still the generation that analysed it
    process_batch(files, newest + 1, out + "/summary", out + "/ledger")
    assert rows() == now
    (folder / "in" / "sub" / "b.xml").write_text(template())
    assert run() == 1 and len(rows()) == 4


def test_live_files(spark):
    entries = [("p", "A", 1), ("p", "B", 2), ("p", "A", 3), ("p", "A", 4), ("q", "A", 1), ("q", None, 2), ("r", "A", 1), ("r", "A", 5), ("r", "A", 7)]
    rows = [(p, c, b, (p, b) in {("q", 2), ("r", 5)}) for p, c, b in entries]
    ledger = spark.createDataFrame(rows, "path string, checksum string, batch_id long, removed boolean")
    assert {(r["path"], r["checksum"], r["batch_id"], r["generation"]) for r in live_files(ledger).collect()} == {("p", "A", 4, 3), ("r", "A", 7, 7)}
    assert live_files(ledger.limit(0)).collect() == []


def test_equal_names_repeated_ids_and_bad_encodings(spark, tmp_path):
    for team in ("x", "y"):
        (tmp_path / "in" / team).mkdir(parents=True)
        (tmp_path / "in" / team / "flow.xml").write_text(template())
    twice = "".join(PROC.format(id="", name="Set", kind="UpdateAttribute", group="none",
                                props=f"<entry><key>tbl</key><value>db.t{i}</value></entry>") for i in (1, 2))
    (tmp_path / "in" / "ids.xml").write_text(f"<template><snippet>{twice}</snippet></template>")
    (tmp_path / "in" / "odd.xml").write_text('<?xml version="1.0" encoding="no-such"?><template/>')
    corpus = Corpus.read(spark, str(tmp_path / "in"))
    assert {r["template"] for r in corpus.processors.select("template").distinct().collect()} == {"x/flow.xml", "y/flow.xml", "ids.xml"}
    assert {r["source_file"] for r in corpus.processors.filter("template LIKE '%flow.xml'").collect()} == {"flow.xml"}
    assert [r["template"] for r in corpus.errors.collect()] == ["odd.xml"]
    tables.table_refs(corpus.processors, corpus.connections).collect()
    maps = tables.variable_maps(corpus.processors.withColumn("props", F.concat("props", F.array(F.struct(
        F.lit(9).alias("ord"), F.lit("use").alias("name"), F.lit("${tbl}").alias("value"))))), corpus.connections)
    assert {r["template"]: r["values"] for r in maps.collect()}["ids.xml"] == {"tbl": "db.t2"}


DDL = """%sql
CREATE EXTERNAL TABLE db.raw (
  id BIGINT,
  load_ts STRING COMMENT 'when',
  price DECIMAL(10,2),
  tags STRUCT<a:INT,b:MAP<STRING,INT>>
)
PARTITIONED BY (day STRING)
STORED AS PARQUET
LOCATION 'x'"""


def test_ddl(spark, tmp_path):
    (tmp_path / "a.sql").write_text(DDL)
    (tmp_path / "b.sql").write_text("select 1")
    (tmp_path / "c.sql").write_text("  \n")
    parsed = ddl.parsed(files.ddl_files(spark, folder=str(tmp_path)))
    assert {(r["file"], r["error"]) for r in parsed.collect()} == {("a.sql", None), ("b.sql", "no table name")}
    got = [(r["column"], r["type"], r["is_partition"]) for r in ddl.ddl_columns(parsed.filter("error IS NULL")).orderBy("ord").collect()]
    assert got == [("id", "BIGINT", False), ("load_ts", "STRING", False), ("price", "DECIMAL(10,2)", False),
                   ("tags", "STRUCT<a:INT,b:MAP<STRING,INT>>", False), ("day", "STRING", True)]
    better = ddl.ddl_columns(ddl.optimised(parsed)).filter("column = 'load_ts'").first()
    assert better["type"] == "TIMESTAMP"
    statements = ddl.rendered(parsed, target_schema="mig")
    assert "IF NOT EXISTS mig.raw" in statements.filter("step = 1").first()["statement"]
    assert ddl.apply(spark, statements).count() == 3
    delta = ddl.rendered(parsed, catalog="main", using="delta").filter("step = 3").first()
    assert delta["statement"] == "OPTIMIZE main.db.raw" and delta["optional"]
    with pytest.raises(ValueError):
        files.ddl_files(spark)


def test_patterns(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "w")], "k int, v string")
    got = {r["status"]: r["n"] for r in patterns.diff_counts(patterns.dataset_diff(a, b, ["k"])).collect()}
    assert got == {"same": 1, "changed": 1, "missing": 1, "extra": 1}
    routed = patterns.with_route(a, {"first": F.col("k") == 1, "low": F.col("k") < 3})
    assert [r["route"] for r in routed.orderBy("k").collect()] == ["first", "low", "unmatched"]
    assert patterns.funnel(a, b.drop("v")).filter("v IS NULL").count() == 3
    assert patterns.execute_sql(spark, "SELECT count(*) AS n FROM {t}", t=a).first()["n"] == 3


def test_legacy_prune(spark):
    rows = spark.createDataFrame([("data_movement", "low"), ("unknown", "unknown"), ("infrastructure_only", "none")], "data_manipulation_type string, data_impact_level string")
    got = chains.legacy_prune_summary(chains.legacy_prune(rows)).first()
    assert (got["kept_count"], got["pruned_count"], got["unknown_count"], got["reduction_percentage"]) == (1, 2, 1, 66.7)


def test_no_python_in_column_plans(spark, make_processors, make_connections):
    p = make_processors([("t", "q", "Read", "org.x.ExecuteSQL", "Root", {"SQL select query": "SELECT * FROM a.b_log"})])
    c = make_connections([("t", "q", "z")])
    plan = lineage.lineage_edges(lineage.lineage_sources(p, c, tables.table_refs(p, c)), c)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "MapInPandas" not in plan
