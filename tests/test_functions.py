import base64

import pytest
from pyspark.sql import functions as F

from flowlens.functions import code, scoring, sqltext, text


@pytest.mark.parametrize("value, expected", [
    ("password=passw0rd", "password='***'"),
    ("token = abc rest of text", "token='***' rest of text"),
    ("AWS_SECRET_ACCESS_KEY=abcd/ef", "aws_secret_access_key='***'"),
    ("nothing here", "nothing here"),
])
def test_redaction_uses_a_real_whitespace_class(value_of, value, expected):
    assert value_of(text.redact, v=value) == expected


def test_el_resolution_is_simultaneous_and_leaves_unknown_keys(spark):
    df = spark.createDataFrame([("a ${x} ${y:fn()} ${z}!", {"x": "1", "y": "${x}"})], "t string, m map<string,string>")
    assert df.select(text.substitute_once(F.col("t"), F.col("m"))).first()[0] == "a 1 ${x} ${z}!"
    assert df.select(text.resolve_el(F.col("t"), F.col("m"))).first()[0] == "a 1 1 ${z}!"


def test_base64_text(value_of):
    wrapped = base64.b64encode("select a from b where c = 1".encode()).decode()
    assert value_of(text.decode_base64_text, v=wrapped) == "select a from b where c = 1"
    assert value_of(text.decode_base64_text, v="short") is None
    assert value_of(text.decode_base64_text, v="x" * 32) is None


@pytest.mark.parametrize("value, lang, conf", [
    ("SELECT a FROM b", "sql", 0.4),
    ("#!/bin/bash\necho hi | grep x", "bash", 0.7),
    ("def f(x):\n  import os", "python", 0.55),
    ("plain words", "unknown", 0.3),
])
def test_language_guess(value_of, value, lang, conf):
    got = value_of(code.guess_language, v=value)
    assert (got["lang"], round(got["confidence"], 6)) == (lang, conf)


def test_language_guess_reads_the_whole_text(value_of):
    late = "x " * 15000 + "SELECT a FROM b"
    assert value_of(code.guess_language, v=late)["lang"] == "sql"
    assert value_of(lambda c: code.guess_language(c, 20000), v=late)["lang"] == "unknown"


@pytest.mark.parametrize("value, expected", [
    ("${a}", True), ("${a:b(${c})}", True), ("  ${a:b(${c:d(${e})})}  ", True), ("${a} and ${b}", False), ("/bin/mv ${f}", False), ("${a", False),
])
def test_single_expression_scans_nested_braces(value_of, value, expected):
    assert value_of(code.is_single_expression, v=value) is expected


@pytest.mark.parametrize("name, value, kind, expected", [
    ("query_1", "x", "UpdateAttribute", True),
    ("Command Path", "x" * 60, "ExecuteStreamCommand", False),
    ("big", "${a:isEmpty():not():and(${b:isEmpty():not()})}", "RouteOnAttribute", False),
    ("Script Body", "print(1)\nprint(2)", "ExecuteScript", True),
    ("log-message", "INSERT query finished with some more words here", "LogMessage", False),
    ("Script File", "/opt/jobs/a_very_long_folder_name/more/run.sh", "ExecuteScript", False),
    ("note", "short", "UpdateAttribute", False),
])
def test_looks_like_code(value_of, name, value, kind, expected):
    assert value_of(code.looks_like_code, n=name, v=value, t=kind) is expected


@pytest.mark.parametrize("path, kind", [("/a/b.SH", "shell_script"), ("x.R", "r_script"), ("x.jar", "java_application"), ("x", "unknown_script")])
def test_script_type_ignores_case(value_of, path, kind):
    assert value_of(code.script_type, p=path) == kind


def test_command_scripts(value_of):
    assert value_of(code.command_scripts, c="/opt/a.sh -x 'tool.py' /opt/a.sh") == ["/opt/a.sh", "tool.py"]
    assert value_of(code.command_scripts, c="run *.sh") == []


def test_hosts(value_of):
    assert value_of(code.external_hosts, t="see https://Db.corp.org:80/x and a.example.com") == ["db.corp.org", "db.corp.org:80"]
    assert value_of(code.impala_hosts, t="-i h1:21000 -q x --impalad h2") == ["h1:21000", "h2"]


@pytest.mark.parametrize("url, expected", [
    ("jdbc:oracle:thin:@h:1521:db", "Oracle: h:1521:db"), ("jdbc:hive2://h:10000/d;ssl=1", "Hive: h:10000/d"),
    ("jdbc:mysql://h/db?x=1", "Database: h/db"), ("", "Unknown Database"), ("file:x", "file:x"),
])
def test_jdbc_source(value_of, url, expected):
    assert value_of(sqltext.jdbc_source, u=url) == expected


def test_warehouse_table(value_of):
    assert value_of(sqltext.warehouse_table, p="/user/hive/warehouse/a.db/t/x") == "a.t"
    assert value_of(sqltext.warehouse_table, p="/warehouse/a.db/t") == "a.t"
    assert value_of(sqltext.warehouse_table, p="/data/x") is None


def refs_of(spark, sql, compat=False, ptype="executesql", prop="sql select query"):
    df = spark.createDataFrame([(sql,)], "s string").withColumn("c", sqltext.clean_sql(F.col("s"))).withColumn(
        "h", sqltext.clause_hits(F.col("c"), compat)).withColumn("g", sqltext.accepted(F.col("h"), F.lit(ptype), F.lit(prop)))
    return {r["table_name"]: (r["sql_clause"], r["io_type"]) for r in df.select(F.inline(sqltext.folded_refs(F.col("g")))).collect()}


def test_sql_refs_fold_clauses(spark):
    got = refs_of(spark, "INSERT INTO db.t -- from x.y\nSELECT * FROM `db`.src s JOIN db.t ON 1=1 /* FROM no.no */")
    assert got["db.t"] == ("insert/join", "write")
    assert "x.y" not in got and "no.no" not in got


def test_create_patterns_and_compat(spark):
    assert refs_of(spark, "CREATE TABLE IF NOT EXISTS db.new_table (a int)") == {"db.new_table": ("create", "write")}
    assert refs_of(spark, "INSERT OVERWRITE TABLE db.log_data SELECT 1") == {"db.log_data": ("insert", "write")}
    assert refs_of(spark, "INSERT OVERWRITE TABLE db.log_data SELECT 1", compat=True) == {}


def test_score_gate_and_threshold(value_of):
    score = lambda n: scoring.table_score(n, F.lit("listfile"), F.lit("x"))
    assert value_of(score, n="a b") == 0.0
    assert value_of(score, n="x") == 0.0
    assert value_of(score, n="sales.order_log") > 0.35


def test_lineage_reads_and_writes(value_of):
    sql = "MERGE INTO a1.t USING a1.s; INSERT OVERWRITE TABLE `a1`.o SELECT * FROM a1.i JOIN p.cnt x"
    assert sorted(value_of(sqltext.sql_reads, s=sql)) == ["a1.i", "a1.t"]
    assert sorted(value_of(sqltext.sql_writes, s=sql)) == ["a1.t", "a1`.o"]


def test_slugify(value_of):
    assert value_of(text.slugify, s="--Put HDFS (v2)--") == "put_hdfs_v2"
