import json

import pytest
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.operators import batching, classify, features, filters, legacy, profiles, reports, scripts, store, tables, variables
from flowlens.plans import pipeline

FEATURE = """template string, processor_id string, proc_ord long, name string, processor_type string, short_type string,
parent_group string, parent_group_path string, props array<struct<ord:int,name:string,value:string>>,
controller_services array<string>, connections struct<incoming:array<string>,outgoing:array<string>>,
scripts struct<inline_count:int,external_count:int,external_hosts:array<string>>,
sql struct<has_sql:boolean,has_dml:boolean,has_metadata_only:boolean>, tables struct<tables:array<string>,properties:array<string>>,
variables struct<defines:array<struct<variable:string,property:string,value:string>>,uses:array<struct<variable:string,property:string,expression:string>>>,
uses_variables boolean"""


def feature(pid, short, dml=False, defines=(), uses=(), inline=0, external=0, path="Root", order=0, services=(), inc=(), out=()):
    return ("t", pid, order, f"name {pid}", f"org.example.{short}", short, path.rsplit("/", 1)[-1], path, [], list(services),
            (list(inc), list(out)), (inline, external, []), (dml, dml, False), ([], []),
            ([(v, v, "1") for v in defines], [(v, "p", "${%s}" % v) for v in uses]), bool(uses))


@pytest.fixture(scope="module")
def make_features(spark):
    return lambda rows: spark.createDataFrame(rows, FEATURE)


def by_id(df, *columns):
    return {r["processor_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_dml_matches_the_business_rule_and_short_type_is_derived(make_features):
    f = make_features([feature("A", "ExecuteSQL", dml=True)])
    assert by_id(classify.classify(f.drop("short_type")), "migration_category", "confidence") == {"A": (V.BUSINESS, 0.9)}


def test_unknown_type_falls_to_the_default(make_features):
    got = by_id(classify.classify(make_features([feature("A", "Mystery")])), "migration_category", "confidence")["A"]
    assert got[0] in (V.INFRASTRUCTURE, V.AMBIGUOUS) and got[1] <= 0.5
    none = classify.classify(make_features([feature("A", "Mystery")]), rules=[{"name": "x", "processor_types": "other"}])
    assert by_id(none, "rule", "databricks_target")["A"] == ("No Match", "Needs review")


def test_promotion_of_a_variable_provider(make_features):
    f = make_features([feature("A", "UpdateAttribute", defines=["foo"], order=0), feature("B", "ExecuteSQL", dml=True, uses=["foo"], order=1)])
    rows = classify.classify_corpus(f)
    got = by_id(rows, "migration_category", "classification_source", "databricks_target", "confidence", "promotion_reason")
    assert got["A"][:4] == (V.BUSINESS, "promotion", "Variable setup", 0.6)
    assert got["A"][4] == "Promoted from Orchestration / Monitoring after detecting variables foo consumed by downstream processors name B."
    assert {r["migration_category"]: r["n"] for r in classify.category_counts(rows).collect()} == {V.BUSINESS: 2}


def promoted_in_order(rows):
    """Plain sequential evaluation: earlier promotions count for later records."""
    category, out = {p: c for p, c, _, _ in rows}, set()
    for pid, _, sets, _ in rows:
        if category[pid] in V.PROMOTABLE_CATEGORIES and any(
                v in uses and other != pid and category[other] in V.CONSUMER_CATEGORIES for v in sets for other, _, _, uses in rows):
            category[pid] = V.BUSINESS
            out.add(pid)
    return out


def test_cascade_equals_sequential_evaluation(make_features):
    spec = [("P0", "UpdateAttribute", ["a"], ["b"]), ("P1", "UpdateAttribute", ["b"], ["c"]), ("P2", "ExecuteSQL", [], ["b"]),
            ("P3", "UpdateAttribute", ["c"], ["d"]), ("P4", "UpdateAttribute", ["d"], []), ("P5", "UpdateAttribute", ["z"], ["z"])]
    f = make_features([feature(p, k, dml=k == "ExecuteSQL", defines=d, uses=u, order=i) for i, (p, k, d, u) in enumerate(spec)])
    base = classify.classify(f)
    categories = by_id(base, "migration_category")
    want = promoted_in_order([(p, categories[p][0], d, u) for p, _, d, u in spec])
    got = {p for p, (s,) in by_id(classify.promote(base), "classification_source").items() if s == "promotion"}
    assert got == want == {"P1", "P3", "P4"}
    once = {p for p, (s,) in by_id(classify.promote(base, cascade=False), "classification_source").items() if s == "promotion"}
    assert once == {"P1"}


def test_overrides_win_and_lift_confidence(spark, make_features):
    o = classify.override_rows(spark, {"A": {"migration_category": V.SINK}, "B": {"confidence": 0.3, "notes": "n"}})
    got = by_id(classify.classify(make_features([feature("A", "Mystery"), feature("B", "Mystery")]), overrides=o),
                "migration_category", "confidence", "classification_source")
    assert got == {"A": (V.SINK, 0.95, "override"), "B": (V.INFRASTRUCTURE, 0.3, "override")}


@pytest.mark.parametrize("condition, expected", [
    ({"field": "sql.has_dml", "equals": True}, True), ({"field": "sql.has_dml", "not_equals": True}, False),
    ({"field": "scripts.inline_count", "gt": 1}, True), ({"field": "scripts.inline_count", "lt": 2}, False),
    ({"field": "missing.path", "gt": -1}, True), ({"field": "name", "contains": "ame A"}, True), ({"field": "name", "gt": 0}, False),
    ({"field": "controller_services", "contains": "dbcp"}, True), ({"field": "controller_services", "contains_any": ["x", "dbcp"]}, True),
    ({"field": "name", "contains_any": ["n"]}, False), ({"field": "scripts.inline_count", "contains": 2}, False),
])
def test_condition_language(make_features, condition, expected):
    f = make_features([feature("A", "X", dml=True, inline=2, services=["dbcp"])])
    assert f.select(classify.condition_column(f, condition)).first()[0] is expected


def test_empty_rulebook_is_an_error():
    with pytest.raises(ValueError):
        classify.normalise_rules({"rules": []})


def test_quick_override(make_features):
    rows = classify.classify(make_features([feature("A", "Mystery")]), rules=[{"name": "x", "processor_types": "other"}])
    got = classify.quick_override(rows, V.SINK, ["A"]).first()
    assert (got["databricks_target"], got["confidence"]) == ("Delta or external sink task", 0.95)


def test_group_profiles(make_features, make_connections):
    f = make_features([
        feature("A", "ExecuteSQL", dml=True, path="Root/GroupA", services=["svc"], defines=["v"], inline=1, order=0),
        feature("B", "Mystery", path="Root/GroupA", uses=["v"], external=2, order=1),
        feature("C", "PutHDFS", path="Root/GroupB", order=2), feature("D", "PutHDFS", path="", order=3)])
    rows = classify.classify(f)
    got = {r["group_path"]: r for r in profiles.group_profiles(rows, make_connections([("t", "A", "B"), ("t", "B", "C")])).collect()}
    a, b = got["Root/GroupA"], got["Root/GroupB"]
    assert (a["group"], a["processor_count"], a["needs_migration_count"], a["ambiguous_count"]) == ("GroupA", 2, 1, 1)
    assert a["migration_category_counts"] == {V.BUSINESS: 1, V.INFRASTRUCTURE: 1} and a["dominant_category"] == V.INFRASTRUCTURE
    assert (a["inline_script_total"], a["external_script_total"], a["has_external_scripts"]) == (1, 2, True)
    assert [x["id"] for x in a["external_script_processors"]] == ["B"]
    assert (a["variables_defined"], a["variables_used"], a["controller_services"]) == (["v"], ["v"], ["svc"])
    assert (a["outgoing_groups"], b["incoming_groups"], b["incoming_group_count"]) == (["Root/GroupB"], ["Root/GroupA"], 1)
    assert "Root" in got


def test_feature_matrix_shape_and_flags(make_features, make_connections):
    f = make_features([feature("A", "ListFile", out=["B"]), feature("B", "PutHDFS", inc=["A"])])
    m = profiles.feature_matrix(classify.classify(f), make_connections([("t", "A", "B")]))
    assert len(m.columns) == 33 + 10 + 50
    got = by_id(m, "outgoing_has_puthdfs", "incoming_has_listfile", "is_terminal")
    assert got == {"A": (1, 0, 0), "B": (0, 1, 1)}


def test_rule_suggestions(make_features):
    flat = classify.flat_rows(classify.classify(make_features([feature("A", "ExecuteSQL", dml=True), feature("B", "Mystery", inline=1, uses=["v"])])))
    got = {r["name"]: r for r in profiles.rule_suggestions(flat, evidence=1).collect()}
    assert got["Auto: ExecuteSQL"]["migration_category"] == V.BUSINESS and got["Auto: Mystery"]["migration_category"] == V.ORCHESTRATION
    assert got["Auto: Mystery"]["notes"].endswith("avg inline_scripts=1.00; avg external_scripts=0.00; avg uses_variables=1.00")
    assert got["Auto: ExecuteSQL"]["evidence"][0]["processor_id"] == "A"
    covered = profiles.covered_types(V.DEFAULT_RULES)
    assert [r["name"] for r in profiles.rule_suggestions(flat, covered).collect()] == ["Auto: Mystery"]


def fold(sizes, max_items, max_chars):
    batches = []
    for s in sizes:
        if batches and len(batches[-1]) + 1 <= max_items and sum(batches[-1]) + s <= max_chars:
            batches[-1].append(s)
        else:
            batches.append([s])
    return batches


@pytest.mark.parametrize("max_items, max_chars", [(3, 10_000), (10, 900), (4, 400), (50, 100_000)])
def test_packing_equals_the_sequential_fold(spark, max_items, max_chars):
    import random

    rng = random.Random(7)
    rows = [(f"s{i % 3}", i, rng.choice([5, 60, 130, 950])) for i in range(180)]
    df = spark.createDataFrame(rows, "scope string, id long, size long")
    ordered = sorted(rows)
    whole = batching.pack(df, ["scope", "id"], "size", [], max_items, max_chars).orderBy("scope", "id").collect()
    want = [i + 1 for i, b in enumerate(fold([r[2] for r in ordered], max_items, max_chars)) for _ in b]
    assert [r["batch_index"] for r in whole] == want
    scoped = batching.pack(df, ["scope", "id"], "size", ["scope"], max_items, max_chars)
    for s in ("s0", "s1", "s2"):
        got = [r["batch_index"] for r in scoped.filter(F.col("scope") == s).orderBy("id").collect()]
        assert got == [i + 1 for i, b in enumerate(fold([r[2] for r in ordered if r[0] == s], max_items, max_chars)) for _ in b]


def test_batches_order_limits_and_script_notes(spark, make_features):
    rows = [feature(str(i), "Mystery", order=i) for i in range(6)]
    records = classify.classify(make_features(rows)).withColumn("template", F.when(F.col("processor_id") < "3", F.lit("b.xml")).otherwise(F.lit("a.xml")))
    got = batching.build_batches(records, max_items=3).orderBy("batch_index").collect()
    assert [r["processor_ids"] for r in got] == [["3", "4", "5"], ["0", "1", "2"]]
    assert [r["templates"] for r in got] == [["a.xml"], ["b.xml"]] and [r["processor_count"] for r in got] == [3, 3]
    assert batching.build_batches(records, max_chars=1).count() == 6
    one = json.loads(got[0]["processors"][0])
    assert one["feature_evidence"]["scripts"]["inline_count"] == 0 and one["confidence"] == 0.2
    assert (batching.MAX_ITEMS, batching.MAX_CHARS) == (10, 60_000)


def test_scripts_and_tables_end_to_end(make_processors, make_connections):
    p = make_processors([
        ("t", "u", "Set", "org.x.UpdateAttribute", "Root", {"tbl": "sales.orders_log", "query_1": "INSERT INTO sales.orders SELECT * FROM stage.raw_data"}),
        ("t", "e", "Run", "org.x.ExecuteStreamCommand", "Root", {"Command Path": "/opt/run.sh", "Command Arguments": '-q "REFRESH ${tbl}" -e "${query_1}" token=abc'}),
        ("t", "q", "Read", "org.x.ExecuteSQL", "Root", {"SQL select query": "SELECT * FROM ${tbl}", "query_2": ""}),
        ("t", "f", "Get", "org.x.FetchFile", "Root", {"Script File": "/opt/lib/tool.py"}),
    ])
    c = make_connections([("t", "u", "e"), ("t", "e", "q")])
    items = scripts.script_items(p).collect()
    of = lambda pid, kind: [r for r in items if r["processor_id"] == pid and r["kind"] == kind]
    assert [r["path"] for r in of("e", "external")] == ["/opt/run.sh"] and not of("e", "inline")
    assert [r["content"] for r in of("q", "inline")] == ["(empty)"]
    assert [r["path"] for r in of("f", "external")] == ["/opt/lib/tool.py"] * 2  # the whole value and the path inside it
    refs = tables.table_refs(p, c).collect()
    named = lambda pid: {(r["table_name"], r["io_type"], r["origin_processor_id"]) for r in refs if r["processor_id"] == pid}
    assert named("q") == {("sales.orders_log", "read", None)}
    assert named("e") == {("stage.raw_data", "read", None), ("sales.orders", "write", None)} or named("e") >= {("sales.orders", "write", "u")}
    detail = scripts.details(scripts.script_items(p)).filter("processor_id = 'e'").first()
    assert detail["external_scripts"][0]["manual_review_note"] == V.REVIEW_NOTE
    rows = pipeline.records(p, c)
    payload = reports.payload_rows(rows, c, scripts.details(scripts.script_items(p))).filter("processor_id = 'e'").first()
    assert payload["scripts"]["external"][0]["path"] == "/opt/run.sh" and payload["lineage_summary"]["incoming_types"] == ["UpdateAttribute"]


def test_extract_text_settings_are_not_variables(make_processors):
    p = make_processors([("t", "x", "x", "org.x.ExtractText", "Root", {"Character Set": "UTF-8", "aggr_filename": "(.*)", "two words": "x", "${d}": "1"})])
    got = variables.definitions(p).collect()
    assert [(r["variable"], r["definition_type"]) for r in got] == [("aggr_filename", "static")]
    rows = p.select(features.defined_variables(F.col("type"), F.col("props")).alias("d")).first()["d"]
    assert [x["variable"] for x in rows] == ["aggr_filename"]


def test_snippet_store_defaults_upsert_and_reload(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.load(spark, path) is None
    schema = "processor_id string, template string, databricks_code string, confidence double"
    first = spark.createDataFrame([("a", "t", "x = 1", 0.5), ("b", "t", "  ", 0.5), ("", "t", "y", 0.1)], schema)
    store.upsert(spark, path, store.snippet_rows(first, "ep", 100, 1))
    again = spark.createDataFrame([("a", "t", "x = 2", 0.9), ("c", "t", "z", 0.2)], schema)
    store.upsert(spark, path, store.snippet_rows(again, "ep", 100, 2))
    got = {r["processor_id"]: (r["databricks_code"], r["batch_index"], r["code_language"]) for r in store.load(spark, path).collect()}
    assert got == {"a": ("x = 2", 2, "unknown"), "c": ("z", 2, "unknown")}
    twice = spark.createDataFrame([("a", "t", f"x = {i}", 0.9) for i in range(5)], schema).coalesce(1)
    assert store.upsert(spark, path, store.snippet_rows(twice, "ep", 100, 3)).filter("processor_id = 'a'").first()["databricks_code"] == "x = 4"
    spark.range(1).write.parquet(path + "/gen-99999999999999999999-lost")  # a generation whose pointer was never written
    assert store.load(spark, path).count() == 2


def test_legacy_ladder_on_commands(make_processors):
    cmd = lambda pid, args, **extra: ("t", pid, pid, "org.x.ExecuteStreamCommand", "Root", {"Command Arguments": args, **extra})
    p = make_processors([
        cmd("text", "grep x"), cmd("zip", "gzip a"), cmd("check", "echo a"), cmd("move", "/bin/mv a b"),
        cmd("dml", "impala-shell", query_1="INSERT INTO a"), cmd("meta", "impala-shell", query_1="REFRESH a"), cmd("none", "run"),
        ("t", "spark", "x", "com.acmesparkjob", "Root", {}), ("t", "gen", "x", "com.dategen", "Root", {}), ("t", "own", "x", "com.acme.Y", "Root", {}),
    ])
    site = legacy.SiteWords(spark_types=("acmesparkjob",), hql_types=("acmehql",))
    got = by_id(legacy.legacy_classify(p, site), "legacy_rule")
    assert {k: v[0] for k, v in got.items()} == {
        "text": "text_tools", "zip": "compression", "check": "validation", "move": "file_ops", "dml": "sql_dml", "meta": "sql_metadata",
        "none": None, "spark": "custom_spark", "gen": "custom_utility", "own": "custom_processing"}
    assert by_id(legacy.classify_distinct(p, site), "legacy_rule") == got


def test_filters(spark):
    df = spark.createDataFrame([("Alpha", None), ("beta", "X")], "name string, rule string")
    assert [r["name"] for r in filters.multi_filter(df, name_contains="ALP").collect()] == ["Alpha"]
    assert [r["name"] for r in filters.multi_filter(df, rule="(none)").collect()] == ["Alpha"]
    assert filters.multi_filter(df, rule="All").count() == 2
    assert [r["name"] for r in filters.text_search(df, "x").collect()] == ["beta"]


@pytest.mark.parametrize("raw, full, name, expected", [
    ("a.b.PutHDFS", None, "x", "PutHDFS"), ("Unknown", "a.ListFile", "x", "ListFile"), (None, None, "Steps - add configuration", "UpdateAttribute"),
    (None, "", "Move all files", "ExecuteStreamCommand"), (None, None, "My (new) thing - long name", "Custom_My_new_thing_lo"), (None, None, "", "Unknown"),
])
def test_robust_type(spark, raw, full, name, expected):
    df = spark.createDataFrame([(raw, full, name)], "r string, f string, n string")
    assert df.select(reports.robust_type(F.col("r"), F.col("f"), F.col("n"))).first()[0] == expected
