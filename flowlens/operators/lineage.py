"""Table lineage: atomic edges, links between processors, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.sqltext import not_a_table, sql_reads, sql_snippets, sql_writes
from flowlens.functions.text import has_any
from flowlens.operators import graph
from flowlens.session import cut, off_driver

KEY = ["template", "processor_id"]
NONE = "array<string>"


def _empty():
    return F.array().cast(NONE)


def upstream_values(processors: DataFrame, connections: DataFrame) -> DataFrame:
    """Values offered to a SQL-bearing processor by UpdateAttribute processors one hop upstream."""
    setters = processors.filter(F.lower("type").contains("updateattribute")).select(
        "template", F.col("processor_id").alias("src"), "props"
    )
    bearing = processors.filter(has_any(F.lower("type"), V.SQL_BEARING_TYPES)).select(
        "template", F.col("processor_id").alias("dst")
    )
    edges = graph.edges_of(connections, skip_unknown=True).join(bearing, ["template", "dst"], "left_semi")
    offers = (
        edges.join(setters, ["template", "src"])
        .select("template", "dst", "conn_ord", F.explode("props").alias("p"))
        .filter("p.value <> ''")
        .groupBy("template", "dst", F.col("p.name").alias("k"))
        .agg(
            F.max_by("p.value", F.struct("conn_ord", "p.ord")).alias("v"),
            F.min(F.struct("conn_ord", "p.ord")).alias("first_seen"),
        )
    )
    return offers.groupBy("template", F.col("dst").alias("processor_id")).agg(
        F.array_sort(F.collect_list(F.struct("first_seen", "k", "v"))).alias("offers")
    )


def _filled(sql, offers):
    once = lambda text: F.aggregate(
        offers, text, lambda t, o: F.replace(t, F.concat(F.lit("${"), o["k"], F.lit("}")), o["v"])
    )
    return F.when(sql.contains("${"), once(once(sql))).otherwise(sql)


def base_tables(refs: DataFrame) -> DataFrame:
    """Distinct (template, processor_id, io, table_name) of extracted references; unknown io counts as read."""
    return refs.select(
        *KEY, F.when(F.col("io_type") == "write", F.lit("write")).otherwise(F.lit("read")).alias("io"),
        F.lower(F.btrim("table_name", F.lit('`"[]'))).alias("table_name"),
    ).distinct()


def processor_tables(processors: DataFrame, connections: DataFrame, base: DataFrame, depth: str = "direct") -> DataFrame:
    """Reads and writes per processor before the schema filter: (template, processor_id, ..., reads, writes).
    SQL snippets win over base references where they yield anything.

    ``depth="direct"`` resolves variables one hop upstream; ``"transitive"`` uses resolved values
    from any distance.
    """
    listed = base.groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("io") == "read", F.col("table_name"))).alias("base_reads"),
        F.collect_list(F.when(F.col("io") == "write", F.col("table_name"))).alias("base_writes"),
    )
    rows = processors.select(*KEY, "proc_ord", "name", "type", "props").join(listed, KEY, "left")
    if depth == "direct":
        rows = rows.join(upstream_values(processors, connections), KEY, "left")
        none = F.array().cast("array<struct<first_seen:struct<conn_ord:bigint,ord:int>,k:string,v:string>>")
        fill = lambda s: _filled(s, F.coalesce("offers", none))
    else:
        from flowlens.functions.text import resolve_el
        from flowlens.operators.tables import variable_maps

        rows = rows.join(variable_maps(processors, connections), KEY, "left")
        fill = lambda s: resolve_el(s, F.coalesce("values", F.create_map().cast("map<string,string>")))
    bearing = has_any(F.lower("type"), V.SQL_BEARING_TYPES)
    rows = rows.withColumn(
        "snippets", F.when(bearing, sql_snippets(F.col("type"), F.col("props"))).otherwise(_empty())
    ).withColumn("snippets", F.transform("snippets", fill))
    found = lambda extract: F.array_distinct(F.flatten(F.transform("snippets", extract)))
    rows = rows.withColumn("sql_reads", found(sql_reads)).withColumn("sql_writes", found(sql_writes))
    pick = lambda sql, base_: F.when(F.size(sql) > 0, F.col(sql)).otherwise(F.coalesce(base_, _empty()))
    return rows.select(
        *KEY, "proc_ord", "name", "type",
        pick("sql_reads", "base_reads").alias("reads"), pick("sql_writes", "base_writes").alias("writes"),
    )


def schema_allowlist(base: DataFrame, minimum: int = 2) -> DataFrame:
    """(template, schema) hit by at least two distinct (processor, table) pairs."""
    hits = base.filter(F.col("table_name").contains(".")).select(*KEY, "table_name").distinct()
    return hits.groupBy("template", F.substring_index("table_name", ".", 1).alias("schema")).agg(
        F.count("*").alias("n")
    ).filter(F.col("n") >= minimum).select("template", "schema")


def allowed_tables(proc_tables: DataFrame, base: DataFrame, seed: tuple[str, ...] = ()) -> DataFrame:
    """Reads and writes as rows (template, processor_id, io, table_name) after the schema filter."""
    allow = schema_allowlist(base)
    rows = proc_tables.select(
        *KEY, "proc_ord", "name", "type",
        F.explode(
            F.concat(
                F.transform("reads", lambda t: F.struct(F.lit("read").alias("io"), t.alias("table_name"))),
                F.transform("writes", lambda t: F.struct(F.lit("write").alias("io"), t.alias("table_name"))),
            )
        ).alias("x"),
    ).select(*KEY, "proc_ord", "name", "type", "x.*")
    rows = rows.filter(F.col("table_name").contains(".") & ~not_a_table(F.col("table_name"))).withColumn(
        "schema", F.substring_index("table_name", ".", 1)
    )
    listed = allow.withColumn("listed", F.lit(True))
    return rows.join(listed, ["template", "schema"], "left").filter(
        F.col("listed") | F.col("schema").isin(*seed)
    ).drop("listed", "schema")


def table_sets(allowed: DataFrame) -> DataFrame:
    """Back to one row per processor with sorted read and write arrays."""
    pick = lambda io: F.array_sort(F.collect_set(F.when(F.col("io") == io, F.col("table_name"))))
    return allowed.groupBy(*KEY).agg(
        F.first("name").alias("name"), F.first("type").alias("type"),
        pick("read").alias("reads"), pick("write").alias("writes"),
    )


def lineage_sources(processors: DataFrame, connections: DataFrame, refs: DataFrame, depth: str = "direct") -> DataFrame:
    """Filtered (reads, writes) per processor; the input of all lineage edges.

    The slim references feed both the sets and the schema allowlist, so they are written once.
    """
    base = cut(base_tables(refs))
    return table_sets(allowed_tables(processor_tables(processors, connections, base, depth), base))


def _skipped():
    return has_any(F.lower("type"), V.LINEAGE_SKIP_TYPES)


def intra_edges(sets: DataFrame) -> DataFrame:
    """Per processor, each read into each different write (pairs stay inside one row)."""
    return (
        sets.filter(~_skipped() & (F.size("reads") > 0) & (F.size("writes") > 0))
        .select(*KEY, F.explode("reads").alias("src"), "writes")
        .select(*KEY, "src", F.explode("writes").alias("dst"))
        .filter("src <> dst")
        .select("template", "src", "dst", F.array("processor_id").alias("processor_ids"))
    )


def inter_edges(sets: DataFrame, connections: DataFrame) -> DataFrame:
    """Across one connection: upstream writes x, downstream reads x and writes something else."""
    live = sets.filter(~_skipped())
    ups = live.filter(F.size("writes") > 0).select(
        "template", F.col("processor_id").alias("src"), F.col("writes").alias("up_writes")
    )
    downs = live.filter(F.size("reads") > 0).select(
        "template", F.col("processor_id").alias("dst"), "reads", "writes"
    )
    edges = graph.edges_of(connections, skip_unknown=True).select("template", "src", "dst").distinct()
    return (
        edges.join(off_driver(ups), ["template", "src"])
        .join(off_driver(downs), ["template", "dst"])
        .select("template", "src", "dst", F.explode(F.array_intersect("up_writes", "reads")).alias("x"), "writes")
        .select("template", "src", "dst", "x", F.explode("writes").alias("w"))
        .filter("x <> w")
        .select("template", F.col("x").alias("src"), F.col("w").alias("dst"), F.array("src", "dst").alias("processor_ids"))
    )


def lineage_edges(sets: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """Atomic table edges; with ``connections`` also the inter-processor ones. Distinct."""
    edges = intra_edges(sets)
    if connections is not None:
        edges = edges.unionByName(inter_edges(sets, connections))
    return edges.dropDuplicates(["template", "src", "dst", "processor_ids"])


def schema_of(column: str):
    return F.substring_index(column, ".", 1)


def domain_only(edges: DataFrame) -> DataFrame:
    return edges.filter(
        ~schema_of("src").isin(*V.CONTROL_SCHEMAS) & ~schema_of("dst").isin(*V.CONTROL_SCHEMAS)
    )


def table_flow_links(sets: DataFrame, connections: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Writer -> reader of the same table, where the writer reaches the reader.

    Candidate pairs come from the reachability of writers, not from pairing all writers with all
    readers of a table.
    """
    sets = cut(sets.select(*KEY, "name", "reads", "writes"))
    writes = sets.select("template", F.col("processor_id").alias("src"), F.col("name").alias("writer_name"),
                         F.explode("writes").alias("table_name"))
    reads = sets.select("template", F.col("processor_id").alias("dst"), F.col("name").alias("reader_name"),
                        F.explode("reads").alias("table_name"))
    edges = graph.edges_of(connections, skip_unknown=True)
    pairs = graph.closure(edges, starts=writes.select("template", "src"), max_hops=max_hops)
    return (
        pairs.select("template", "src", "dst")
        .join(reads, ["template", "dst"])
        .join(writes, ["template", "src", "table_name"])
        .select("template", "table_name", F.col("src").alias("writer_id"), "writer_name",
                F.col("dst").alias("reader_id"), "reader_name")
    )


def chain_report(edges: DataFrame, processors: DataFrame) -> DataFrame:
    """Sink rows: joined ids and names, chain type, hop count (order is the sink's job)."""
    names = processors.select("template", F.col("processor_id").alias("pid"), F.col("name").alias("pname"))
    hops = edges.select(
        "template", "src", "dst", "processor_ids", F.posexplode("processor_ids").alias("i", "pid")
    ).join(names, ["template", "pid"], "left")
    return hops.groupBy("template", "src", "dst", "processor_ids").agg(
        F.array_sort(F.collect_list(F.struct("i", F.coalesce("pname", "pid").alias("n")))).alias("steps")
    ).select(
        "template", F.col("src").alias("source_table"), F.col("dst").alias("target_table"),
        F.array_join("processor_ids", " -> ").alias("processor_ids"),
        F.array_join(F.transform("steps", lambda s: s["n"]), " -> ").alias("processors"),
        F.when(F.size("processor_ids") > 1, F.lit("inter")).otherwise(F.lit("intra")).alias("chain_type"),
        F.size("processor_ids").alias("hop_count"),
    )


def metrics(sets: DataFrame) -> DataFrame:
    """Per template: processors with reads / writes, distinct tables read / written."""
    rows = sets.select("template", "processor_id", F.explode(F.concat(
        F.transform("reads", lambda t: F.struct(F.lit("r").alias("io"), t.alias("t"))),
        F.transform("writes", lambda t: F.struct(F.lit("w").alias("io"), t.alias("t"))),
    )).alias("x"))
    when = lambda io, c: F.count_distinct(F.when(F.col("x.io") == io, F.col(c)))
    return rows.groupBy("template").agg(
        when("r", "processor_id").alias("processors_with_reads"),
        when("w", "processor_id").alias("processors_with_writes"),
        when("r", "x.t").alias("tables_read"),
        when("w", "x.t").alias("tables_written"),
    )


def table_summary_rows(sets: DataFrame) -> DataFrame:
    return sets.filter((F.size("reads") > 0) | (F.size("writes") > 0)).select(
        *KEY, "name", F.array_join("reads", ", ").alias("reads"), F.array_join("writes", ", ").alias("writes")
    )


def critical_tables(sets: DataFrame, k: int | None = None) -> DataFrame:
    """Tables by connectivity: distinct readers plus writers across the corpus."""
    io = sets.select("template", "processor_id", F.explode(F.concat(
        F.transform("reads", lambda t: F.struct(t.alias("table_name"), F.lit(0).alias("w"))),
        F.transform("writes", lambda t: F.struct(t.alias("table_name"), F.lit(1).alias("w"))),
    )).alias("x")).select("x.*")
    ranked = io.groupBy("table_name").agg(
        F.count_if(F.col("w") == 0).alias("readers"), F.count_if(F.col("w") == 1).alias("writers"),
        F.count("*").alias("connections"),
    )
    return ranked if k is None else ranked.orderBy(F.desc("connections"), "table_name").limit(k)


def analysis(processors: DataFrame, connections: DataFrame, refs: DataFrame, inter: bool = True) -> dict[str, DataFrame]:
    """Everything the lineage report holds, as named DataFrames."""
    sets = lineage_sources(processors, connections, refs)
    edges = lineage_edges(sets, connections if inter else None)
    domain = domain_only(edges)
    return {
        "chains": edges,
        "domain_chains": domain,
        "chain_report": chain_report(edges, processors),
        "processor_tables": sets,
        "table_lineage_links": table_flow_links(sets, connections),
        "longest_paths": graph.longest_paths(edges),
        "longest_domain_paths": graph.longest_paths(domain),
        "metrics": metrics(sets),
    }
