"""Independent SQL for the registered queries, over the same driver tables (DuckDB dialect).

Shared steps are named common table expressions; ``sql_for`` puts the ones a query needs in front.
"""

from __future__ import annotations

import re

from flowlens import vocab as V
from flowlens.operators import chains, legacy
from flowlens.plans.views import STEPS, TYPE_BY_REMAINDER, TYPE_PREFIX

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def sql_for(query: str, recursive: bool = True) -> str:
    """``query`` preceded by every CTE it mentions, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name, body in CTES.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(body)
                order.append(name)

    need(query)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{query}" if order else query


def oracle(name: str, query: str) -> None:
    ORACLES[name] = query


# --- views ------------------------------------------------------------------------------------

CTES["pt"] = f"""
SELECT p_partkey AS k, p_partkey % {STEPS} AS n, p_size AS z, CAST(split_part(p_brand, '#', 2) AS INT) AS b,
  split_part(p_name, ' ', 1) AS color, lower(p_type) AS ty, p_name AS name,
  'flow_' || (p_partkey // {STEPS}) AS template, 'p' || p_partkey AS processor_id,
  [{', '.join(lit(t) for t in TYPE_BY_REMAINDER)}][(p_size % 8) + 1] AS kind
FROM part"""
CTES["fp"] = f"""
SELECT template, k AS proc_ord, processor_id, name, {lit(TYPE_PREFIX)} || kind AS type, kind, ty AS parent_group,
  'Root/' || ty AS group_path, CASE WHEN z % 9 = 0 THEN 'reviewed' ELSE '' END AS comments, z FROM pt"""
CTES["pr"] = """
SELECT * FROM (
  SELECT template, k AS proc_ord, processor_id, name, kind, 0 AS ord, 'SQL select query' AS pn,
    'INSERT INTO ' || ty || '.t_' || b || ' SELECT * FROM ' || ty || '.t_' || ((b + 1) % 25) || ' JOIN stage.' || color ||
    CASE WHEN z % 3 = 0 THEN ' JOIN ${tbl_' || (n % 4) || '} v' ELSE '' END || ' WHERE 1 = 1' AS pv FROM pt WHERE kind = 'ExecuteSQL'
  UNION ALL SELECT template, k, processor_id, name, kind, 0, 'SQL statement',
    'MERGE INTO ' || ty || '.t_' || b || ' USING stage.' || color || ' ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1' FROM pt WHERE kind = 'PutSQL'
  UNION ALL SELECT template, k, processor_id, name, kind, 1, 'JDBC Controller Service', 'svc_dbcp_' || (b % 5) FROM pt WHERE kind IN ('ExecuteSQL', 'PutSQL')
  UNION ALL SELECT template, k, processor_id, name, kind, 0, 'tbl_' || (n % 4),
    CASE WHEN z % 5 = 0 THEN '${tbl_' || ((n + 1) % 4) || '}' ELSE ty || '.t_' || b END FROM pt WHERE kind = 'UpdateAttribute'
  UNION ALL SELECT template, k, processor_id, name, kind, 1, 'query_' || (n % 4),
    'INSERT INTO ' || ty || '.t_' || b || ' SELECT * FROM stage.' || color FROM pt WHERE kind = 'UpdateAttribute'
  UNION ALL SELECT template, k, processor_id, name, kind, 0, 'Command Path', '/opt/jobs/' || color || '.sh' FROM pt WHERE kind = 'ExecuteStreamCommand'
  UNION ALL SELECT template, k, processor_id, name, kind, 1, 'Command Arguments',
    '-i impala-' || b || '.example.org:21000 -q "REFRESH ${tbl_1}" -e "${query_2}"' ||
    CASE WHEN k % 11 = 0 THEN ' password=passw0rd' || n ELSE '' END FROM pt WHERE kind = 'ExecuteStreamCommand'
  UNION ALL SELECT template, k, processor_id, name, kind, 0, 'big', '${tbl_2:isEmpty():not()}' FROM pt WHERE kind = 'RouteOnAttribute'
  UNION ALL SELECT template, k, processor_id, name, kind, 0, CASE kind WHEN 'ListFile' THEN 'Input Directory' ELSE 'Directory' END,
    '/user/hive/warehouse/' || ty || '.db/t_' || b || '/' FROM pt WHERE kind IN ('ListFile', 'PutHDFS')
  UNION ALL SELECT template, k, processor_id, name, kind, 0, 'Character Set', 'UTF-8' FROM pt WHERE kind = 'ExtractText'
  UNION ALL SELECT template, k, processor_id, name, kind, 1, 'var_' || (n % 4), '(.*)' FROM pt WHERE kind = 'ExtractText')"""
HOPS = """
SELECT template, k * 2 AS conn_ord, k AS fk, k + 1 AS tk, z FROM pt WHERE z % 7 <> 0 AND n + 1 < 32
  UNION ALL SELECT template, k * 2 + 1, k, k + 5, z FROM pt WHERE z % 3 = 0 AND n + 5 < 32"""
EDGE = """SELECT template, conn_ord, 'p' || fk AS src, 'p' || tk AS dst,
  CASE WHEN z % 2 = 0 THEN 'success' ELSE 'success,failure' END AS rels FROM ({hops}) WHERE tk IN (SELECT k FROM pt)"""
CTES["ce"] = EDGE.format(hops=HOPS)
CTES["cy"] = EDGE.format(
    hops=HOPS + " UNION ALL SELECT template, k * 2 + 1000000000, k, k - 3, z FROM pt WHERE k % 97 = 0 AND n >= 3")

# --- table references --------------------------------------------------------------------------

CTES["sq"] = r"""
SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?m)--.*?$', '', 'g'), '(?s)/\*.*?\*/', '', 'g'),
  '\s+', ' ', 'g'), '[`"'']([a-zA-Z_][a-zA-Z0-9_.]*)["`'']', '\1', 'g')) AS s
FROM {src} WHERE """ + has("lower(pn)", V.SQL_PROPERTY_WORDS)
LOOKAHEAD = r"(?!IF\s+NOT\s+EXISTS)"


def _hits(source: str) -> str:
    parts = []
    for i, (clause, conf, pattern) in enumerate(V.SQL_CLAUSES + V.SQL_CLAUSES_EXTRA):
        guard = r" WHERE NOT regexp_matches(t, '(?i)^IF$')" if LOOKAHEAD in pattern else ""
        plain = pattern.replace(LOOKAHEAD, "")
        parts.append(
            f"SELECT * FROM (SELECT *, unnest(regexp_extract_all(s, {lit('(?i)' + plain)}, 1)) AS t, {lit(clause)} AS clause, {num(conf)} AS conf FROM {source}){guard}"
        )
    return "\nUNION ALL ".join(parts)


def score(name: str, ptype: str, prop: str, conf: str | None) -> str:
    low = f"lower({name})"
    shapes = " OR ".join(f"regexp_matches({low}, {lit(p)})" for p in V.NAME_SHAPES)
    pt = lambda cond, value: f"(CASE WHEN {cond} THEN {num(value)} ELSE 0::DOUBLE END)"
    shape = (f"least({pt(shapes, .3)} + (CASE WHEN length({name}) BETWEEN 3 AND 30 THEN {num(.2)} WHEN length({name}) > 30 THEN {num(-.1)} ELSE 0::DOUBLE END)"
             f" + {pt(f'regexp_matches({name}, ' + lit('^[^.]{2,}[.][^.]{2,}$') + ')', .3)}, 1)")
    naming = (f"least({pt(has(low, V.TABLE_WORDS), .4)} + {pt(has(low, V.DOMAIN_WORDS), .3)} + {pt(f'contains({name}, ' + lit('_') + ')', .2)}"
              f" + {pt(f'{name} = {low} AND regexp_matches({name}, ' + lit('[a-z]') + ')', .1)}, 1)")
    context = f"{pt(has(ptype, V.DATA_PROCESSOR_WORDS), .5)} + {pt(has(prop, V.SCORED_PROPERTY_WORDS), .4)}"
    if conf:
        context += f" + {conf} * {num(.3)}"
    context += f" - {pt(f'contains({ptype}, ' + lit('generateflowfile') + ')', .8)}"
    if conf:
        context += f" - {pt(f'NOT contains({prop}, ' + lit('sql') + f') AND NOT contains({prop}, ' + lit('query') + ')', .1)}"
    part = "[a-zA-Z_0-9][a-zA-Z0-9_]*"
    database = (f"least({pt(f'regexp_matches({name}, ' + lit('^[^:]*:[^:]*$') + ')', .8)} + "
                f"{pt(f'regexp_matches({name}, ' + lit('^' + part + '([.]' + part + '){1,2}$') + ')', .6)} + "
                f"{pt(f'ends_with({name}, ' + lit('s') + f') AND length({name}) > 4', .2)}, 1)")
    return (f"(CASE WHEN length({name}) >= 2 AND regexp_matches({name}, '^[a-zA-Z_0-9][a-zA-Z0-9_.]*$') THEN least("
            f"{shape} * {num(.4)} + {naming} * {num(.3)} + greatest({context}, 0::DOUBLE) * {num(.2)} + {database} * {num(.1)}, 1) ELSE 0::DOUBLE END)")


def _refs(source: str) -> str:
    """W1 references of a property relation with columns pr.* and v (the possibly resolved value)."""
    sq = CTES["sq"].replace("{src}", source)
    return f"""
SELECT template, proc_ord, processor_id, name, lower(kind) AS ptype, ord, pn, t AS table_name, src_rank,
  ['property', 'sql', 'path'][src_rank + 1] AS source, sql_clause, io, conf FROM (
  SELECT *, row_number() OVER (PARTITION BY template, processor_id, t, io ORDER BY ord, src_rank) AS rn FROM (
    SELECT template, proc_ord, processor_id, name, kind, ord, pn, t, 1 AS src_rank,
      string_agg(DISTINCT clause, '/' ORDER BY clause) AS sql_clause,
      CASE WHEN bool_or(clause IN {names(V.WRITE_CLAUSES)}) THEN 'write' ELSE 'read' END AS io, max(conf) AS conf
    FROM ({_hits(f'({sq})')}) WHERE {score('t', 'lower(kind)', 'lower(pn)', 'conf')} >= {num(V.SCORE_THRESHOLD)}
    GROUP BY ALL
    UNION ALL
    SELECT template, proc_ord, processor_id, name, kind, ord, pn,
      replace(regexp_extract(v, '/(?:user/)?hive/warehouse/([^/]+\\.db)/([^/]+)', 1), '.db', '') || '.' ||
      regexp_extract(v, '/(?:user/)?hive/warehouse/([^/]+\\.db)/([^/]+)', 2), 2, NULL,
      CASE WHEN {has('lower(pn)', V.TARGET_PROPERTY_WORDS)} THEN 'write' ELSE 'unknown' END, NULL
    FROM {source} WHERE regexp_matches(v, '/(?:user/)?hive/warehouse/([^/]+\\.db)/([^/]+)')
    UNION ALL
    SELECT template, proc_ord, processor_id, name, kind, ord, pn, v, 0, NULL, 'unknown', NULL
    FROM {source} WHERE {has('lower(pn)', V.TABLE_PROPERTY_WORDS)} AND {score('v', 'lower(kind)', 'lower(pn)', None)} >= {num(V.SCORE_THRESHOLD)}
  )) WHERE rn = 1"""


CTES["pv0"] = "SELECT *, pv AS v FROM pr"
CTES["ref0"] = f"SELECT * FROM ({_refs('pv0')}) WHERE lower(table_name) NOT IN {names(V.NOT_TABLES)}"
oracle("sql_table_refs", """
SELECT template, processor_id, ptype AS processor_type, pn AS property_name, table_name, source,
  coalesce(sql_clause, '') AS sql_clause, io AS io_type, coalesce(conf, 0) AS confidence FROM ref0""")
oracle("table_name_scores", f"""
SELECT id, name, round({score('name', lit('executesql'), lit('table name'), None)}, 9) AS score FROM (
  SELECT p_partkey AS id, replace(p_name, ' ', ['_', '.', '', '_fact_', ' '][(p_partkey % 5) + 1]) ||
    CASE WHEN p_size % 4 = 0 THEN '_log' ELSE '' END AS name FROM part)""")

# --- variables ---------------------------------------------------------------------------------

CTES["df"] = f"""
SELECT *, CASE WHEN contains(pv, '${{') THEN 'dynamic' ELSE 'static' END AS dt FROM pr
WHERE kind IN ('UpdateAttribute', 'ExtractText') AND pv <> ''
  AND NOT (kind = 'ExtractText' AND (pn IN {names(V.EXTRACT_TEXT_SETTINGS)} OR regexp_matches(pn, '\\s')))"""
CTES["us"] = r"""
SELECT *, trim(split_part(body, ':', 1)) AS variable FROM (SELECT *, unnest(regexp_extract_all(pv, '\$\{([^}]+)\}', 1)) AS body FROM pr)"""
oracle("variable_defs", "SELECT template, processor_id, pn AS variable, pv AS property_value, dt AS definition_type FROM df")
oracle("variable_usages", """
SELECT template, processor_id, variable, pn AS property_name, '${' || body || '}' AS variable_expression, contains(body, ':') AS has_functions FROM us""")
CTES["vs"] = """
SELECT template, variable, coalesce(d.n, 0) AS definition_count, coalesce(u.n, 0) AS usage_count,
  (SELECT count(DISTINCT processor_id) FROM (SELECT template, pn AS variable, processor_id FROM df UNION ALL SELECT template, variable, processor_id FROM us) x
   WHERE x.template = template_ AND x.variable = variable_) AS processor_count FROM (
  SELECT coalesce(d.template, u.template) AS template, coalesce(d.variable, u.variable) AS variable, coalesce(d.template, u.template) AS template_,
    coalesce(d.variable, u.variable) AS variable_, d, u
  FROM (SELECT template, pn AS variable, count(*) AS n FROM df GROUP BY ALL) d
  FULL JOIN (SELECT template, variable, count(*) AS n FROM us GROUP BY ALL) u ON d.template = u.template AND d.variable = u.variable)"""
oracle("variable_summary", "SELECT *, definition_count > 0 AS is_defined, definition_count = 0 AS is_external FROM vs")
oracle("variable_totals", """
SELECT template, count(*) AS total_variables, count(*) FILTER (definition_count > 0) AS defined_variables,
  count(*) FILTER (definition_count = 0) AS external_variables FROM vs GROUP BY template""")
CTES["lv"] = "SELECT template, processor_id, pn AS variable, pv AS value FROM df WHERE dt = 'static'"
CTES["rv"] = """
SELECT template, variable, processor_id FROM lv
UNION SELECT r.template, r.variable, e.dst FROM rv r JOIN ce e ON e.template = r.template AND e.src = r.processor_id"""
CTES["vp"] = """
SELECT r.template, r.variable, r.processor_id, arg_max(e.src, e.conn_ord) AS src
FROM rv r ANTI JOIN lv USING (template, variable, processor_id)
JOIN ce e ON e.template = r.template AND e.dst = r.processor_id
JOIN rv s ON s.template = r.template AND s.variable = r.variable AND s.processor_id = e.src GROUP BY ALL"""
CTES["vr"] = """
SELECT template, variable, processor_id, value, processor_id AS origin_processor_id FROM lv
UNION ALL SELECT p.template, p.variable, p.processor_id, v.value, v.origin_processor_id FROM vr v
JOIN vp p ON p.template = v.template AND p.variable = v.variable AND p.src = v.processor_id"""
oracle("variable_resolution", "SELECT * FROM vr")
CTES["pv1"] = r"""
SELECT pr.*, coalesce(x.v, pr.pv) AS v FROM pr LEFT JOIN (
  SELECT q.template, q.processor_id, q.ord, string_agg(q.piece || coalesce(vr.value, CASE WHEN q.body IS NULL THEN '' ELSE '${' || q.body || '}' END), '' ORDER BY q.i) AS v
  FROM (SELECT *, unnest(string_split_regex(pv, '\$\{[^}]+\}')) AS piece,
          unnest(list_concat(regexp_extract_all(pv, '\$\{([^}]+)\}', 1), [NULL])) AS body,
          generate_subscripts(string_split_regex(pv, '\$\{[^}]+\}'), 1) AS i FROM pr WHERE contains(pv, '${')) q
  LEFT JOIN vr ON vr.template = q.template AND vr.processor_id = q.processor_id AND vr.variable = split_part(q.body, ':', 1)
  GROUP BY ALL) x ON x.template = pr.template AND x.processor_id = pr.processor_id AND x.ord = pr.ord"""
oracle("resolved_properties", "SELECT template, processor_id, pn AS prop_name, v AS prop_value FROM pv1")
CTES["ref1"] = _refs("pv1")
CTES["inh"] = f"""
SELECT u.template, u.proc_ord, u.processor_id, u.name, u.ptype, u.ord, u.pn, s.table_name, 1 AS src_rank, 'sql' AS source, s.sql_clause, s.io, s.conf, s.origin, u.variable
FROM (SELECT template, variable, processor_id, arg_min(proc_ord, ord) AS proc_ord, arg_min(name, ord) AS name, arg_min(lower(kind), ord) AS ptype, min(ord) AS ord, arg_min(pn, ord) AS pn
      FROM us WHERE lower(kind) IN {names(V.INHERITING_TYPES)} GROUP BY ALL) u
JOIN (SELECT r.template, d.pn AS variable, r.table_name, r.io, arg_min(r.sql_clause, r.proc_ord * 1000 + r.ord * 10) AS sql_clause, arg_min(r.conf, r.proc_ord * 1000 + r.ord * 10) AS conf,
        arg_min(r.processor_id, r.proc_ord * 1000 + r.ord * 10) AS origin
      FROM ref1 r JOIN df d ON d.template = r.template AND d.processor_id = r.processor_id WHERE r.source = 'sql' GROUP BY ALL) s
  ON s.template = u.template AND s.variable = u.variable
WHERE NOT EXISTS (SELECT 1 FROM ref1 k WHERE k.template = u.template AND k.processor_id = u.processor_id AND k.table_name = s.table_name AND k.io = s.io)
QUALIFY row_number() OVER (PARTITION BY u.template, u.processor_id, s.table_name, s.io ORDER BY u.variable, s.origin) = 1"""
CTES["ref2"] = f"""
SELECT * FROM (SELECT template, proc_ord, processor_id, name, ptype, ord, pn, table_name, src_rank, source, io, '' AS origin FROM ref1
UNION ALL SELECT template, proc_ord, processor_id, name, ptype, ord, pn, table_name, src_rank, source, io, origin FROM inh)
WHERE lower(table_name) NOT IN {names(V.NOT_TABLES)}"""
oracle("resolved_table_refs", """
SELECT template, processor_id, ptype AS processor_type, pn AS property_name, table_name, source, io AS io_type, origin AS origin_processor_id FROM ref2""")
CTES["inv"] = """
SELECT * FROM ref2 QUALIFY row_number() OVER (PARTITION BY template, lower(table_name), ptype ORDER BY origin <> '', proc_ord, ord, src_rank, table_name) = 1"""
oracle("table_inventory", "SELECT template, ptype AS processor_type, table_name, processor_id, pn AS property_name FROM inv")
oracle("corpus_summary", """
SELECT (SELECT count(DISTINCT template) FROM pt) AS templates, count(DISTINCT template) AS templates_with_tables, count(*) AS total_refs,
  count(DISTINCT table_name) AS distinct_tables, count(DISTINCT (template, processor_id)) AS distinct_processors FROM ref2""")
oracle("top_tables", "SELECT table_name AS value, count(*) AS n FROM ref2 GROUP BY ALL ORDER BY n DESC, value LIMIT 10")
oracle("table_summary_topk", """
SELECT 'total_tables' AS section, '' AS value, count(*) AS n FROM ref2
UNION ALL SELECT * FROM (SELECT 'top_processors', ptype, count(*) AS n FROM ref2 GROUP BY ALL ORDER BY n DESC, ptype LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'property_types', pn, count(*) AS n FROM ref2 GROUP BY ALL ORDER BY n DESC, pn LIMIT 5)""")

# --- lineage -----------------------------------------------------------------------------------

NOT_TABLE = (
    "(t = '' OR (contains(t, '.') AND (split_part(t, '.', 1) IN " + names(V.ALIAS_LETTERS) + " OR split_part(t, '.', -1) IN "
    + names(V.FILE_LIKE_LAST_PARTS) + ")) OR " + has("t", V.FILE_LIKE_TOKENS) + " OR t IN " + names(V.CAPTURED_KEYWORDS)
    + " OR " + has("t", ["${", "}", "--", "/*"]) + " OR contains(t, chr(10)) OR length(t) > 100)"
)
CTES["offer"] = """
SELECT template, dst AS processor_id, list({'k': k, 'v': v} ORDER BY conn_ord, ord) AS offers FROM (
  SELECT e.template, e.dst, p.pn AS k, arg_max(p.pv, e.conn_ord * 100 + p.ord) AS v, min(e.conn_ord) AS conn_ord, arg_min(p.ord, e.conn_ord * 100 + p.ord) AS ord
  FROM ce e JOIN pr p ON p.template = e.template AND p.processor_id = e.src AND p.kind = 'UpdateAttribute' GROUP BY ALL) GROUP BY ALL"""
FILL = "list_reduce(coalesce(offers, []), lambda a, o: {'k': '', 'v': replace(a.v, '${' || o.k || '}', o.v)}, {'k': '', 'v': %s}).v"
CTES["snip"] = f"""
SELECT template, processor_id, {FILL % (FILL % 'c')} AS c FROM (
  SELECT template, processor_id, pv AS c FROM pr WHERE pn IN ('SQL select query', 'SQL statement')
  UNION ALL SELECT template, processor_id, unnest(regexp_extract_all(pv, '"([^"]+)"', 1)) FROM pr WHERE pn = 'Command Arguments')
LEFT JOIN offer USING (template, processor_id)"""


def _found(patterns, io: str) -> str:
    return " UNION ".join(
        f"SELECT template, processor_id, {lit(io)} AS io, unnest(regexp_extract_all(c, {lit('(?i)' + p)}, 1)) AS t FROM snip WHERE length(c) >= 5" for p in patterns)


CTES["rw"] = f"""
SELECT DISTINCT template, processor_id, io, t FROM (SELECT template, processor_id, io, lower(trim(t, '`"[]')) AS t FROM (
{_found(V.READ_PATTERNS, 'read')} UNION {_found(V.WRITE_PATTERNS, 'write')})) WHERE NOT {NOT_TABLE}"""
CTES["bs"] = "SELECT DISTINCT template, processor_id, CASE io WHEN 'write' THEN 'write' ELSE 'read' END AS io, lower(trim(table_name, '`\"[]')) AS t FROM ref0"
CTES["al"] = f"""
SELECT * FROM (SELECT * FROM rw UNION ALL SELECT * FROM bs b WHERE NOT EXISTS (
  SELECT 1 FROM rw WHERE rw.template = b.template AND rw.processor_id = b.processor_id AND rw.io = b.io)) x
WHERE contains(t, '.') AND NOT {NOT_TABLE} AND ((template, split_part(t, '.', 1)) IN (
  SELECT (template, s) FROM (SELECT template, split_part(t, '.', 1) AS s FROM (SELECT DISTINCT template, processor_id, t FROM bs WHERE contains(t, '.')) GROUP BY ALL HAVING count(*) >= 2)))"""
CTES["le"] = """
SELECT r.template, r.t AS src, w.t AS dst, r.processor_id FROM al r JOIN al w ON r.template = w.template AND r.processor_id = w.processor_id
JOIN fp ON fp.processor_id = r.processor_id WHERE r.io = 'read' AND w.io = 'write' AND r.t <> w.t AND fp.kind NOT IN ('UpdateAttribute', 'RouteOnAttribute')"""
CTES["ie"] = """
SELECT DISTINCT e.template, u.t AS src, w.t AS dst, e.src AS a, e.dst AS b FROM ce e
JOIN al u ON u.template = e.template AND u.processor_id = e.src AND u.io = 'write'
JOIN al r ON r.template = e.template AND r.processor_id = e.dst AND r.io = 'read' AND r.t = u.t
JOIN al w ON w.template = e.template AND w.processor_id = e.dst AND w.io = 'write' AND w.t <> u.t
JOIN fp pa ON pa.processor_id = e.src JOIN fp pb ON pb.processor_id = e.dst
WHERE pa.kind NOT IN ('UpdateAttribute', 'RouteOnAttribute') AND pb.kind NOT IN ('UpdateAttribute', 'RouteOnAttribute')"""
CTES["ae"] = "SELECT template, src, dst, [processor_id] AS ids FROM le UNION ALL SELECT template, src, dst, [a, b] FROM ie"
oracle("table_lineage_edges", "SELECT template, src, dst, processor_id FROM le")
oracle("processor_tables", """
SELECT template, processor_id, coalesce(string_agg(t, ',' ORDER BY t) FILTER (io = 'read'), '') AS reads,
  coalesce(string_agg(t, ',' ORDER BY t) FILTER (io = 'write'), '') AS writes FROM al GROUP BY ALL""")
oracle("inter_processor_edges", "SELECT template, src, dst, a || ' -> ' || b AS processor_ids FROM ie")
oracle("domain_edges", f"""
SELECT template, src, dst, array_to_string(ids, ',') AS processor_ids FROM ae
WHERE split_part(src, '.', 1) NOT IN {names(V.CONTROL_SCHEMAS)} AND split_part(dst, '.', 1) NOT IN {names(V.CONTROL_SCHEMAS)}""")
oracle("lineage_chain_report", """
SELECT ae.template, src AS source_table, dst AS target_table, array_to_string(ids, ' -> ') AS processor_ids,
  CASE WHEN len(ids) = 1 THEN a.name ELSE a.name || ' -> ' || b.name END AS processors,
  CASE WHEN len(ids) = 1 THEN 'intra' ELSE 'inter' END AS chain_type, len(ids) AS hop_count
FROM ae JOIN fp a ON a.processor_id = ids[1] LEFT JOIN fp b ON b.processor_id = ids[2]""")
CTES["cl"] = """
SELECT template, src, dst, 1 AS hops FROM ce
UNION SELECT c.template, c.src, e.dst, c.hops + 1 FROM cl c JOIN ce e ON e.template = c.template AND e.src = c.dst"""
oracle("downstream_closure", "SELECT template, src, dst, min(hops) AS hops FROM cl GROUP BY ALL")
oracle("table_flow_links", """
SELECT DISTINCT c.template, w.t AS table_name, c.src AS writer_id, pw.name AS writer_name, c.dst AS reader_id, pr_.name AS reader_name
FROM (SELECT DISTINCT template, src, dst FROM cl) c JOIN al w ON w.template = c.template AND w.processor_id = c.src AND w.io = 'write'
JOIN al r ON r.template = c.template AND r.processor_id = c.dst AND r.io = 'read' AND r.t = w.t
JOIN fp pw ON pw.processor_id = c.src JOIN fp pr_ ON pr_.processor_id = c.dst""")
oracle("lineage_metrics", """
SELECT template, count(DISTINCT processor_id) FILTER (io = 'read') AS processors_with_reads, count(DISTINCT processor_id) FILTER (io = 'write') AS processors_with_writes,
  count(DISTINCT t) FILTER (io = 'read') AS tables_read, count(DISTINCT t) FILTER (io = 'write') AS tables_written FROM al GROUP BY template""")
CTES["ct"] = """
SELECT t AS table_name, count(*) FILTER (io = 'read') AS readers, count(*) FILTER (io = 'write') AS writers, count(*) AS connections FROM al GROUP BY t"""
oracle("critical_tables", "SELECT * FROM ct")
oracle("critical_tables_topk", "SELECT * FROM ct ORDER BY connections DESC, table_name LIMIT 20")
CTES["ge"] = "SELECT DISTINCT template, src, dst FROM ae WHERE src <> dst"
CTES["gp"] = """
SELECT template, dst AS last, [src, dst] AS path FROM ge
UNION ALL SELECT g.template, e.dst, list_append(g.path, e.dst) FROM gp g JOIN ge e ON e.template = g.template AND e.src = g.last AND NOT list_contains(g.path, e.dst)"""
oracle("longest_table_paths", """
SELECT template, rank, array_to_string(path, '>') AS path, len(path) AS nodes, len(path) - 1 AS hops FROM (
  SELECT *, row_number() OVER (PARTITION BY template ORDER BY path) AS rank FROM gp
  WHERE (template, len(path)) IN (SELECT (template, max(len(path))) FROM gp GROUP BY template))""")

# --- graph -------------------------------------------------------------------------------------

oracle("adjacency", """
SELECT template, processor_id, coalesce((SELECT string_agg(src, ',' ORDER BY conn_ord) FROM ce WHERE ce.dst = fp.processor_id), '') AS incoming,
  coalesce((SELECT string_agg(dst, ',' ORDER BY conn_ord) FROM ce WHERE ce.src = fp.processor_id), '') AS outgoing FROM fp""")
CTES["cyc"] = """
SELECT template, src, dst FROM cy UNION SELECT c.template, c.src, e.dst FROM cyc c JOIN cy e ON e.template = c.template AND e.src = c.dst"""
oracle("cycle_pairs", """
SELECT a.template, a.src AS node_a, a.dst AS node_b FROM cyc a JOIN cyc b ON a.template = b.template AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""")
CTES["cyg"] = """
SELECT template, src, dst FROM ge UNION SELECT c.template, c.src, e.dst FROM cyg c JOIN ge e ON e.template = c.template AND e.src = c.dst"""
for _name, _pairs in (("connection_cycles", "cyc"), ("table_cycles", "cyg")):
    oracle(_name, f"""
SELECT template, component, count(*) AS size, string_agg(node, '>' ORDER BY node) AS members FROM (
  SELECT a.template, a.src AS node, min(a.dst) AS component FROM {_pairs} a JOIN {_pairs} b ON a.template = b.template AND a.src = b.dst AND a.dst = b.src
  GROUP BY a.template, a.src HAVING count(DISTINCT a.dst) > 1) GROUP BY template, component""")
oracle("flattened_edges", """
SELECT template, src, dst, rels AS relationships, CASE WHEN conn_ord % 3 = 0 THEN 'port_' || conn_ord ELSE '' END AS via_port FROM ce""")
CTES["gr"] = """
SELECT n_name AS id, n_name AS name, 'r' || n_regionkey AS up FROM nation
UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region
UNION ALL SELECT 's' || s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN n_name ELSE 's' || (s_suppkey // 3) END FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
CTES["gw"] = """
SELECT id, name AS path FROM gr WHERE up IS NULL OR up NOT IN (SELECT id FROM gr)
UNION ALL SELECT gr.id, gw.path || '/' || gr.name FROM gw JOIN gr ON gr.up = gw.id"""
oracle("group_paths", "SELECT 'world' AS template, id AS group_id, path FROM gw")

CTES["sp"] = """
SELECT d.template, d.processor_id AS start, d.processor_id AS last, [d.processor_id] AS path, []::VARCHAR[] AS rels FROM (SELECT DISTINCT template, processor_id FROM df) d
UNION ALL SELECT s.template, s.start, e.dst, list_append(s.path, e.dst), list_append(s.rels, e.rels) FROM sp s JOIN ce e ON e.template = s.template AND e.src = s.last
WHERE NOT list_contains(s.path, e.dst)"""
CTES["vf"] = """
SELECT s.template, d.pn AS variable, s.start, s.last, s.path, s.rels FROM sp s JOIN df d ON d.template = s.template AND d.processor_id = s.start
JOIN (SELECT DISTINCT template, variable, processor_id FROM us) u ON u.template = s.template AND u.variable = d.pn AND u.processor_id = s.last"""
oracle("variable_flow_paths", "SELECT template, variable, start, last, array_to_string(path, '>') AS flow_chain, len(path) AS chain_length FROM vf")
oracle("variable_flow_hops", """
SELECT template, variable, path[i] AS from_processor, path[i + 1] AS to_processor, count(*) AS n, min(i) AS first_hop, any_value(rels[i]) AS relationships
FROM (SELECT *, unnest(range(1, len(path))) AS i FROM vf) GROUP BY ALL""")

# --- scripts and text --------------------------------------------------------------------------


def redacted(column: str) -> str:
    for pattern, replacement in V.SECRET_PATTERNS:
        column = f"regexp_replace({column}, {lit(pattern)}, {lit(replacement.replace('{1}', chr(92) + '1'))}, 'gi')"
    return column


def language(column: str) -> tuple[str, str]:
    sums = [(lang, " + ".join(f"regexp_matches({column}, {lit('(?im)' + p)})::INT" for p in ps)) for lang, ps in V.LANGUAGE_SIGNATURES]
    best = "greatest(" + ", ".join(f"({s})" for _, s in sums) + ")"
    pick = " ".join(f"WHEN ({s}) = ({best}) THEN {lit(lang)}" for lang, s in sums)
    return f"CASE WHEN {best} = 0 THEN 'unknown' {pick} END", f"CASE WHEN {best} = 0 THEN 0.3::DOUBLE ELSE least(0.95::DOUBLE, {best} * 0.15::DOUBLE + 0.25::DOUBLE) END"


LANG, LANG_CONF = language("text")
oracle("document_languages", f"SELECT doc_id, {LANG} AS lang, round({LANG_CONF}, 6) AS confidence FROM documents")
oracle("redact_secrets", f"SELECT doc_id, md5({redacted('text')}) AS digest, {redacted('text')} <> text AS changed FROM documents")
oracle("url_hosts", f"""
SELECT DISTINCT page_id, host FROM (SELECT page_id, lower(unnest(regexp_extract_all(url || ' ' || html, {lit(V.URL_HOST)}, 1))) AS host FROM pages
UNION ALL SELECT page_id, host FROM (SELECT page_id, lower(unnest(regexp_extract_all(url || ' ' || html, {lit(V.DOMAIN_HOST)}, 1))) AS host FROM pages) WHERE NOT {has('host', V.SKIPPED_HOSTS)})""")
oracle("impala_hosts", r"SELECT template, processor_id, regexp_extract(pv, '-i (\S+)', 1) AS host FROM pr WHERE pn = 'Command Arguments'")
oracle("base64_text", r"""
SELECT doc_id, md5(t) AS digest FROM (SELECT doc_id, decode(from_base64(v)) AS t FROM (
  SELECT doc_id, CASE WHEN regexp_full_match(trim(v), '[A-Za-z0-9+/]+={0,2}') AND length(trim(v)) >= 32 AND length(trim(v)) % 4 = 0 THEN trim(v) END AS v FROM (
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE to_base64(encode(text)) END AS v FROM documents)))
WHERE length(regexp_replace(t, '\P{L}', '', 'g')) > 10 AND regexp_matches(t, '[ \n]')""")
PROP_LANG, _ = language("pv")
CTES["sc"] = f"""
SELECT template, processor_id, 'external' AS kind, 'Command Path' AS property_name, pv AS path, 'shell_script' AS script_type, '' AS content, -1 AS line_count FROM pr WHERE pn = 'Command Path'
UNION ALL SELECT template, processor_id, 'inline', pn, '', CASE WHEN regexp_matches(pn, '^query_[0-9]+') THEN 'sql' ELSE {PROP_LANG} END, {redacted('pv')}, 1 FROM pr
WHERE regexp_matches(pn, '^query_[0-9]+') OR (length(regexp_replace(pv, '\\$\\{{[^}}]+\\}}', 'ELVAR', 'g')) >= 40 AND pn IN ('SQL select query', 'SQL statement'))"""
oracle("script_refs", "SELECT * FROM sc")
oracle("script_summary", """
SELECT count(*) FILTER (kind = 'external') AS external_scripts, count(*) FILTER (kind = 'inline') AS inline_scripts, count(DISTINCT (template, processor_id)) AS processors,
  count(DISTINCT script_type) AS script_types FROM sc""")
oracle("script_types", "SELECT kind, script_type, count(*) AS n FROM sc GROUP BY ALL")
oracle("query_links", """
SELECT r.template, r.processor_id, r.pn AS prop_name, 'query_2' AS query, (SELECT arg_max(q.processor_id, q.proc_ord) FROM pr q JOIN fp f ON f.processor_id = q.processor_id
  WHERE q.template = r.template AND q.pn = 'query_2' AND f.parent_group = g.parent_group) AS provider_id
FROM pr r JOIN fp g ON g.processor_id = r.processor_id WHERE r.pn = 'Command Arguments' AND provider_id IS NOT NULL""")
oracle("inline_script_candidates", """
SELECT template, processor_id, pn AS prop_name, 'sql' AS script_type, length(pv) AS content_length, 1 AS line_count FROM pr
WHERE pn IN ('SQL select query', 'SQL statement') OR regexp_matches(pn, '^query_[0-9]')""")
oracle("text_search", "SELECT template, processor_id, name FROM fp WHERE contains(lower(template), 'gear') OR contains(lower(name), 'gear') OR contains(lower(type), 'gear')")
oracle("filtered_processors", "SELECT template, processor_id, name FROM fp WHERE contains(lower(name), 'ring') AND kind = 'PutSQL'")

# --- features and classification ---------------------------------------------------------------

CTES["ft"] = f"""
SELECT fp.*, coalesce(b.blob, '') AS blob, coalesce(b.services, '') AS services, coalesce(i.n, 0) AS inline_count, coalesce(x.n, 0) AS external_count,
  coalesce(t.tables, '') AS tables, coalesce(t.n, 0) AS table_count, coalesce(t.pn, 0) AS table_props, coalesce(d.n, 0) AS defines, coalesce(u.n, 0) AS uses,
  (SELECT count(*) FROM ce WHERE ce.dst = fp.processor_id) AS incoming, (SELECT count(*) FROM ce WHERE ce.src = fp.processor_id) AS outgoing,
  regexp_matches(coalesce(b.blob, ''), {lit('(?i)' + V.DML)}) AS has_dml, contains(lower(b.blob), 'select') OR contains(lower(b.blob), 'insert') AS has_sql,
  regexp_matches(coalesce(b.blob, ''), {lit('(?i)' + V.METADATA_SQL)}) AND NOT regexp_matches(coalesce(b.blob, ''), {lit('(?i)' + V.DML)}) AS has_meta,
  contains(coalesce(b.blob, ''), '${{') AS uses_variables
FROM fp LEFT JOIN (SELECT processor_id, string_agg(pv, chr(10) ORDER BY ord) AS blob, string_agg(pv, ',' ORDER BY ord) FILTER (contains(lower(pn), 'controller service')) AS services FROM pr GROUP BY ALL) b USING (processor_id)
LEFT JOIN (SELECT processor_id, count(*) AS n FROM sc WHERE kind = 'inline' GROUP BY ALL) i USING (processor_id)
LEFT JOIN (SELECT processor_id, count(*) AS n FROM sc WHERE kind = 'external' GROUP BY ALL) x USING (processor_id)
LEFT JOIN (SELECT processor_id, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables, count(DISTINCT table_name) AS n, count(DISTINCT pn) AS pn FROM inv GROUP BY ALL) t USING (processor_id)
LEFT JOIN (SELECT processor_id, count(*) AS n FROM df GROUP BY ALL) d USING (processor_id)
LEFT JOIN (SELECT processor_id, count(*) AS n FROM us GROUP BY ALL) u USING (processor_id)"""
oracle("processor_features", """
SELECT template, processor_id, kind AS short_type, services AS controller_services, inline_count, external_count, has_sql, has_dml, has_meta AS has_metadata_only,
  tables, defines, uses, incoming, outgoing, uses_variables, comments <> '' AS has_comments FROM ft""")
CONDITION = {"sql.has_dml": "has_dml", "sql.has_metadata_only": "has_meta", "scripts.inline_count": "inline_count > 0", "scripts.external_count": "external_count > 0"}
BRANCHES = [
    (" AND ".join(([f"kind IN {names(r['processor_short_types'])}"] if "processor_short_types" in r else [])
                  + [CONDITION[c["field"]] for c in r.get("conditions", [])]) or "true", r)
    for r in V.DEFAULT_RULES
]


def case(field: str) -> str:
    value = lambda r: num(r[field]) if field == "confidence" else lit(r[field])
    return "CASE " + " ".join(f"WHEN {cond} THEN {value(r)}" for cond, r in BRANCHES) + " END"


CTES["rc"] = f"""
SELECT *, {case('migration_category')} AS category, {case('databricks_target')} AS target, {case('confidence')} AS confidence, {case('name')} AS rule FROM ft"""
OUT = "template, processor_id, category AS migration_category, target AS databricks_target, confidence, 'rule' AS classification_source, rule"
oracle("rule_classification", f"SELECT {OUT} FROM rc")
oracle("override_classification", """
SELECT template, processor_id, CASE WHEN z % 10 = 0 THEN 'Business Logic' ELSE category END AS migration_category, target AS databricks_target,
  CASE WHEN z % 20 = 0 THEN 1.0::DOUBLE WHEN z % 10 = 0 THEN greatest(confidence, 0.95::DOUBLE) ELSE confidence END AS confidence,
  CASE WHEN z % 10 = 0 THEN 'override' ELSE 'rule' END AS classification_source, rule FROM rc""")
CTES["setter"] = f"""
SELECT r.template, r.processor_id, r.proc_ord, r.category, d.pn AS variable FROM rc r JOIN df d USING (template, processor_id) WHERE r.category IN {names(V.PROMOTABLE_CATEGORIES)}"""
CTES["reader"] = "SELECT DISTINCT r.template, r.processor_id, r.proc_ord, r.name, r.category, u.variable FROM rc r JOIN us u USING (template, processor_id)"
CTES["p1"] = f"""
SELECT DISTINCT s.template, s.processor_id FROM setter s JOIN reader r ON r.template = s.template AND r.variable = s.variable AND r.category IN {names(V.CONSUMER_CATEGORIES)}"""
oracle("promotion", f"""
SELECT template, rc.processor_id, CASE WHEN p1.processor_id IS NULL THEN category ELSE 'Business Logic' END AS migration_category,
  CASE WHEN p1.processor_id IS NULL THEN target ELSE {lit(V.PROMOTION_TARGET)} END AS databricks_target,
  CASE WHEN p1.processor_id IS NULL THEN confidence ELSE greatest(confidence, 0.6::DOUBLE) END AS confidence,
  CASE WHEN p1.processor_id IS NULL THEN 'rule' ELSE 'promotion' END AS classification_source, rule FROM rc LEFT JOIN p1 USING (template, processor_id)""")
CTES["pc"] = """
SELECT template, processor_id FROM p1
UNION SELECT s.template, s.processor_id FROM pc JOIN reader r ON r.template = pc.template AND r.processor_id = pc.processor_id
  JOIN setter s ON s.template = r.template AND s.variable = r.variable AND r.proc_ord < s.proc_ord"""
CTES["why"] = f"""
SELECT s.template, s.processor_id, any_value(s.category) AS was, string_agg(DISTINCT s.variable, ', ' ORDER BY s.variable) AS vars, string_agg(DISTINCT r.name, ', ' ORDER BY r.name) AS who
FROM setter s JOIN pc USING (template, processor_id) JOIN reader r ON r.template = s.template AND r.variable = s.variable AND (r.category IN {names(V.CONSUMER_CATEGORIES)}
  OR (r.proc_ord < s.proc_ord AND (r.template, r.processor_id) IN (SELECT (template, processor_id) FROM pc))) GROUP BY ALL"""
CTES["fin"] = """
SELECT rc.*, why.processor_id IS NOT NULL AS up, CASE WHEN why.processor_id IS NULL THEN category ELSE 'Business Logic' END AS final_category,
  coalesce('Promoted from ' || was || ' after detecting variables ' || vars || ' consumed by downstream processors ' || who || '.', '') AS reason
FROM rc LEFT JOIN why USING (template, processor_id)"""
oracle("promotion_cascade", """
SELECT template, processor_id, final_category AS migration_category, CASE WHEN up THEN 'promotion' ELSE 'rule' END AS classification_source, reason AS promotion_reason FROM fin""")
oracle("category_counts", "SELECT template, final_category AS migration_category, count(*) AS n FROM fin GROUP BY ALL")
oracle("flat_classification", f"""
SELECT template, template AS template_path, processor_id, name AS processor_name, type AS processor_type, kind AS short_type, parent_group, group_path AS parent_group_path,
  final_category AS migration_category, CASE WHEN up THEN {lit(V.PROMOTION_TARGET)} ELSE target END AS databricks_target,
  CASE WHEN up THEN greatest(confidence, 0.6::DOUBLE) ELSE confidence END AS confidence, CASE WHEN up THEN 'promotion' ELSE 'rule' END AS classification_source, rule,
  has_dml AS sql_has_dml, has_meta AS sql_has_metadata_only, inline_count AS scripts_inline_count, external_count AS scripts_external_count, uses_variables,
  incoming AS incoming_count, outgoing AS outgoing_count FROM fin""")
oracle("group_profiles", """
SELECT g.*, coalesce(vd.s, '') AS variables_defined, coalesce(vu.s, '') AS variables_used, coalesce(cs.s, '') AS controller_services, coalesce(ig.s, '') AS incoming_groups, coalesce(og.s, '') AS outgoing_groups
FROM (SELECT template, group_path, count(*) AS processor_count,
    (SELECT max((n, c))[2] FROM (SELECT category AS c, count(*) AS n FROM rc q WHERE q.template = rc.template AND q.group_path = rc.group_path GROUP BY ALL)) AS dominant_category,
    count(*) FILTER (category <> 'Infrastructure Only') AS needs_migration_count, count(*) FILTER (confidence < 0.5) AS ambiguous_count,
    CAST(sum(inline_count) AS BIGINT) AS inline_script_total, CAST(sum(external_count) AS BIGINT) AS external_script_total, count(*) FILTER (external_count > 0) AS external_processors FROM rc GROUP BY template, group_path) g
LEFT JOIN (SELECT f.template, f.group_path, string_agg(DISTINCT d.pn, ',' ORDER BY d.pn) AS s FROM df d JOIN fp f USING (processor_id) GROUP BY ALL) vd USING (template, group_path)
LEFT JOIN (SELECT f.template, f.group_path, string_agg(DISTINCT u.variable, ',' ORDER BY u.variable) AS s FROM us u JOIN fp f USING (processor_id) GROUP BY ALL) vu USING (template, group_path)
LEFT JOIN (SELECT f.template, f.group_path, string_agg(DISTINCT p.pv, ',' ORDER BY p.pv) AS s FROM pr p JOIN fp f USING (processor_id) WHERE p.pn = 'JDBC Controller Service' GROUP BY ALL) cs USING (template, group_path)
LEFT JOIN (SELECT b.template, b.group_path, string_agg(DISTINCT a.group_path, ',' ORDER BY a.group_path) AS s FROM ce JOIN fp a ON a.processor_id = ce.src JOIN fp b ON b.processor_id = ce.dst WHERE a.group_path <> b.group_path GROUP BY ALL) ig USING (template, group_path)
LEFT JOIN (SELECT a.template, a.group_path, string_agg(DISTINCT b.group_path, ',' ORDER BY b.group_path) AS s FROM ce JOIN fp a ON a.processor_id = ce.src JOIN fp b ON b.processor_id = ce.dst WHERE a.group_path <> b.group_path GROUP BY ALL) og USING (template, group_path)""")


def _flags(column: str, groups: dict) -> str:
    return ", ".join(f"{has(f'lower({column})', ks)}::INT AS {n}" for n, ks in groups.items())


NEAR = ", ".join(
    f"EXISTS (SELECT 1 FROM ce JOIN fp q ON q.processor_id = ce.{a} WHERE ce.{b} = rc.processor_id AND q.kind = {lit(t)})::INT AS {side}_has_{t.lower()}"
    for side, a, b in (("incoming", "src", "dst"), ("outgoing", "dst", "src")) for t in V.NEIGHBOR_TYPES
)
oracle("feature_matrix", f"""
SELECT template, processor_id, kind AS short_type, parent_group, category AS migration_category, confidence, 'rule' AS classification_source, 0 AS promotion_applied,
  uses_variables::INT AS uses_expression_language, uses_variables::INT AS uses_variables, has_sql::INT AS sql_has_sql, has_dml::INT AS sql_has_dml, has_meta::INT AS sql_has_metadata_only,
  inline_count AS scripts_inline_count, external_count AS scripts_external_count, (inline_count > 0)::INT AS scripts_has_inline, (external_count > 0)::INT AS scripts_has_external,
  0 AS scripts_external_hosts_count, table_count, table_props AS table_property_reference_count, defines AS variables_define_count, uses AS variables_use_count,
  CASE WHEN services = '' THEN 0 ELSE 1 END AS controller_service_count, incoming AS incoming_count, outgoing AS outgoing_count, (incoming > 1)::INT AS is_fanin,
  (outgoing > 1)::INT AS is_fanout, (outgoing = 0)::INT AS is_terminal, {_flags("services || ' ' || blob", V.CONTROLLER_KEYWORDS)}, {_flags('name', V.NAME_KEYWORDS)}, {_flags('parent_group', V.GROUP_KEYWORDS)}, {NEAR} FROM rc""")
oracle("rule_suggestions", f"""
SELECT 'Auto: ' || split_part(type, '.', -1) AS name, type AS processor_type,
  CASE WHEN dml > 0.2 THEN 'Business Logic' WHEN ext > 0.5 THEN 'Source Adapter' WHEN inl = 0 AND dml = 0 AND ext = 0 THEN 'Sink Adapter' WHEN var > 0.5 THEN 'Orchestration / Monitoring' ELSE 'Infrastructure Only' END AS migration_category,
  CASE WHEN dml > 0.2 THEN 'SQL transformation' WHEN ext > 0.5 THEN 'External script' WHEN inl = 0 AND dml = 0 AND ext = 0 THEN 'Delta write' WHEN var > 0.5 THEN 'Workflow control' ELSE 'Workflow plumbing' END AS databricks_target,
  printf('Derived from %d processor(s); avg sql_has_dml=%.2f; avg sql_has_metadata_only=%.2f; avg inline_scripts=%.2f; avg external_scripts=%.2f; avg uses_variables=%.2f', n, dml, meta, inl, ext, var) AS notes
FROM (SELECT type, count(*) AS n, avg(has_dml::INT) AS dml, avg(has_meta::INT) AS meta, avg(inline_count) AS inl, avg(external_count) AS ext, avg(uses_variables::INT) AS var FROM rc WHERE kind NOT IN ('LogMessage', 'PutHDFS') GROUP BY type)""")

# --- legacy labels, pruning, chains ------------------------------------------------------------

PHRASES = ["", "wait for ", "log error ", "dummy ", "refresh table ", "manual trigger ", "route on error ", "kerberos ", "clear content ", "custom_copy ", "split loaders "]
LADDER = [
    ("kind IN ('ListFile', 'PutHDFS')", "file_io"), ("kind = 'UpdateAttribute'", "set_attributes"),
    ("starts_with(label, 'custom_') AND contains(label, 'copy')", "custom_mv_cp"), ("kind = 'ExtractText'", "text_parsing"),
    ("kind = 'RouteOnAttribute'", "routing"), ("contains(label, 'log ')", "logging"), (has("label", legacy.WAIT_NAMES), "timing"),
    (has("label", legacy.CONTROL_NAMES), "flow_control"), ("kind = 'ExecuteSQL' OR " + has("label", legacy.SQL_NAMES), "sql_execution"),
    (has("label", legacy.SPLIT_NAMES), "content_split"), (has("label", legacy.CLEAR_NAMES), "attribute_management"),
    (has("label", legacy.TRIGGER_NAMES), "file_triggers"), (has("label", legacy.SCHEDULE_NAMES), "scheduling"), ("contains(label, 'kerberos')", "authentication"),
]
CTES["lg"] = f"""
SELECT *, CASE {' '.join(f'WHEN {c} THEN {lit(k)}' for c, k in LADDER)} END AS rk FROM (
  SELECT *, [{', '.join(lit(p) for p in PHRASES)}][(proc_ord % 11) + 1] || name AS label FROM fp)"""
CTES["lo"] = "SELECT * FROM (VALUES " + ", ".join(f"({lit(k)}, {lit(o[0])}, {lit(o[1])}, {lit(o[2])})" for k, o in legacy.OUTCOMES.items()) + ") v(rk, lab, impact, op)"
CTES["lc"] = "SELECT lg.*, coalesce(lab, 'unknown') AS lab, coalesce(impact, 'unknown') AS impact, coalesce(op, '') AS op FROM lg LEFT JOIN lo USING (rk)"
oracle("legacy_classification", "SELECT template, processor_id, label AS name, lab AS data_manipulation_type, impact AS data_impact_level, op AS key_operation FROM lc")
oracle("legacy_final_overrides", """
SELECT CASE WHEN kind IN ('ListFile', 'PutHDFS') THEN 'data_movement' WHEN kind = 'UpdateAttribute' THEN 'infrastructure_only' ELSE lab END AS data_manipulation_type,
  CASE WHEN kind IN ('ListFile', 'PutHDFS') THEN 'low' WHEN kind = 'UpdateAttribute' THEN 'none' ELSE impact END AS data_impact_level, count(*) AS n FROM lc GROUP BY ALL""")
oracle("legacy_label_counts", f"""
SELECT x AS label, count(lab) AS n FROM (SELECT unnest([{', '.join(lit(x) for x in chains.LEGACY_LABELS)}]) AS x) LEFT JOIN lc ON lab = x GROUP BY x""")
oracle("legacy_prune_summary", f"""
SELECT count(*) AS original_count, count(*) FILTER (lab IN {names(chains.LEGACY_KEPT)}) AS kept_count, count(*) FILTER (lab NOT IN {names(chains.LEGACY_KEPT)}) AS pruned_count,
  count(*) FILTER (lab = 'unknown') AS unknown_count, round(100.0::DOUBLE * count(*) FILTER (lab NOT IN {names(chains.LEGACY_KEPT)}) / count(*), 1) AS reduction_percentage FROM lc""")
oracle("unknown_processors", """
SELECT lc.template, lc.processor_id AS id, string_agg(pn || '=' || pv, '|' ORDER BY ord) AS property_preview
FROM lc JOIN pr USING (processor_id) WHERE lab = 'unknown' GROUP BY ALL""")
oracle("prune_summary", f"""
SELECT template, count(*) FILTER (category IN {names(V.ESSENTIAL_CATEGORIES)}) AS essential_count, count(*) FILTER (category = {lit(V.ORCHESTRATION)}) AS support_count,
  count(*) FILTER (category = {lit(V.INFRASTRUCTURE)}) AS infrastructure_count, count(*) FILTER (category = 'Ambiguous') AS ambiguous_count FROM rc GROUP BY template""")
CTES["kept"] = f"SELECT * FROM rc WHERE category IN {names(V.ESSENTIAL_CATEGORIES)}"


def chain_ctes(tag: str, nodes: str) -> None:
    """Nodes with degrees, link walk from every start, and membership, following the stated rules."""
    CTES[f"e{tag}"] = f"SELECT ce.* FROM ce WHERE src IN (SELECT processor_id FROM {nodes}) AND dst IN (SELECT processor_id FROM {nodes})"
    CTES[f"d{tag}"] = f"""
SELECT template, processor_id, proc_ord, kind, (SELECT count(*) FROM e{tag} e WHERE e.src = n.processor_id) AS outs, (SELECT count(*) FROM e{tag} e WHERE e.dst = n.processor_id) AS ins FROM {nodes} n"""
    CTES[f"w{tag}"] = f"""
SELECT template, processor_id AS root, proc_ord AS root_ord, processor_id, proc_ord, outs, 0 AS position FROM d{tag} WHERE ins = 0 OR outs > 1
UNION ALL SELECT w.template, w.root, w.root_ord, d.processor_id, d.proc_ord, d.outs, w.position + 1 FROM w{tag} w JOIN e{tag} e ON e.src = w.processor_id AND w.outs = 1
JOIN d{tag} d ON d.processor_id = e.dst AND d.ins = 1"""
    CTES[f"c{tag}"] = f"""
SELECT template, root AS chain_root, position, processor_id FROM w{tag} w
WHERE NOT (position > 0 AND outs > 1 AND proc_ord < root_ord)
  AND NOT (position = 0 AND outs > 1 AND EXISTS (SELECT 1 FROM w{tag} o WHERE o.processor_id = w.processor_id AND o.position > 0 AND o.proc_ord > o.root_ord))"""


chain_ctes("ka", "fp")
chain_ctes("kb", "kept")
oracle("linear_chains", "SELECT template, chain_root, position, processor_id FROM cka")
oracle("essential_chains", "SELECT template, chain_root, position, processor_id FROM ckb")
CTES["ch"] = """
SELECT c.template, chain_root, arg_min(kind, position) AS source_type, arg_max(c.processor_id, position) AS sink_id, arg_max(kind, position) AS sink_type, count(*) AS length
FROM cka c JOIN fp USING (processor_id) GROUP BY ALL"""
oracle("chain_patterns", """
SELECT *, CASE source_type WHEN 'ListFile' THEN CASE WHEN length > 1 AND sink_type = 'PutHDFS' THEN 'file_ingestion' WHEN length > 1 AND sink_type = 'PutSQL' THEN 'file_to_database' ELSE 'file_processing' END
  WHEN 'ExecuteSQL' THEN CASE WHEN length > 1 AND sink_type = 'PutSQL' THEN 'database_transformation' WHEN length > 1 AND sink_type = 'PutHDFS' THEN 'database_export' ELSE 'database_processing' END
  ELSE 'data_transformation' END AS business_pattern FROM ch""")
oracle("chain_summary", """
SELECT count(*) AS total_chains, round(sum(length)::DOUBLE / count(*), 1) AS avg_chain_length, CAST(sum(length) AS BIGINT) AS processors_in_chains,
  CAST((SELECT count(*) FROM fp) - sum(length) AS BIGINT) AS isolated_processors FROM ch""")

# --- reports, batches, store, DDL, patterns ----------------------------------------------------

oracle("key_details", """
SELECT template, processor_id, CASE pn WHEN 'Input Directory' THEN 'Directory' WHEN 'Directory' THEN 'Output Directory' WHEN 'Command Path' THEN 'Command Path' ELSE 'Arguments' END AS label, pv AS value
FROM pr WHERE pn IN ('Input Directory', 'Directory', 'Command Path', 'Command Arguments')
UNION ALL SELECT template, processor_id, 'Full Command', string_agg(pv, ' ' ORDER BY ord) FROM pr WHERE kind = 'ExecuteStreamCommand' GROUP BY ALL
UNION ALL SELECT template, processor_id, 'Purpose', 'Custom script execution' FROM fp WHERE kind = 'ExecuteStreamCommand'""")
CTES["need"] = r"""
SELECT DISTINCT template, unnest(regexp_extract_all(pv, '\$\{([^}]+)\}', 1)) AS ph FROM pr WHERE processor_id IN (SELECT processor_id FROM kept)"""
oracle("placeholder_dependencies", f"""
SELECT p.template, p.processor_id, CASE WHEN rc.category IN {names(V.ESSENTIAL_CATEGORIES)} THEN 'essential' WHEN rc.category = {lit(V.ORCHESTRATION)} THEN 'support' ELSE 'infrastructure' END AS bucket,
  'Defines variables: ' || string_agg(p.pn, ', ' ORDER BY p.ord) AS dependency_reason,
  CASE WHEN rc.kind = 'RouteOnAttribute' THEN 'routing_logic' ELSE 'data_extraction' END AS dependency_category,
  (SELECT count(*) FROM pr q WHERE q.processor_id = p.processor_id AND contains(q.pn, 'query_')) AS sql_query_count
FROM pr p JOIN need ON need.template = p.template AND need.ph = p.pn JOIN rc ON rc.processor_id = p.processor_id GROUP BY ALL""")
oracle("neighbor_records", """
SELECT template, processor_id, coalesce((SELECT string_agg(q.processor_id || ':' || q.kind, ',' ORDER BY conn_ord) FROM ce JOIN fp q ON q.processor_id = ce.src WHERE ce.dst = fp.processor_id), '') AS upstream_processors,
  coalesce((SELECT string_agg(q.processor_id || ':' || q.kind, ',' ORDER BY conn_ord) FROM ce JOIN fp q ON q.processor_id = ce.dst WHERE ce.src = fp.processor_id), '') AS downstream_processors FROM fp""")
oracle("payload_rows", """
SELECT template, processor_id, coalesce((SELECT string_agg(DISTINCT q.kind, ',' ORDER BY q.kind) FROM ce JOIN fp q ON q.processor_id = ce.src WHERE ce.dst = fp.processor_id), '') AS incoming_types,
  coalesce((SELECT string_agg(DISTINCT q.kind, ',' ORDER BY q.kind) FROM ce JOIN fp q ON q.processor_id = ce.dst WHERE ce.src = fp.processor_id), '') AS outgoing_types,
  coalesce((SELECT string_agg(DISTINCT pn, ',' ORDER BY pn) FROM df WHERE df.processor_id = fp.processor_id), '') AS defines,
  coalesce((SELECT string_agg(DISTINCT variable, ',' ORDER BY variable) FROM us WHERE us.processor_id = fp.processor_id), '') AS uses FROM fp""")


def fold(scope: str, budget: int) -> str:
    fresh = f"o.scope <> f.scope OR f.members + 1 > 10 OR f.chars + o.n_chars > {budget}"
    return f"""
SELECT i, scope, doc_id, n_chars, 1::BIGINT AS batch_index, 1 AS members, n_chars AS chars FROM od{scope} WHERE i = 1
UNION ALL SELECT o.i, o.scope, o.doc_id, o.n_chars, CASE WHEN o.scope <> f.scope THEN 1 WHEN {fresh} THEN f.batch_index + 1 ELSE f.batch_index END,
  CASE WHEN {fresh} THEN 1 ELSE f.members + 1 END, CASE WHEN {fresh} THEN o.n_chars ELSE f.chars + o.n_chars END FROM fo{scope} f JOIN od{scope} o ON o.i = f.i + 1"""


CTES["oda"] = "SELECT row_number() OVER (ORDER BY source, doc_id) AS i, source AS scope, doc_id, n_chars FROM documents"
CTES["odb"] = "SELECT row_number() OVER (ORDER BY source, doc_id) AS i, '' AS scope, doc_id, n_chars FROM documents"
CTES["foa"] = fold("a", 20_000)
CTES["fob"] = fold("b", 60_000)
oracle("batch_packing", """
SELECT scope AS source, batch_index, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM foa GROUP BY ALL""")
oracle("batch_packing_corpus", "SELECT batch_index, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS chars FROM fob GROUP BY ALL")
oracle("record_batches", """
SELECT template, batch_index, count(*) AS processor_count, string_agg(processor_id, ',' ORDER BY i) AS processor_ids FROM (
  SELECT *, (i - 1) // 5 + 1 AS batch_index FROM (SELECT template, processor_id, row_number() OVER (PARTITION BY template ORDER BY group_path, processor_id) AS i FROM fp)) GROUP BY ALL""")
oracle("keyed_upsert", """
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
oracle("ingest_generations", """
WITH e AS (SELECT coalesce(source, '') || '/' || coalesce(lang, 'und') AS path, md5(CAST(n_chars % 2 AS VARCHAR)) AS checksum, doc_id AS batch_id, n_chars % 7 = 0 AS removed FROM documents WHERE n_chars IS NOT NULL),
steps AS (SELECT *, lag(checksum) OVER w IS DISTINCT FROM checksum OR lag(removed) OVER w IS DISTINCT FROM removed AS starts FROM e WINDOW w AS (PARTITION BY path ORDER BY batch_id)),
runs AS (SELECT *, max(CASE WHEN starts THEN batch_id END) OVER (PARTITION BY path ORDER BY batch_id) AS generation FROM steps)
SELECT path, checksum, batch_id, generation FROM runs QUALIFY row_number() OVER (PARTITION BY path ORDER BY batch_id DESC) = 1 AND NOT removed""")
DDL_COLS = """
SELECT k, ty, z, unnest([
  {'ord': 0, 'c': 'id', 'y': 'BIGINT', 'p': false}, {'ord': 1, 'c': 'load_ts', 'y': 'STRING', 'p': false}, {'ord': 2, 'c': 'amount', 'y': 'DECIMAL(10,2)', 'p': false},
  {'ord': 3, 'c': color, 'y': CASE WHEN z % 3 = 0 THEN 'STRUCT<a:INT,b:STRING>' ELSE 'MAP<STRING,INT>' END, 'p': false},
  {'ord': 4, 'c': 'day_ts', 'y': 'STRING', 'p': true}, {'ord': 5, 'c': 'region', 'y': 'STRING', 'p': true}]) AS x FROM pt"""
CTES["dc"] = f"SELECT k, ty, z, x.ord AS ord, x.c AS c, x.y AS y, x.p AS p FROM ({DDL_COLS}) WHERE NOT (x.p AND z % 5 = 0)"
oracle("ddl_columns", """
SELECT 'ddl_' || k || '.sql' AS file, ty AS schema, 't_' || k AS "table", ord, c AS "column", CASE WHEN p THEN y WHEN c = 'load_ts' THEN 'TIMESTAMP' ELSE upper(y) END AS type, p AS is_partition FROM dc""")
oracle("ddl_statements", """
SELECT 'ddl_' || k || '.sql' AS file, 'main.' || ty || '.t_' || k AS full_name, step, md5(CASE step WHEN 0 THEN 'CREATE SCHEMA IF NOT EXISTS main.' || ty
  WHEN 1 THEN 'CREATE TABLE IF NOT EXISTS main.' || ty || '.t_' || k || ' (' || chr(10) || cols || chr(10) || ')' || chr(10) || 'USING parquet' || CASE WHEN keys IS NULL THEN '' ELSE chr(10) || 'PARTITIONED BY (' || keys || ')' END
  ELSE 'DESCRIBE EXTENDED main.' || ty || '.t_' || k END) AS digest
FROM (SELECT k, ty, string_agg('  ' || c || ' ' || y, ',' || chr(10) ORDER BY ord) AS cols, string_agg(c, ', ' ORDER BY ord) FILTER (p) AS keys FROM dc GROUP BY ALL), (SELECT unnest([0, 1, 2]) AS step)""")
oracle("route_counts", """
SELECT CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' AND value > 20 THEN 'paid' WHEN value > 50 THEN 'large' ELSE 'unmatched' END AS route,
  count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
oracle("funnel", """
SELECT 'event' AS origin, count(*) AS n, count(value) AS "values", 0 AS statuses FROM events UNION ALL SELECT 'order', count(*), 0, count(o_orderstatus) FROM orders""")
oracle("dataset_diff", """
SELECT CASE WHEN l.k IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra' WHEN o.o_orderstatus IS NOT DISTINCT FROM l.s THEN 'same' ELSE 'changed' END AS status, count(*) AS n
FROM orders o FULL JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY ALL) l ON l.k = o.o_orderkey GROUP BY ALL""")
oracle("asset_inventory", """
SELECT template, kind, count(*) AS n FROM (
  SELECT DISTINCT template, 'hdfs_path' AS kind, pv AS asset FROM pr WHERE starts_with(pv, '/user/')
  UNION SELECT template, 'table', table_name FROM ref2 UNION SELECT template, 'script', path FROM sc WHERE kind = 'external'
  UNION SELECT template, 'host', v FROM (SELECT template, unnest(regexp_extract_all(pv, '\\b((?:[a-zA-Z0-9-]+\\.){1,}[a-zA-Z]{2,})\\b', 1)) AS v FROM pr
    WHERE NOT contains(pv, '*') AND NOT (contains(pv, '${') AND NOT starts_with(pv, '/'))) WHERE NOT contains(v, 'example.com')) GROUP BY ALL""".replace("\\\\", "\\"))
oracle("template_shred", """
SELECT fp.template, fp.processor_id, fp.name, fp.type, upper(parent_group[1]) || parent_group[2:] AS parent_group, pn AS prop_name, pv AS prop_value FROM pr JOIN fp USING (processor_id)""")
oracle("shredded_connections", "SELECT template, src AS source, dst AS destination, rels AS relationships FROM ce")


# Queries over the view with few table names, where neighbouring processors share tables.
SHARED_TABLES = ("inter_processor_edges", "table_flow_links", "lineage_chain_report", "domain_edges", "longest_table_paths", "table_cycles")


def oracle_sql() -> dict[str, str]:
    sql = {name: sql_for(text) for name, text in ORACLES.items()}
    for name in SHARED_TABLES:
        sql[name] = sql[name].replace("AS INT) AS b,", "AS INT) % 5 AS b,")
    return sql
