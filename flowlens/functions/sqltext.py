"""Table references inside SQL text: regex shredding with per-name aggregation in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions import scoring
from flowlens.functions.text import has_any, prop, strip


def clean_sql(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?md)--.*?$", "")
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"""[`"']([a-zA-Z_][a-zA-Z0-9_.]*)["`']""", "$1")
    return F.trim(c)


def clause_hits(cleaned: Column, compat: bool = False) -> Column:
    """Every (name, clause, confidence) hit of the clause patterns, in pattern order."""
    patterns = V.SQL_CLAUSES if compat else V.SQL_CLAUSES + V.SQL_CLAUSES_EXTRA

    def tagged(clause: str, confidence: float):
        return lambda t: F.struct(
            t.alias("name"), F.lit(clause).alias("clause"), F.lit(confidence).alias("confidence")
        )

    return F.flatten(
        F.array(
            *[
                F.transform(
                    F.regexp_extract_all(cleaned, F.lit("(?i)" + pattern), F.lit(1)),
                    tagged(clause, confidence),
                )
                for clause, confidence, pattern in patterns
            ]
        )
    )


def accepted(hits: Column, ptype: Column, prop_lower: Column) -> Column:
    """The hits whose name scores as a table."""
    return F.filter(
        hits,
        lambda h: scoring.table_score(h["name"], ptype, prop_lower, h["confidence"]) >= V.SCORE_THRESHOLD,
    )


def folded_refs(good: Column) -> Column:
    """Accepted hits folded per name: clauses joined, io by clause, best confidence.

    ``good`` should be a stored column, since it is read several times.
    """
    names = F.array_distinct(F.transform(good, lambda h: h["name"]))

    def fold(name: Column) -> Column:
        own = F.filter(good, lambda h: h["name"] == name)
        clauses = F.array_sort(F.array_distinct(F.transform(own, lambda h: h["clause"])))
        writes = F.arrays_overlap(clauses, F.array(*[F.lit(c) for c in V.WRITE_CLAUSES]))
        return F.struct(
            name.alias("table_name"),
            F.lit("sql").alias("source"),
            F.array_join(clauses, "/").alias("sql_clause"),
            F.when(writes, F.lit("write")).otherwise(F.lit("read")).alias("io_type"),
            F.array_max(F.transform(own, lambda h: h["confidence"])).alias("confidence"),
        )

    return F.transform(names, fold)


def not_a_table(name: Column) -> Column:
    """Lineage false positives: aliases, files, keywords, leftovers of expressions."""
    n = F.lower(name)
    dotted = n.contains(".")
    first, last = F.substring_index(n, ".", 1), F.substring_index(n, ".", -1)
    slashes = F.length(n) - F.length(F.replace(n, F.lit("/"), F.lit("")))
    return (
        n.isNull()
        | (n == "")
        | (dotted & first.isin(*V.ALIAS_LETTERS))
        | (dotted & last.isin(*V.FILE_LIKE_LAST_PARTS))
        | has_any(n, V.FILE_LIKE_TOKENS)
        | n.isin(*V.CAPTURED_KEYWORDS)
        | has_any(n, ["${", "}", "\n", "\r", "--", "/*"])
        | (F.length(n) > 100)
        | (slashes > 2)
    )


def _tables(sql: Column, patterns: list[str]) -> Column:
    found = F.flatten(
        F.array(*[F.regexp_extract_all(sql, F.lit("(?i)" + p), F.lit(1)) for p in patterns])
    )
    cleaned = F.transform(found, lambda t: F.lower(F.btrim(t, F.lit('`"[]'))))
    usable = F.filter(cleaned, lambda t: ~not_a_table(t))
    return F.when(F.length(sql) >= 5, F.array_distinct(usable)).otherwise(F.array().cast("array<string>"))


def sql_reads(sql: Column) -> Column:
    return _tables(sql, V.READ_PATTERNS)


def sql_writes(sql: Column) -> Column:
    return _tables(sql, V.WRITE_PATTERNS)


def sql_snippets(ptype: Column, props: Column) -> Column:
    """SQL-like chunks of one processor, by processor type."""
    p = F.lower(F.coalesce(ptype, F.lit("")))
    none = F.array().cast("array<string>")
    query = F.when(p.contains("executesql"), F.array(prop(props, "SQL select query", "SQL Query"))).otherwise(none)
    statement = F.when(
        p.contains("putsql") | p.contains("puthiveql"),
        F.array(prop(props, "SQL statement", "sql", "HiveQL")),
    ).otherwise(none)
    command = F.concat(prop(props, "Command Path"), F.lit(" "), prop(props, "Command Arguments"))
    quoted = F.transform(
        F.regexp_extract_all(command, F.lit(r"""("[^"]+"|'[^']+')"""), F.lit(1)),
        lambda c: F.substring(c, F.lit(2), F.length(c) - 2),
    )
    flagged = F.array_compact(
        F.array(
            *[
                F.when(
                    command.rlike(rf"""{name}\s+(["'])(.+?)\1"""),
                    F.regexp_extract(command, rf"""{name}\s+(["'])(.+?)\1""", 2),
                )
                for name in ("-e", "-q", "--execute")
            ]
        )
    )
    chunks = F.concat(quoted, flagged)
    raw = F.when(
        (F.size(chunks) == 0) & command.rlike(r"(?i)\b(select|insert|merge|create|alter|refresh)\b"),
        F.array(command),
    ).otherwise(none)
    named = F.transform(
        F.filter(
            props,
            lambda x: (F.length(x["value"]) > 10)
            & has_any(F.lower(x["name"]), ["sql", "query", "statement", "hql"]),
        ),
        lambda x: x["value"],
    )
    stream = F.when(p.contains("executestreamcommand"), F.concat(chunks, raw, named)).otherwise(none)
    return F.filter(F.concat(query, statement, stream), lambda s: strip(s) != "")


def warehouse_table(path: Column) -> Column:
    """``/warehouse/<db>.db/<table>`` as ``db.table``, else null."""
    long_form = r"/(?:user/)?hive/warehouse/([^/]+\.db)/([^/]+)"
    plain = r"/warehouse/([^/]+\.db)/([^/]+)"

    def named(pattern: str) -> Column:
        return F.when(
            path.rlike(pattern),
            F.concat(
                F.replace(F.regexp_extract(path, pattern, 1), F.lit(".db"), F.lit("")),
                F.lit("."),
                F.regexp_extract(path, pattern, 2),
            ),
        )

    return F.coalesce(named(long_form), named(plain))


def jdbc_source(url: Column) -> Column:
    """Readable source of a connection URL."""
    low = F.lower(url)
    after_at = F.split(url, "@").getItem(1)
    hive = F.substring_index(F.replace(url, F.lit("jdbc:hive2://"), F.lit("")), ";", 1)
    generic = F.get(F.split(F.replace(url, F.lit("jdbc:"), F.lit("")), "//"), 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit("Unknown Database"))
        .when(
            low.contains("oracle:thin:"),
            F.when(url.contains("@"), F.concat(F.lit("Oracle: "), F.get(F.split(url, "@"), 1))).otherwise(url),
        )
        .when(low.contains("hive2://"), F.concat(F.lit("Hive: "), hive))
        .when(
            low.contains("jdbc:") & generic.isNotNull(),
            F.concat(F.lit("Database: "), F.substring_index(generic, "?", 1)),
        )
        .otherwise(url)
    )

