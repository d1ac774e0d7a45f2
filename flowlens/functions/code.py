"""Script expressions: language guess, code and path detection, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.text import ends_with_any, flag, has_any, matches_any, normalize_el, strip


def _search(c: Column, pattern: str, flags: str = "i") -> Column:
    return c.rlike(f"(?{flags})" + pattern)


def language_scores(text: Column) -> Column:
    """array<struct<score, rank, lang>>: matching signatures per language, earlier languages ranked higher."""
    return F.array(
        *[
            F.struct(
                sum((flag(_search(text, p, "imd")) for p in patterns), F.lit(0)).alias("score"),
                F.lit(-i).alias("rank"),
                F.lit(lang).alias("lang"),
            )
            for i, (lang, patterns) in enumerate(V.LANGUAGE_SIGNATURES)
        ]
    )


def guess_language(text: Column, window: int | None = None) -> Column:
    """struct<lang, confidence>. The whole text counts; ``window`` limits it to the first characters."""
    seen = text if window is None else F.substring(text, 1, window)
    best = F.array_max(language_scores(seen))
    return F.when(
        best["score"] > 0,
        F.struct(
            best["lang"].alias("lang"), F.least(F.lit(0.95), best["score"] * 0.15 + 0.25).alias("confidence")
        ),
    ).otherwise(F.struct(F.lit("unknown").alias("lang"), F.lit(0.3).alias("confidence")))


def is_query_prop(name: Column) -> Column:
    return F.lower(name).rlike(r"^query_\d+")


def is_single_expression(value: Column) -> Column:
    """True where the whole value is one ``${...}``, nested expressions included."""
    text = strip(value)
    marked = F.replace(F.replace(text, F.lit("${"), F.lit("\x01")), F.lit("}"), F.lit("\x02"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + flag(ch == "\x01") - flag(ch == "\x02")
        closes = (ch == "\x02") & (depth == 0) & (s["end"] == 0)
        return F.struct(
            depth.alias("depth"), (s["at"] + F.length(ch)).alias("at"),
            F.when(closes, s["at"] + F.length(ch)).otherwise(s["end"]).alias("end"),
        )

    folded = F.aggregate(F.split(marked, r"(?<=[\x01\x02])|(?=[\x01\x02])"), start, step)
    return F.when(text.startswith("${"), folded["end"] == F.length(marked)).otherwise(F.lit(False))


def looks_like_code(name: Column, value: Column, ptype: Column) -> Column:
    v, low_name, low_type = normalize_el(value, "ELVAR"), F.lower(name), F.lower(ptype)
    external = value.contains("/") & ends_with_any(value, V.SCRIPT_EXTENSIONS)
    configuration = low_type.contains("executestreamcommand") & has_any(low_name, V.COMMAND_CONFIG_WORDS)
    log_text = low_type.contains("logmessage") & has_any(low_name, ["log-message", "log message"])
    longish = (F.length(v) >= 40) | v.contains("\n")
    hinted = (
        matches_any(v, V.CODE_TOKENS, "i")
        | has_any(low_name, V.SCRIPT_NAME_HINTS)
        | has_any(low_type, V.SCRIPT_TYPE_HINTS)
    )
    detected = (
        (F.length(strip(v)) >= 2) & ~external & ~configuration & ~log_text & longish & hinted
        & ~is_single_expression(value)
    )
    return F.coalesce(F.when(value == "", F.lit(False)).otherwise(is_query_prop(name) | detected), F.lit(False))


def not_a_script(value: Column) -> Column:
    v = strip(value)
    low = F.lower(v)
    return (
        v.isNull()
        | (F.length(v) < 3)
        | v.startswith("^") | v.endswith("$") | v.contains(".*") | v.contains("\\.")
        | (v.contains("${") & v.contains("}") & ~v.startswith("/"))
        | has_any(v, ["*", "?", "["])
        | (v.contains(";") & ~v.contains("/"))
        | has_any(low, V.ERROR_WORDS)
        | low.isin(*V.CONFIG_WORDS)
    )


def script_paths(text: Column) -> Column:
    """Absolute script paths in a text, in order, repeats kept."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({V.SCRIPT_PATH})"), F.lit(1)), lambda p: ~not_a_script(p))


def command_scripts(command: Column) -> Column:
    """Distinct script paths and script-named tokens of a command line."""
    lines = F.filter(
        F.transform(F.split(command, "\n"), strip), lambda line: (line != "") & ~line.startswith("#")
    )
    tokens = F.transform(
        F.flatten(F.transform(lines, lambda line: F.split(line, r"\s+"))),
        lambda t: F.btrim(t, F.lit("\"'`;")),
    )
    named = F.filter(tokens, lambda t: ends_with_any(t, V.SCRIPT_EXTENSIONS) & ~not_a_script(t))
    none = F.array().cast("array<string>")
    return F.when(
        (F.coalesce(command, F.lit("")) != "") & ~not_a_script(command),
        F.array_sort(F.array_distinct(F.concat(script_paths(command), named))),
    ).otherwise(none)


def script_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in V.SCRIPT_TYPE_BY_EXTENSION.items() for x in pair])
    extension = F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1)))
    return F.coalesce(F.try_element_at(known, extension), F.lit("unknown_script"))


def query_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(V.QUERY_REF), F.lit(1))))


def impala_hosts(command: Column) -> Column:
    return F.regexp_extract_all(command, F.lit(r"(?:^|\s)(?:-i|--impalad)\s+(\S+)"), F.lit(1))


def hosts(text: Column) -> Column:
    """Sorted distinct lower-case URL hosts and domain names of a text."""
    urls = F.regexp_extract_all(text, F.lit(V.URL_HOST), F.lit(1))
    domains = F.filter(
        F.regexp_extract_all(text, F.lit(V.DOMAIN_HOST), F.lit(1)),
        lambda h: ~has_any(F.lower(h), V.SKIPPED_HOSTS),
    )
    return F.array_sort(F.array_distinct(F.transform(F.concat(urls, domains), F.lower)))


def external_hosts(text: Column) -> Column:
    """As ``hosts``, but texts that are patterns or messages yield nothing."""
    return F.when(~not_a_script(text), hosts(text)).otherwise(F.array().cast("array<string>"))


def inline_script(name: Column, value: Column) -> Column:
    """Alternative detector: struct<script_type, content_preview, content_length, line_count> or null."""
    low = F.lower(name)
    multi = strip(value).contains("\n")
    sql_like = has_any(low, ["sql", "query", "statement", "hql"])
    scripted = has_any(low, V.INLINE_PROPERTY_WORDS) | matches_any(value, V.INLINE_INDICATORS, "imd")
    path_like = value.startswith("/") | value.startswith("./") | has_any(value, V.SCRIPT_EXTENSIONS)
    kind = F.lit("unknown")
    for label, pattern in reversed(V.INLINE_LANGUAGES):
        kind = F.when(_search(value, pattern), F.lit(label)).otherwise(kind)
    size = F.length(value)
    return F.when(
        (F.length(strip(value)) >= 5)
        & (scripted | (sql_like & (size > 20)))
        & (multi | sql_like)
        & ~path_like,
        F.struct(
            kind.alias("script_type"),
            F.when(size > 200, F.concat(F.substring(value, 1, 200), F.lit("..."))).otherwise(value).alias("content_preview"),
            size.alias("content_length"),
            F.size(F.split(value, "\n", -1)).alias("line_count"),
        ),
    )
