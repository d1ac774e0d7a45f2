"""How likely a token is a table name: four weighted scores behind a format gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import vocab as V
from flowlens.functions.text import has_any, matches_any


def points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def format_ok(name: Column) -> Column:
    return (F.length(name) >= 2) & name.rlike(r"^[a-zA-Z_0-9][a-zA-Z0-9_.]*\z")


def shape_score(name: Column) -> Column:
    low, size = F.lower(name), F.length(name)
    score = (
        points(matches_any(low, V.NAME_SHAPES), 0.3)
        + F.when(size.between(3, 30), F.lit(0.2)).when(size > 30, F.lit(-0.1)).otherwise(F.lit(0.0))
        + points(name.rlike(r"^[^.]{2,}\.[^.]{2,}\z"), 0.3)
    )
    return F.least(score, F.lit(1.0))


def naming_score(name: Column) -> Column:
    low = F.lower(name)
    score = (
        points(has_any(low, V.TABLE_WORDS), 0.4)
        + points(has_any(low, V.DOMAIN_WORDS), 0.3)
        + points(name.contains("_"), 0.2)
        + points((name == low) & name.rlike("[a-z]"), 0.1)
    )
    return F.least(score, F.lit(1.0))


def context_score(
    ptype: Column, prop_lower: Column, confidence: Column | None = None, frequent: Column | None = None
) -> Column:
    """``confidence`` is given for names found in SQL; ``frequent`` is a learned-type flag."""
    score = points(has_any(ptype, V.DATA_PROCESSOR_WORDS), 0.5) + points(
        has_any(prop_lower, V.SCORED_PROPERTY_WORDS), 0.4
    )
    if confidence is not None:
        score = score + confidence * F.lit(0.3)
    if frequent is not None:
        score = score + points(frequent, 0.2)
    score = score - points(ptype.contains("generateflowfile"), 0.8)
    if confidence is not None:
        score = score - points(~prop_lower.contains("sql") & ~prop_lower.contains("query"), 0.1)
    return F.greatest(score, F.lit(0.0))


def database_score(name: Column) -> Column:
    part = r"[a-zA-Z_0-9][a-zA-Z0-9_]*"
    score = (
        points(name.rlike(r"^[^:]*:[^:]*\z"), 0.8)
        + points(name.rlike(rf"^{part}(\.{part}){{1,2}}\z"), 0.6)
        + points(name.endswith("s") & (F.length(name) > 4), 0.2)
    )
    return F.least(score, F.lit(1.0))


def table_score(
    name: Column,
    ptype: Column,
    prop_lower: Column,
    confidence: Column | None = None,
    frequent: Column | None = None,
) -> Column:
    score = (
        shape_score(name) * 0.4
        + naming_score(name) * 0.3
        + context_score(ptype, prop_lower, confidence, frequent) * 0.2
        + database_score(name) * 0.1
    )
    return F.when(format_ok(name), F.least(score, F.lit(1.0))).otherwise(F.lit(0.0))
