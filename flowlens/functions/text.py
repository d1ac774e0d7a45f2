"""General text expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import vocab as V

BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def matches_any(c: Column, patterns: Iterable[str], flags: str = "") -> Column:
    """True where any pattern is found; one alternation, so the plan stays small."""
    mode = f"(?{flags})" if flags else ""
    return c.rlike(mode + "|".join(f"(?:{p})" for p in patterns))


def has_any(c: Column, words: Iterable[str]) -> Column:
    """True where ``c`` contains any of the words (case as given)."""
    return matches_any(c, [f"\\Q{w}\\E" for w in words])


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    return c.rlike("(?:" + "|".join(f"\\Q{s}\\E" for s in suffixes) + r")\z")


def flag(c: Column) -> Column:
    """0/1 flag where null counts as 0."""
    return F.coalesce(c.cast("int"), F.lit(0))


def contains_keyword(c: Column, words: Iterable[str]) -> Column:
    return F.coalesce(has_any(F.lower(c), words), F.lit(False))


def short_type(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Unknown")).otherwise(F.substring_index(c, ".", -1))


def canonical_type(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(
        F.lower(F.substring_index(c, ".", -1))
    )


def normalize_el(c: Column, token: str = "elvar") -> Column:
    return F.regexp_replace(c, V.EL, token)


def el_bodies(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(V.EL_BODY), F.lit(1))


def el_key(body: Column) -> Column:
    return F.substring_index(body, ":", 1)


def substitute_once(text: Column, values: Column) -> Column:
    """Replace every ``${key...}`` whose key is in the map ``values``; leave the others."""
    pieces = F.split(text, V.EL_BODY, -1)
    bodies = F.concat(el_bodies(text), F.array(F.lit(None).cast("string")))
    filled = F.zip_with(
        pieces,
        bodies,
        lambda piece, body: F.concat(
            piece,
            F.when(body.isNull(), F.lit("")).otherwise(
                F.coalesce(F.try_element_at(values, el_key(body)), F.concat(F.lit("${"), body, F.lit("}")))
            ),
        ),
    )
    return F.when(text.contains("${"), F.array_join(filled, "")).otherwise(text)


def resolve_el(text: Column, values: Column, passes: int = 3) -> Column:
    for _ in range(passes):
        text = substitute_once(text, values)
    return F.coalesce(text)


def redact(c: Column) -> Column:
    for pattern, replacement in V.SECRET_PATTERNS:
        c = F.regexp_replace(c, "(?i)" + pattern, replacement.replace("{1}", "$1"))
    return c


def decode_base64_text(c: Column) -> Column:
    """Decoded text where the value looks like base64-wrapped text, else null."""
    t = strip(c)
    shaped = (F.length(t) >= 32) & (F.length(t) % 4 == 0) & t.rlike(r"^[A-Za-z0-9+/]+={0,2}\z")
    raw = F.try_to_binary(F.when(shaped, t), F.lit("base64")).cast("string")
    text = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))  # undecodable bytes are dropped
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.when((letters > 10) & text.rlike(r"[ \n]"), text)


def slugify(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z]+", "_"), r"^_+|_+\z", ""))


def map_key_hash(props: Column) -> Column:
    """SHA-256 over name-sorted properties; equal property sets share a key."""
    pairs = F.array_sort(F.transform(props, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"))))
    return F.sha2(F.to_json(pairs), 256)


def prop_values(props: Column) -> Column:
    return F.transform(F.filter(props, lambda p: p["value"].isNotNull()), lambda p: p["value"])


def prop(props: Column, *names: str) -> Column:
    """First non-empty value among the named properties, else the empty string."""
    found = [
        F.try_element_at(
            F.filter(
                F.transform(F.filter(props, _named(name)), lambda p: p["value"]),
                lambda v: v.isNotNull() & (v != ""),
            ),
            F.lit(1),
        )
        for name in names
    ]
    return F.coalesce(*found, F.lit(""))


def _named(name: str):
    return lambda p: p["name"] == name


def property_blob(props: Column) -> Column:
    return F.array_join(prop_values(props), "\n")


def json_blob(props: Column) -> Column:
    """Properties as JSON text, for patterns over names and values together."""
    return F.to_json(
        F.map_from_entries(F.transform(props, lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value"))))
    )
