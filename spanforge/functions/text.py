"""Text and time expressions on Columns. Everything is JVM-side; offsets and lengths count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space (fixed values): ASCII white space and the spaces of Unicode.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ZERO_MICROS = -4611686018427387904


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(c: Column) -> Column:
    """c without white space, as Unicode has it, at either end."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def fields(c: Column) -> Column:
    """The runs of what is no white space."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda x: x != "")


def truncate_runes(c: Column, most: int, suffix: str) -> Column:
    """c, or its beginning and the suffix, in most characters at most."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(max(0, most - len(suffix)))), F.lit(suffix)))


def parse_time(c: Column) -> Column:
    """An RFC 3339 text as a timestamp; null for anything else. The session's zone must be UTC."""
    strict = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)\z"
    return F.when(c.rlike(strict), F.regexp_replace(c, ",", ".").try_cast("timestamp"))


def rfc3339(ts: Column) -> Column:
    """A timestamp as RFC 3339 text in UTC, without the zeros that end a fraction."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0*\z", ""), F.lit("Z"))


def seconds_text(c: Column) -> Column:
    """Unix seconds as RFC 3339 text; empty unless positive."""
    return F.when(c > 0, rfc3339(F.timestamp_seconds(c))).otherwise("")


def millis_text(c: Column) -> Column:
    """Unix milliseconds as RFC 3339 text; empty unless positive."""
    return F.when(c > 0, rfc3339(F.timestamp_millis(c))).otherwise("")


def injected(c: Column) -> Column:
    """Whether a user text was put in by a tool: known headings, and texts wrapped in a tag."""
    t = trim_space(c)
    return F.startswith(t, F.lit("# AGENTS.md instructions")) | (F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">")))


def nonempty(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


# JSON values, held as VARIANT.


def variant(c: Column) -> Column:
    return F.try_parse_json(c)


def value_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_kind(v: Column, kind: str) -> Column:
    """Whether a variant is of a kind: STRING, BOOLEAN, OBJECT, ARRAY, or a number (NUMBER)."""
    name = F.schema_of_variant(v)
    if kind == "NUMBER":
        return F.coalesce(name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    return F.coalesce(name.startswith(kind), F.lit(False))


def string_at(v: Column, path: str) -> Column:
    """The string at a path; null if there is none or it is no string."""
    x = value_at(v, path)
    return F.when(is_kind(x, "STRING"), F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """The number at a path, cut off towards zero; 0 for anything else."""
    x = value_at(v, path)
    return F.coalesce(F.when(is_kind(x, "NUMBER"), F.try_variant_get(v, path, "double").cast("long")), F.lit(0).cast("long"))


def first_string(v: Column, *keys: str) -> Column:
    """The first of the keys whose value is a string (even an empty one); else empty."""
    return F.coalesce(*(string_at(v, f"$.{k}") for k in keys), F.lit(""))


def content_text(v: Column) -> Column:
    """A result's content as text: a string itself, of an array the texts and contents of its objects by line, else its JSON."""
    items = F.try_variant_get(v, "$", "array<variant>")
    parts = F.flatten(F.transform(items, lambda x: F.array(string_at(x, "$.text"), string_at(x, "$.content"))))
    plain = F.to_json(v)
    for char, code in (("<", "003c"), (">", "003e"), ("&", "0026")):
        plain = F.replace(plain, F.lit(char), F.lit("\\u" + code))
    return (
        F.when(v.isNull() | F.is_variant_null(v), "")
        .when(is_kind(v, "STRING"), F.try_variant_get(v, "$", "string"))
        .when(is_kind(v, "ARRAY"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n"))
        .otherwise(plain)
    )
