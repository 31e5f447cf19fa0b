"""String rules: canonical codes, symbol keys, snake-case names, notice titles."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

__all__ = [
    "blank_to_null", "canonical_code", "join_symbol_key", "normalized_title", "snake_case",
    "split_symbol_key", "taxonomy_level", "valid_symbol_key",
]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def canonical_code(c: Column) -> Column:
    """Sector name to code: trimmed, upper case, ``&`` spelled out, ``-`` and space as ``_``."""
    return F.translate(F.replace(F.upper(F.trim(c)), F.lit("&"), F.lit("AND")), "- ", "__")


def taxonomy_level(c: Column) -> Column:
    """A level outside 1..4 (or missing) falls back to 1."""
    return F.when(c.between(1, 4), c).otherwise(F.lit(1)).cast("int")


def join_symbol_key(exchange: Column, code: Column) -> Column:
    return F.concat_ws("-", F.upper(exchange), F.upper(code))


def valid_symbol_key(c: Column) -> Column:
    """``<exchange>-<code>`` with both parts non-blank."""
    return F.coalesce(c.rlike(r"(?s)^[^-]*[^\s-][^-]*-.*\S"), F.lit(False))


def split_symbol_key(c: Column) -> tuple[Column, Column]:
    """(exchange, code), cut at the first dash; null when the key is not valid."""
    parts = F.split(c, "-", 2)
    ok = valid_symbol_key(c)
    return F.when(ok, parts[0]), F.when(ok, parts[1])


def snake_case(name: str) -> str:
    """``NMValue`` -> ``nm_value``, ``foreign-buy-value`` -> ``foreign_buy_value``."""
    marked = re.sub(r"(?<=[a-z0-9])[A-Z]|(?<=[A-Z])[A-Z](?=[a-z])", r"_\g<0>", name)
    return "_".join(part for part in re.split(r"[^0-9A-Za-z]+", marked) if part).lower()


# The title patterns and their placeholders, applied in this order.
TITLE_RULES = (
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"),
    (
        r"(?i)\b\d{4}-\d{2}-\d{2}(?:[t\s]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?)?\b",
        "<timestamp>",
    ),
    (r"\d+", "<number>"),
    (r"\s+", " "),
)


def normalized_title(c: Column) -> Column:
    """Lower-case title with ids, timestamps and numbers masked, so repeats compare equal."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for pattern, mask in TITLE_RULES:
        out = F.regexp_replace(out, pattern, mask)
    return out
