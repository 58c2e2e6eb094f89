"""Parsing of text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(line: Column, begin: int, end: int) -> Column:
    """Characters [begin, end) from 0; null if the line is too short to have them all."""
    return F.when(F.length(line) >= end, F.substring(line, begin + 1, end - begin))


def loose_field(line: Column, begin: int, end: int) -> Column:
    """What there is of characters [begin, end), cleaned."""
    return clean(F.substring(line, begin + 1, end - begin))


def clean(text: Column) -> Column:
    """Trim, make each run of white space one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def whole_number(text: Column) -> Column:
    """A signed integer without blanks; anything else is null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def number_unless(text: Column, *missing: str) -> Column:
    """A double; null where the text is one of `missing` or no number."""
    cleaned = clean(text)
    return F.when(~cleaned.isin(*missing), cleaned.try_cast("double"))


def marine_number(text: Column) -> Column:
    """A double; null for blanks and the feeds' ways to say that a value is missing: MM, M, NA, N/A, 99..., and 999 or more."""
    trimmed = F.trim(text)
    value = F.when(~trimmed.isin("", "MM", "M", "NA", "N/A"), trimmed.try_cast("double"))
    missing = (value >= 999.0) | ((value >= 99.0) & trimmed.startswith("99"))
    return F.when(~missing, value)


def first_timestamp(text: Column, *formats: str) -> Column:
    """By the first format that fits, in the session's time zone."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in formats])


def short_hash(text: Column) -> Column:
    """The first four bytes of SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 8)


def safe_id(text: Column, default: str) -> Column:
    """Lower case, with only letters, digits and . _ - in it; `default` if nothing is left."""
    out = F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"-+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(F.length(F.trim(out)) > 0, out).otherwise(F.lit(default))
