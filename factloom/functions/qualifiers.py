"""Qualifiers: free keys with free values, brought to a form in which they can be compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup, stripped

# Keys that mean the same.
KEY_ALIASES = {
    "asof": "as_of",
    "as_on": "as_of",
    "period_end": "period",
    "reporting_period": "period",
    "fiscal_year": "period",
    "financial_year": "period",
    "year": "period",
}
PERIOD_KEYS = ("period", "as_of")

# The patterns define what counts as a year, a span of years, a part of one, and a fiscal or partial period.
SPAN = r"(?<!\p{Nd})(\d{4})(?U:\s*)[-–/](?U:\s*)(\d{2})(?!\p{Nd})"
YEAR = r"(?<!\p{Nd})(\d{4})(?!\p{Nd})|(?i:fy)(?U:\s*)['’]?(\d{2})(?!\p{Nd})"
PART = r"(?i)(?<![A-Za-z])(q[1-4]|h[12])(?![A-Za-z0-9])"
FISCAL = r"(?iU)\bfy|financial year|fiscal"
MONTHS = r"(?iU)\b(nine|six|three)\s+months?\b"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normalise_period(text: Column) -> Column:
    """The year that a period ends in, with its quarter or half (``F`` fiscal, ``C`` calendar) or ``PARTIAL``; null without a year."""
    first, second = _all(text, SPAN, 1), _all(text, SPAN, 2)
    spans = F.flatten(F.zip_with(first, second, lambda a, b: F.array(a, F.concat(F.substring(a, 1, 2), b))))
    full = F.filter(_all(text, YEAR, 1), lambda y: y != "")
    short = F.transform(F.filter(_all(text, YEAR, 2), lambda y: y != ""), lambda y: F.concat(F.lit("20"), y))
    label = F.array_max(F.transform(F.concat(spans, full, short), lambda y: y.cast("int"))).cast("string")
    part = F.upper(F.regexp_extract(text, PART, 1))
    return (
        F.when(label.isNull(), F.lit(None).cast("string"))
        .when(part != "", F.concat(label, part, F.when(text.rlike(FISCAL), "F").otherwise("C")))
        .when(text.rlike(MONTHS), F.concat(label, F.lit("PARTIAL")))
        .otherwise(label)
    )


def normalise_key(key: Column) -> Column:
    """A key in lower case with underscores, without a trailing date word, its aliases made one."""
    k = F.regexp_replace(F.lower(stripped(key)), r"[^a-z0-9]+", "_")
    k = F.regexp_replace(F.regexp_replace(k, r"^_+|_+$", ""), r"_(date|dt)$", "")
    return F.coalesce(lookup(KEY_ALIASES, k), k)


def normalise_value(key: Column, raw: Column) -> Column:
    """A value under its normalised key; periods by their end, all else in lower case.  A null counts as ``none``."""
    text = stripped(F.coalesce(raw, F.lit("None")))
    return F.when(key.isin(*PERIOD_KEYS), F.coalesce(normalise_period(text), F.lower(text))).otherwise(F.lower(text))


def normalised(qualifiers: Column) -> Column:
    """The pairs with key and value normalised, in order, duplicates kept; no qualifiers for null."""

    def pair(q: Column) -> Column:
        key = normalise_key(q["key"])
        return F.struct(key.alias("key"), normalise_value(key, q["value"]).alias("value"))

    return F.coalesce(F.transform(qualifiers, pair), F.array().cast("array<struct<key:string,value:string>>"))


def signature(pairs: Column, keys: Column) -> Column:
    """A map of the normalised pairs over ``keys``, in order of key; of a repeated key the last value counts."""
    own = F.array_sort(F.array_intersect(F.array_distinct(F.transform(pairs, lambda q: q["key"])), keys))
    return F.map_from_arrays(own, F.transform(own, lambda k: F.element_at(F.filter(pairs, lambda q: q["key"] == k), -1)["value"]))


def rendered(qualifiers: Column) -> Column:
    """``key value`` pairs for reading, two blanks between."""
    return F.coalesce(F.array_join(F.transform(qualifiers, lambda q: F.concat(q["key"], F.lit(" "), q["value"])), "  "), F.lit(""))
