"""Text rules that differ between engines, pinned down."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def folded(text: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matches_like(text: Column, pattern: str) -> Column:
    """LIKE, blind to the case of ASCII letters only; ``%`` and ``_`` in the pattern are wildcards."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
    return folded(text).like(lower)


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: Mapping, key: Column) -> Column:
    """The value of a key, null for a key that isn't there."""
    return F.try_element_at(literal_map(values), key)
