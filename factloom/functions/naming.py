"""Names: what tells one from another, and ids that follow from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell names apart.
NAME_NOISE = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri", "m", "s",
    "limited", "ltd", "private", "pvt", "llp", "inc", "plc", "corp",
    "the", "of", "and", "a", "an", "for", "from", "to", "in", "at", "by",
)
#: Fixed value: the name space of verdict ids.
VERDICT_SPACE = "6f9619ff8b86d011b42d00c04fc964ff"


def content_tokens(name: Column) -> Column:
    """The set of words that identify a name, in order."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, NAME_NOISE))))


def digit_runs(name: Column) -> Column:
    """The set of digit runs of a name, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(r"(\p{Nd}+)"), F.lit(1))))


def uuid5(space: str, name: Column) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def verdict_id(a: Column, b: Column, source: str = "cmp") -> Column:
    """The id of the verdict on a pair of facts, whichever comes first."""
    return uuid5(VERDICT_SPACE, F.concat_ws("|", F.least(a, b), F.greatest(a, b), F.lit(source)))


def file_id(content: Column) -> Column:
    """A file's id: the first 16 hex digits of its SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)
