"""Host and path rules for URLs, as an equi-join of expressions.  [native]

A rule is a host and a path prefix.  Each URL is expanded into the pairs of a
host suffix (at label boundaries) and a path prefix that some rule *could* have:
host suffixes are joined with the table of shapes (how many labels, and the path lengths
that rules of so many labels have), so the expansion is as wide as the rules are varied,
not as the URL is long.  The pairs meet the rules on a short hash prefix, a full digest confirms the match,
and the longest rule wins.  Shapes and rules are broadcast where their bytes, counted first, stay
below ``BROADCAST_BYTES``; larger ones are joined by shuffles.

Null or malformed URLs have empty host and path and fit no rule.  Rules with a null host or path
are ignored, repeated ones count once.  Repeated pages keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rules, or of their shapes, up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Hex digits of the digest on which the join meets.
SHORT = 8


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``, existing columns of those names replaced.

    ``rules`` has ``host, path, verdict, source``: ``contract`` rules come before
    ``method`` rules (the engine's own list), and only the former are shown in
    ``rule``.  Of several that fit, the longest (host and path together) wins,
    then the longer host, then ``block``.
    """
    known = rules.select("host", "path", "verdict", "source").where("host is not null and path is not null").dropDuplicates()
    shapes = known.groupBy(labels(F.col("host")).alias("_n")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("_lengths"))
    # Rows of a join also hold two digests, the verdict and the hit's numbers.
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 250), F.max(labels(F.col("host"))), F.max(F.length("path"))).first()
    if size[0] is None:
        size = (0, 0, 0)
    shape_size = shapes.agg(F.sum(32 + 4 * F.size("_lengths"))).first()[0] or 0
    known = known.select(
        F.substring(digest(F.col("host"), F.col("path")), 1, SHORT).alias("_short"),
        digest(F.col("host"), F.col("path")).alias("_full"),
        F.struct(
            (F.col("source") == "contract").cast("int").alias("first"),
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("verdict") == "block").cast("int").alias("blocks"),
            F.col("verdict").alias("verdict"),
            F.concat("host", "path").alias("rule"),
        ).alias("_hit"),
    )
    if size[0] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    if shape_size <= BROADCAST_BYTES:
        shapes = F.broadcast(shapes)

    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c in pages.columns])
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    # What decides is the host and as much of the path as the longest rule has.
    most_labels, longest = size[1], size[2]
    sites = parts.select("host", F.substring("path", 1, longest).alias("__url_head")).where("host <> ''").distinct()
    split = F.split(F.col("host"), r"\.")
    ends = F.sequence(F.lit(1), F.least(F.size(split), F.lit(max(1, most_labels))))
    wide = sites.select("host", "__url_head", F.explode(ends).alias("_n")).join(shapes, "_n")
    wide = wide.select("host", "__url_head", "_n", F.explode(F.filter("_lengths", lambda m: m <= F.length("__url_head"))).alias("_m"))
    suffix = F.concat_ws(".", F.slice(split, F.size(split) - F.col("_n") + 1, F.col("_n")))
    wide = wide.select("host", "__url_head", digest(suffix, F.substring(F.col("__url_head"), F.lit(1), F.col("_m"))).alias("_digest"))
    wide = wide.withColumn("_short", F.substring("_digest", 1, SHORT))
    hits = wide.join(known, "_short").where(F.col("_digest") == F.col("_full"))
    best = hits.groupBy("host", "__url_head").agg(F.max("_hit").alias("__url_best"))
    out = parts.withColumn("__url_head", F.substring("path", 1, longest)).join(best, ["host", "__url_head"], "left")
    return out.withColumns(
        {
            "rule": F.when(F.col("__url_best.first") == 1, F.col("__url_best.rule")),
            "verdict": F.coalesce(F.col("__url_best.verdict"), F.lit(default)),
        }
    ).drop("__url_head", "__url_best")
