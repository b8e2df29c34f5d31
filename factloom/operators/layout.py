"""Page layout: lines into column bands, blocks split by band, and the order in which they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

#: A band begins where a left edge is further than this part of the page's width from the band's own edge.
GAP = 0.05
#: The part of a page's height, at top and bottom, where printed page numbers stand.
MARGIN = 0.08
PAGE = ("doc_id", "page_index")


def column_bands(edges: Column, width: Column) -> Column:
    """The left edges of bands, ascending, from an array of left edges; each is measured from the start of the band before."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(edges), start, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > width * GAP), F.concat(acc, F.array(x))).otherwise(acc))


def band_of(edge: Column, bands: Column) -> Column:
    """The rightmost band that begins at or before an edge."""
    return F.size(F.filter(bands, lambda b: edge >= b - 0.01)) - 1


def split_blocks(lines: DataFrame) -> DataFrame:
    """One block for each band of each raw block.

    ``lines`` has ``doc_id, page_index, raw_block, line, x0, y0, x1, y1, text, width``.
    """
    clean = lines.withColumn("text", stripped(F.col("text"))).where("text <> ''")
    own = [*PAGE, "raw_block"]
    bands = clean.groupBy(*own).agg(column_bands(F.collect_list("x0"), F.first("width")).alias("bands"))
    banded = clean.join(bands, own).withColumn("band", band_of(F.col("x0"), F.col("bands")))
    pieces = banded.groupBy(*own, "band").agg(
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.first("width").alias("width"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "line", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    return pieces.withColumnRenamed("band", "piece")


def reading_order(pieces: DataFrame) -> DataFrame:
    """Pieces numbered 0.. on their page: by page-wide band, then from the top, then as they came."""
    bands = pieces.groupBy(*PAGE).agg(column_bands(F.collect_list("x0"), F.first("width")).alias("bands"))
    placed = pieces.join(bands, list(PAGE)).withColumn("band", band_of(F.col("x0"), F.col("bands")))
    order = Window.partitionBy(*PAGE).orderBy("band", "y0", "raw_block", "piece")
    return placed.withColumn("ord", F.row_number().over(order) - 1).select(*PAGE, "ord", "band", "x0", "y0", "x1", "y1", "text")


def printed_labels(spans: DataFrame) -> DataFrame:
    """``doc_id, page_index, labels``: the declared label, else the page numbers printed in the margins.

    ``spans`` has ``doc_id, page_index, seq, y0, y1, height, text, declared``; a span that only touches a margin counts.
    """
    text = stripped(F.col("text"))
    in_margin = (F.col("y0") <= F.col("height") * MARGIN) | (F.col("y1") >= F.col("height") - F.col("height") * MARGIN)
    number = F.when(text.rlike(r"^\d{1,4}$"), text.cast("int"))
    found = F.when(in_margin & (number < 2000), F.struct(F.col("seq").alias("seq"), text.alias("text")))
    grouped = spans.groupBy(*PAGE).agg(F.max("declared").alias("declared"), F.transform(F.array_sort(F.collect_list(found)), lambda x: x["text"]).alias("printed"))
    return grouped.select(*PAGE, F.when(F.coalesce(F.col("declared"), F.lit("")) != "", F.array("declared")).otherwise(F.col("printed")).alias("labels"))


def page_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_index, text, layout_text, page_hash`` of each page.

    The layout text has a line for each block, with its place rounded half to even.
    """
    at = lambda c: F.bround(c, 0).cast("long")
    line = F.format_string("[b%d %d,%d %d,%d] %s", "ord", at("x0"), at("y0"), at("x1"), at("y1"), F.regexp_replace("text", "\n", " / "))
    rows = F.array_sort(F.collect_list(F.struct("ord", "text", line.alias("line"))))
    joined = blocks.groupBy(*PAGE).agg(rows.alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return joined.select(*PAGE, text.alias("text"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("layout_text"), F.sha2(text, 256).alias("page_hash"))
