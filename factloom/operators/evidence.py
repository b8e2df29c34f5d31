"""Evidence: the part of a page that shows what a fact cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, LEAST_HEIGHT = 18.0, 90.0


def clips(facts: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``fact_id, x0, y0, x1, y1``: the cited blocks' box with a margin, at least ``LEAST_HEIGHT`` high, on the page; the whole page if none is cited."""
    cited = facts.select("fact_id", "doc_id", "page_index", F.explode("block_ids").alias("ord")).distinct()
    boxes = cited.join(blocks.select("doc_id", "page_index", "ord", "x0", "y0", "x1", "y1"), ["doc_id", "page_index", "ord"])
    box = boxes.groupBy("fact_id").agg((F.min("x0") - PAD).alias("bx0"), (F.min("y0") - PAD).alias("by0"), (F.max("x1") + PAD).alias("bx1"), (F.max("y1") + PAD).alias("by1"))
    grow = F.greatest((F.lit(LEAST_HEIGHT) - (F.col("by1") - F.col("by0"))) / 2, F.lit(0.0))
    box = box.withColumn("grow", grow)
    on_page = facts.select("fact_id", "doc_id", "page_index").join(pages.select("doc_id", "page_index", "width", "height"), ["doc_id", "page_index"]).join(box, "fact_id", "left")
    return on_page.select(
        "fact_id",
        F.greatest(F.coalesce("bx0", F.lit(0.0)), F.lit(0.0)).alias("x0"),
        F.greatest(F.coalesce(F.col("by0") - F.col("grow"), F.lit(0.0)), F.lit(0.0)).alias("y0"),
        F.least(F.coalesce("bx1", "width"), F.col("width")).alias("x1"),
        F.least(F.coalesce(F.col("by1") + F.col("grow"), F.col("height")), F.col("height")).alias("y1"),
    )
