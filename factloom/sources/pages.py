"""Pages from files: binary reads, a parser that can be exchanged, and the layout operators behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import file_id
from ..operators import layout

#: What a parser yields for each line of text: page, width, height, declared label, raw block, line, box and text.
LINES = "page_index int, width double, height double, declared string, raw_block int, line int, x0 double, y0 double, x1 double, y1 double, text string"
Parser = Callable[[bytes], Iterable[tuple]]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``doc_id, path, title, content`` of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(file_id(F.col("content")).alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("title"), "content")


def read_lines(files: DataFrame, parse: Parser, first: int | None = None, last: int | None = None) -> DataFrame:
    """The lines of all pages, or of pages ``first`` to ``last`` (from 1, both included)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LINES.split(", ")]
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                rows = pd.DataFrame(list(parse(bytes(content))), columns=names)
                rows.insert(0, "doc_id", doc_id)
                yield rows

    lines = files.select("doc_id", "content").mapInPandas(run, f"doc_id string, {LINES}")
    low, high = (first or 1) - 1, (last - 1 if last else 2**31 - 1)
    return lines.where(F.col("page_index").between(low, high))


def parse_plain(content: bytes) -> Iterator[tuple]:
    """A parser for plain text: form feeds end pages, empty lines end blocks, tabs begin columns."""
    for page, text in enumerate(content.decode("utf-8", "replace").split("\f")):
        block = 0
        for row, line in enumerate(text.split("\n")):
            if not line.strip():
                block += 1
                continue
            at = 0
            for k, part in enumerate(line.split("\t")):
                if part.strip():
                    yield page, 612.0, 792.0, None, block, row * 100 + k, 36.0 + 6 * at, 36.0 + 12 * row, 36.0 + 6 * (at + len(part)), 46.0 + 12 * row, part
                at += max(len(part) + 8, 30)


def assembled(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``pages`` and ``blocks`` tables of parsed lines."""
    blocks = layout.reading_order(layout.split_blocks(lines)).select("doc_id", "page_index", "ord", "x0", "y0", "x1", "y1", "text")
    spans = lines.select("doc_id", "page_index", (F.col("raw_block") * 100_000 + F.col("line")).alias("seq"), "y0", "y1", "height", "text", "declared")
    sizes = lines.groupBy("doc_id", "page_index").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    texts = layout.page_text(blocks).select("doc_id", "page_index", "page_hash")
    at = ["doc_id", "page_index"]
    pages = sizes.join(layout.printed_labels(spans), at).join(texts, at)
    return pages.select("doc_id", "page_index", "labels", "page_hash", "width", "height", F.lit("text").alias("route"), F.lit(False).alias("extracted")), blocks
