"""Ingest as a stream: each micro-batch goes through the batch rules, so a replayed batch adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.naming import file_id
from ..sources import pages
from ..sources.store import Store, ingest


def ingest_batch(store: Store, files: DataFrame, parse: pages.Parser = pages.parse_plain) -> dict[str, int]:
    """One batch of ``path, content`` rows."""
    named = files.select(file_id(F.col("content")).alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("title"), "content")
    page_rows, block_rows = pages.assembled(pages.read_lines(named, parse))
    documents = named.select("doc_id", "path", "title", F.lit(None).cast("string").alias("context"), F.current_timestamp().alias("added_at"))
    return ingest(store, documents, page_rows, block_rows)


def ingest_stream(store: Store, path: str, checkpoint: str, parse: pages.Parser = pages.parse_plain, files_per_batch: int = 100) -> StreamingQuery:
    """Watch a folder; stops by itself when all files that were there are read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = store.spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.writeStream.foreachBatch(lambda batch, _: ingest_batch(store, batch.select("path", "content"), parse)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
