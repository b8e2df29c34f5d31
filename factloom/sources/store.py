"""A folder of Parquet tables with the reference rules of what a new row may do: nothing that is known is written twice."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

TABLES = {
    "documents": schemas.DOCUMENTS,
    "pages": schemas.PAGES,
    "blocks": schemas.BLOCKS,
    "facts": schemas.FACTS,
    "registry": schemas.REGISTRY,
    "verdicts": schemas.VERDICTS,
    "jobs": schemas.JOBS,
    "completions": schemas.COMPLETIONS,
    "embeddings": schemas.EMBEDDINGS,
}


@dataclass(frozen=True)
class Store:
    """Tables under ``root``; each is a folder of versions, and the newest complete one is the table."""

    spark: SparkSession
    root: str

    def _versions(self, name: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{v}/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """A table; one that was never written is empty."""
        found = self._versions(name)
        if not found:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{found[-1]}/*")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to the newest version."""
        found = self._versions(name)
        version = found[-1] if found else f"v{0:08d}"
        rows = rows.select(*[f.name for f in self.read(name).schema])
        part = f"{self.root}/{name}/{version}/{uuid.uuid4().hex}"
        rows.write.parquet(part)
        self._seal(name, version)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a new version from ``rows``, which may read the old one."""
        found = self._versions(name)
        version = f"v{int(found[-1][1:]) + 1 if found else 0:08d}"
        rows.select(*[f.name for f in self.read(name).schema]).write.parquet(f"{self.root}/{name}/{version}/{uuid.uuid4().hex}")
        self._seal(name, version)

    def _seal(self, name: str, version: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{version}/_SUCCESS")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()


def new_documents(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming documents whose id isn't known, one for each id."""
    return incoming.dropDuplicates(["doc_id"]).join(known.select("doc_id"), "doc_id", "left_anti")


def new_pages(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming pages whose hash isn't known in their document; of equal ones the first page."""
    order = Window.partitionBy("doc_id", "page_hash").orderBy("page_index")
    first = incoming.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")
    return first.join(known.select("doc_id", "page_hash"), ["doc_id", "page_hash"], "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` with the rows of equal key replaced by ``incoming``."""
    return existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def ingest(store: Store, documents: DataFrame, pages: DataFrame, blocks: DataFrame) -> dict[str, int]:
    """Add documents, pages and blocks that are new; counts of pages added and skipped."""
    store.append("documents", new_documents(store.read("documents"), documents))
    known = store.read("pages")
    fresh = new_pages(known, pages).persist()
    added, total = fresh.count(), pages.count()
    if added:
        at = ["doc_id", "page_index"]
        store.replace("pages", upserted(known, fresh, at))
        own = blocks.join(fresh.select(*at), at, "left_semi")
        store.replace("blocks", upserted(store.read("blocks"), own, [*at, "ord"]))
    fresh.unpersist()
    return {"added": added, "skipped": total - added}


def page_blocks(blocks: DataFrame, doc_id: str, page_index: int) -> DataFrame:
    return blocks.where((F.col("doc_id") == doc_id) & (F.col("page_index") == page_index)).orderBy("ord")


def page_row(pages: DataFrame, doc_id: str, page_index: int) -> DataFrame:
    return pages.where((F.col("doc_id") == doc_id) & (F.col("page_index") == page_index))
