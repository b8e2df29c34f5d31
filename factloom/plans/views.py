"""The read queries over the tables: every one a lazily built DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_like


def _like(text: str, *columns: str):
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(matches_like(F.col(c), f"%{text}%"), F.lit(False))
    return found


def document_inventory(documents: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with how many pages and facts each has, oldest first."""
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    n_facts = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_facts"))
    out = documents.join(n_pages, "doc_id", "left").join(n_facts, "doc_id", "left")
    return out.withColumns({"n_pages": F.coalesce("n_pages", F.lit(0)), "n_facts": F.coalesce("n_facts", F.lit(0))}).orderBy("added_at", "doc_id")


def document_status(documents: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages and blocks of each document."""
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    n_blocks = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    out = documents.select("doc_id", "title").join(n_pages, "doc_id", "left").join(n_blocks, "doc_id", "left")
    return out.select("doc_id", "title", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Verdicts of each kind, the most frequent first."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "verdict")


def reason_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def latest_jobs(jobs: DataFrame, most: int = 5) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(most)


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def totals(facts: DataFrame) -> DataFrame:
    """Facts, entities and predicates."""
    return facts.agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("entity_id").alias("n_entities"), F.count_distinct("predicate_id").alias("n_predicates"))


def verdict_rows(verdicts: DataFrame, facts: DataFrame, documents: DataFrame, registry: DataFrame, verdict: str | None = None, entity: str | None = None, q: str | None = None, limit: int = 60, offset: int = 0) -> DataFrame:
    """Verdicts with both facts, their documents and the registry's names; cross-document ones first, then by id."""
    wanted = verdicts
    if verdict:
        wanted = wanted.where(F.col("verdict") == verdict)
    if entity:
        wanted = wanted.where(F.col("entity_id") == entity)
    titles = documents.select("doc_id", "title")

    def side(s: str) -> DataFrame:
        cols = ("fact_id", "doc_id", "page_index", "claim_text", "value", "unit", "predicate", "object_text", "qualifiers", "title")
        return facts.join(titles, "doc_id").select(*[F.col(c).alias(f"{c}_{s}") for c in cols])

    out = wanted.join(side("a"), F.col("fact_a") == F.col("fact_id_a")).join(side("b"), F.col("fact_b") == F.col("fact_id_b"))
    if q:
        out = out.where(_like(q, "claim_text_a", "claim_text_b"))
    for kind in ("entity", "predicate"):
        names = registry.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("canonical").alias(kind))
        out = out.join(names, f"{kind}_id", "left")
    return out.orderBy(F.desc("cross_document"), "verdict_id").offset(offset).limit(limit)


def reconciliations(verdicts: DataFrame, facts: DataFrame, documents: DataFrame, registry: DataFrame, verdict: str | None = None, entity: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
    """The same as nested records, pages counted from 1."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    rows = verdict_rows(verdicts, facts, documents, registry, verdict, entity, q, limit)

    def side(s: str):
        names = {"fact_id": "id", "title": "document", "claim_text": "claim", "value": "value", "unit": "unit", "qualifiers": "qualifiers"}
        return F.struct(*[F.col(f"{c}_{s}").alias(n) for c, n in names.items()], (F.col(f"page_index_{s}") + 1).alias("page"))

    return rows.select("verdict_id", "verdict", "reason_code", "entity", "predicate", "delta", "tolerance", "cross_document", "trust", "explanation", "qualifier_diff", F.array(side("a"), side("b")).alias("facts"))


def verdict_detail(verdicts: DataFrame, facts: DataFrame, documents: DataFrame, pages: DataFrame, registry: DataFrame, verdict_id: str) -> DataFrame:
    """One verdict with both sides, the printed labels of their pages, and whether it is within tolerance."""
    one = verdict_rows(verdicts.where(F.col("verdict_id") == verdict_id), facts, documents, registry, limit=1)
    for s in ("a", "b"):
        labels = pages.select(F.col("doc_id").alias(f"doc_id_{s}"), F.col("page_index").alias(f"page_index_{s}"), F.col("labels").alias(f"labels_{s}"))
        one = one.join(labels, [f"doc_id_{s}", f"page_index_{s}"], "left")
    return one.withColumn("within", F.col("delta") <= F.col("tolerance"))


def busiest_entities(verdicts: DataFrame, registry: DataFrame, most: int = 30) -> DataFrame:
    """Entities by the number of their verdicts."""
    counted = verdicts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    names = registry.where("kind = 'entity'").select(F.col("id").alias("entity_id"), "canonical")
    return counted.join(names, "entity_id").orderBy(F.desc("n"), "entity_id").limit(most)


def facts_search(facts: DataFrame, documents: DataFrame, entity: str | None = None, q: str | None = None, limit: int = 80, offset: int = 0) -> DataFrame:
    """Facts with their document's title, in order of document and page."""
    out = facts.join(documents.select("doc_id", "title"), "doc_id")
    if entity:
        out = out.where(F.col("entity_id") == entity)
    if q:
        out = out.where(_like(q, "claim_text"))
    return out.orderBy("doc_id", "page_index", "fact_id").offset(offset).limit(limit)


def largest_entities(registry: DataFrame, most: int = 40) -> DataFrame:
    return registry.where("kind = 'entity'").orderBy(F.desc("n"), "id").limit(most)


def entities_search(registry: DataFrame, q: str = "", most: int = 100) -> DataFrame:
    found = registry.where("kind = 'entity'").where(_like(q, "canonical"))
    return found.orderBy(F.desc("n"), "id").limit(most)


def document_detail(documents: DataFrame, pages: DataFrame, facts: DataFrame, doc_id: str) -> DataFrame:
    """One document with its pages in order and its number of facts; no row if there is none."""
    own = pages.where(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "labels", "route", "extracted"))).alias("pages"))
    n = facts.where(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_facts"))
    out = documents.where(F.col("doc_id") == doc_id).join(own, "doc_id", "left").join(n, "doc_id", "left")
    return out.withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
