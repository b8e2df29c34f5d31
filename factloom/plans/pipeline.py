"""The stages from files to verdicts, each a table of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import judge, reconcile, registry
from ..sources import extraction, pages
from ..sources.clients import Completer, Embedder, embedded
from ..sources.store import Store, ingest


def ingest_path(store: Store, path: str, parse: pages.Parser = pages.parse_plain, first: int | None = None, last: int | None = None) -> dict[str, int]:
    """Read files, lay out their pages, and add what is new."""
    files = pages.read_files(store.spark, path)
    lines = pages.read_lines(files, parse, first, last)
    page_rows, block_rows = pages.assembled(lines)
    documents = files.select("doc_id", "path", "title", F.lit(None).cast("string").alias("context"), F.current_timestamp().alias("added_at"))
    return ingest(store, documents, page_rows, block_rows)


def extract(store: Store, complete: Completer) -> int:
    """Facts of all pages that have none yet; returns how many were added."""
    documents, blocks = store.read("documents"), store.read("blocks")
    cards, new = extraction.context_cards(documents, blocks, store.read("completions"), complete)
    store.append("completions", new)
    filled = documents.join(cards.withColumnRenamed("context", "_new"), "doc_id", "left").withColumn("context", F.coalesce("context", "_new")).drop("_new")
    store.replace("documents", filled)
    facts, answers, new = extraction.extract(store.read("pages"), blocks, store.read("documents"), store.read("completions"), complete)
    store.append("completions", new)
    # Asked once: from here on the answers come from the cache.
    facts, answers, _ = extraction.extract(store.read("pages"), blocks, store.read("documents"), store.read("completions"), complete)
    before = store.read("facts").count()
    store.append("facts", facts)
    store.replace("pages", extraction.marked(store.read("pages"), answers))
    return store.read("facts").count() - before


def resolve(store: Store, embed: Embedder) -> dict[str, int]:
    """Registries of subjects and predicates, and their ids on the facts; how many of each."""
    facts = store.read("facts")
    tables, counts = [], {}
    for kind, column, tau in (("entity", "subject", registry.ENTITY_TAU), ("predicate", "predicate", registry.PREDICATE_TAU)):
        forms = registry.surface_forms(facts, column)
        vectors, new = embedded(forms, store.read("embeddings"), embed)
        store.append("embeddings", new)
        vectors, _ = embedded(forms, store.read("embeddings"), embed)
        assigned = registry.build(forms, vectors, kind, tau)
        tables.append(registry.registry(assigned, kind))
        facts = registry.backfilled(facts, assigned, column, f"{kind}_id")
    store.replace("registry", tables[0].unionByName(tables[1]))
    store.replace("facts", facts)
    for row in store.read("registry").groupBy("kind").count().collect():
        counts[row.kind] = row["count"]
    return counts


def reconcile_all(store: Store) -> DataFrame:
    """Renew the comparator's verdicts; returns the counts."""
    verdicts = reconcile.reconcile(store.read("facts"), store.read("documents"))
    store.replace("verdicts", reconcile.renewed(store.read("verdicts"), verdicts))
    return store.read("verdicts").groupBy("verdict").count()


def judge_all(store: Store, embed: Embedder, complete: Completer, similarity: float = judge.SIMILARITY, limit: int | None = None) -> DataFrame:
    """Renew the judge's verdicts; returns the counts."""
    facts = store.read("facts")
    texts = facts.where("value is null and entity_id is not null").select("object_text")
    vectors, new = embedded(texts, store.read("embeddings"), embed, "object_text")
    store.append("embeddings", new)
    pairs = judge.gate(facts, vectors, similarity)
    _, new = judge.judged(pairs, store.read("documents"), complete, store.read("completions"), limit)
    store.append("completions", new)
    verdicts, _ = judge.judged(pairs, store.read("documents"), complete, store.read("completions"), limit)
    store.replace("verdicts", judge.renewed(store.read("verdicts"), verdicts))
    return store.read("verdicts").groupBy("verdict").count()
