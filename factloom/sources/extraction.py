"""Claims from pages: what a model reads, what it answers, and which answers stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grounding import grounding_issues
from ..operators import layout
from ..schemas import CLAIM, CONTEXT_CARD
from .clients import Completer, completed

PAGE = ["doc_id", "page_index"]
CONTEXT_PAGES, CONTEXT_SIGNS = 2, 12_000


#: What a model is told before the first pages of a document.
CONTEXT_TASK = f"""You are given the opening pages of one document. Say who issued it, what kind of document it is, which period it reports on,
the date as of which it speaks, and in two sentences what it is about. Leave a field empty where the pages don't tell.
Return one JSON object with the fields {CONTEXT_CARD}."""
#: What a model is told before the blocks of a page.
PAGE_TASK = f"""You are given what is known of a document, then one of its pages as numbered blocks with their places.
List every statement of fact on the page as a claim that can be read by itself: one subject, one predicate, one value or object.
Copy figures as printed, without scaling them, and put the printed unit beside them. Everything that limits a statement
(period, basis, segment, scope, date) is a qualifier with a short key. Cite the numbers of the blocks that hold the statement,
and make no claim that you cannot cite. Mark forecasts and plans by their modality, and rounded figures as approximate.
Return one JSON object with the field claims, an array; each claim is an object with the fields {CLAIM}."""


def context_prompts(blocks: DataFrame) -> DataFrame:
    """``doc_id, prompt``: the text of a document's first pages, cut to a length."""
    texts = layout.page_text(blocks)
    at = Window.partitionBy("doc_id").orderBy("page_index")
    first = texts.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= CONTEXT_PAGES)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), "\n\n")
    return first.groupBy("doc_id").agg(F.substring(joined, 1, CONTEXT_SIGNS).alias("prompt"))


def context_cards(documents: DataFrame, blocks: DataFrame, cache: DataFrame, complete: Completer) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, context`` of documents that have none yet, rows for the cache)."""
    prompts = context_prompts(blocks).join(documents.where("context is null").select("doc_id"), "doc_id")
    prompts = prompts.withColumn("prompt", F.concat_ws("\n\n", F.lit(CONTEXT_TASK), "prompt"))
    found, new = completed(prompts, cache, complete)
    card = F.from_json("response", CONTEXT_CARD)
    text = F.concat_ws("; ", *[F.concat(F.lit(f"{k}: "), card[k]) for k in ("issuer", "doc_type", "reporting_period", "as_of", "summary")])
    return prompts.join(found, "prompt").select("doc_id", text.alias("context")), new


def page_prompts(pages: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, page_index, prompt`` of the pages that were not extracted yet."""
    todo = pages.where(~F.col("extracted")).select(*PAGE)
    texts = layout.page_text(blocks).join(todo, PAGE)
    return texts.join(documents.select("doc_id", "context"), "doc_id").select(*PAGE, F.concat_ws("\n\n", F.lit(PAGE_TASK), "context", "layout_text").alias("prompt"))


def cited(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """``claims`` with ``block_ids`` that exist on the page and ``cited_text`` (in order of citation, repeated ones repeated); claims without one go."""
    texts = blocks.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("ord", "text"))).alias("texts"))
    known = claims.join(texts, PAGE).withColumn("block_ids", F.filter("block_ids", lambda b: F.map_contains_key("texts", b)))
    return known.where(F.size("block_ids") > 0).withColumn("cited_text", F.array_join(F.transform("block_ids", lambda b: F.try_element_at("texts", b)), " ")).drop("texts")


def extract(pages: DataFrame, blocks: DataFrame, documents: DataFrame, cache: DataFrame, complete: Completer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new facts, the pages that were read or failed with their ``error``, rows for the cache)."""
    prompts = page_prompts(pages, blocks, documents)
    found, new = completed(prompts, cache, complete)
    answers = prompts.join(found, "prompt")
    answer = T.StructType([T.StructField("claims", T.ArrayType(T.DataType.fromDDL(CLAIM)))])
    claims = answers.where("error is null").select(*PAGE, F.explode(F.from_json("response", answer)["claims"]).alias("c")).select(*PAGE, "c.*")
    kept = cited(claims, blocks)
    facts = kept.select(
        F.expr("uuid()").alias("fact_id"),
        *PAGE,
        *[c for c in claims.columns if c not in PAGE],
        grounding_issues(F.col("value"), F.col("qualifiers"), F.col("cited_text")).alias("grounding_issues"),
        F.lit("text").alias("source_modality"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("predicate_id"),
    )
    return facts, answers.select(*PAGE, "error"), new


def marked(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """``pages`` with those extracted that were read without an error."""
    read = answers.where("error is null").select(*PAGE, F.lit(True).alias("_read")).distinct()
    return pages.join(read, PAGE, "left").withColumn("extracted", F.col("extracted") | F.coalesce("_read", F.lit(False))).drop("_read")
