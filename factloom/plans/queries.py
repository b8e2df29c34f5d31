"""Named queries over the driver's tables, one or more for each operator of the fact layer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grounding, naming, qualifiers, units
from ..operators import cells, evidence, judge, layout, reconcile, registry
from ..sources import extraction, store
from ..sources.clients import HashedEmbedder, completion_key, embedded
from . import views
from .facts import documents as report_documents
from .facts import facts as report_facts
from .facts import registry as report_registry
from .facts import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

UNITS = ["₹ million", "Cr", "crores", "Indian Rupees in millions", "INR million", "Mn Tons", "%", "percent of revenue", "'000 Tons", "US$ bn", "shipments", "lakh shares", "€ k", "  ", "", "kg per unit", "rs", "hours", "cartons"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(array: Column, by: str = ";") -> Column:
    return F.array_join(array, by)


def _units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in [*UNITS, None]], "unit string")


# Scalar rules


@query
def unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit wording against every region, so that the rule runs over a table."""
    parsed = units.parse_unit(F.col("unit"))
    return table(spark, sf_dir, "region").crossJoin(F.broadcast(_units(spark))).select("r_regionkey", "unit", parsed["currency"].alias("currency"), parsed["magnitude"].alias("magnitude"), parsed["dimension"].alias("dimension"), parsed["residual"].alias("residual"), units.unit_class(F.col("unit")).alias("unit_class"))


@query
def unit_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _units(spark).select(F.col("unit").alias("unit_a"), units.normalise(F.lit(1.0), F.col("unit")).alias("a"))
    right = _units(spark).select(F.col("unit").alias("unit_b"), units.normalise(F.lit(1.0), F.col("unit")).alias("b"))
    return left.crossJoin(F.broadcast(right)).select("unit_a", "unit_b", units.comparable(F.col("a"), F.col("b")).alias("comparable"))


@query
def precision_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("value"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    whole = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_partkey") * 10).cast("double").alias("value"))
    return lines.unionByName(orders).unionByName(whole).select("k", "value", units.precision_tolerance(F.col("value"), F.lit(1e6)).alias("tolerance"))


@query
def value_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = units.normalise(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 3 == 0, "₹ Cr").when(F.col("o_orderkey") % 3 == 1, "lakh"))
    return table(spark, sf_dir, "orders").select("o_orderkey", norm["value"].alias("value"), norm["tolerance"].alias("tolerance"), norm["currency"].alias("currency"), norm["dimension"].alias("dimension"))


@query
def value_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", units.shown(F.col("o_totalprice")).alias("shown"), units.shown(F.col("o_custkey").cast("double")).alias("shown_key"))


@query
def period_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, q, k = F.year("o_orderdate"), F.quarter("o_orderdate"), F.pmod("o_orderkey", F.lit(8))
    short = F.date_format("o_orderdate", "yy")
    label = (
        F.when(k == 0, F.format_string("Q%d FY%d", q, y))
        .when(k == 1, F.format_string("%dQ%d", y, q))
        .when(k == 2, F.format_string("year ended March 31, %d", y))
        .when(k == 3, F.format_string("nine months ended December 31, %d", y))
        .when(k == 4, F.format_string("H%d of financial year %d", F.when(q <= 2, 1).otherwise(2), y))
        .when(k == 5, F.format_string("FY'%s", short))
        .when(k == 6, F.concat(y.cast("string"), F.lit("-"), F.format_string("%02d", (y + 1) % 100)))
        .otherwise(F.lit("to date"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), qualifiers.normalise_period(label).alias("period"))


@query
def qualifier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.col("n_name"), F.concat(F.lit("  "), F.col("n_name"), F.lit(" Date ")), F.lit("As Of"), F.lit("as_of_date"), F.lit("Reporting Period"), F.concat(F.lit("--"), F.col("n_name"), F.lit("__dt")), F.lit("Fiscal-Year"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(raw).alias("i", "raw")).select("n_nationkey", "i", qualifiers.normalise_key(F.col("raw")).alias("k"))


@query
def qualifier_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_facts(spark, sf_dir).select("fact_id", qualifiers.rendered(F.col("qualifiers")).alias("text"))


# Grounding


@query
def ground_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", joined(F.array_sort(grounding.numbers_in(F.col("text"))), " ").alias("numbers"))


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice for each order, with its date in one of three forms and its price, sometimes rounded or in parentheses."""
    k = F.pmod("o_orderkey", F.lit(3))
    date = F.when(k == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(k == 1, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(" Cr)"))).when(F.pmod("o_orderkey", F.lit(4)) == 1, F.format_number("o_totalprice", 0)).otherwise(F.format_number("o_totalprice", 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", date.alias("date"), F.concat(F.lit("Ordered on "), date, F.lit(" for Rs. "), price, F.lit(" in all.")).alias("cited"))


@query
def ground_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", joined(grounding.dates_in(F.col("cited"))).alias("dates"))


@query
def grounding_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("o_orderkey", F.lit(5))
    value = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    told = F.array(F.struct(F.lit("effective").alias("key"), F.when(k == 0, "March 31, 2001").otherwise(F.col("date")).alias("value")), F.struct(F.lit("basis").alias("key"), F.lit("net").alias("value")))
    found = _notices(spark, sf_dir).select("o_orderkey", grounding.grounding_issues(value, told, F.col("cited")).alias("issues"))
    issues = F.col("issues")
    return found.select("o_orderkey", F.size(issues).cast("long").alias("n_issues"), F.exists(issues, lambda x: x.startswith("value ")).alias("value_issue"), F.array_max(F.filter(issues, lambda x: ~x.startswith("value "))).alias("date_issue"), grounding.inherited(issues).alias("inherited"))


# Reconciliation


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.prepared(report_facts(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(report_facts(spark, sf_dir))


@query
def discriminating_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.key_spread(_prepared(spark, sf_dir)).select("entity_id", "predicate_id", "k", "n_values", "carriers", "n_facts", "discriminating")


@query
def cell_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = F.transform(F.map_entries("sig"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return reconcile.signed(_prepared(spark, sf_dir)).select("fact_id", joined(sig).alias("sig"))


@query
def reconcile_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("verdict_id", "verdict", "reason_code", "fact_a", "fact_b", "entity_id", "delta", "tolerance", "cross_document", "trust")


@query
def verdict_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The qualifier differences of all verdicts, a row for each key."""
    rows = _verdicts(spark, sf_dir).select("fact_a", "fact_b", F.explode("qualifier_diff").alias("k", "v"))
    return rows.select("fact_a", "fact_b", "k", F.get("v", F.lit(0)).alias("value_a"), F.get("v", F.lit(1)).alias("value_b"))


@query
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.verdict_counts(_verdicts(spark, sf_dir))


@query
def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reason_counts(_verdicts(spark, sf_dir))


@query
def verdicts_renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over a table that also holds judged rows: those stay, the others are replaced."""
    verdicts = _verdicts(spark, sf_dir)
    judged = verdicts.where("verdict = 'CONTRADICTION'").withColumn("reason_code", F.lit("JUDGE:CONTRADICTION"))
    return views.reason_counts(reconcile.renewed(verdicts.unionByName(judged), verdicts))


@query
def verdict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.concat(F.lit("o"), F.col("o_orderkey")), F.concat(F.lit("c"), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", naming.verdict_id(a, b).alias("id_ab"), naming.verdict_id(b, a).alias("id_ba"), naming.verdict_id(a, b, "judge").alias("id_judge"))


@query
def cross_doc_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = report_facts(spark, sf_dir)
    rows = views.reconciliations(reconcile.reconcile(facts), facts, report_documents(spark), report_registry(facts), verdict="CONTRADICTION", q="revenue")
    side = lambda i: F.col("facts")[i]
    return rows.select("verdict_id", "entity", "predicate", "delta", "tolerance", "trust", side(0)["claim"].alias("claim_a"), side(1)["claim"].alias("claim_b"), side(0)["document"].alias("document_a"), side(1)["document"].alias("document_b"), side(0)["page"].alias("page_a"))


@query
def verdict_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = report_facts(spark, sf_dir)
    pages = facts.select("doc_id", "page_index").distinct().withColumn("labels", F.array(F.concat("doc_id", F.lit("-"), F.col("page_index").cast("string"))))
    verdicts = reconcile.reconcile(facts)
    chosen = verdicts.agg(F.min("verdict_id")).first()[0] or ""
    found = views.verdict_detail(verdicts, facts, report_documents(spark), pages, report_registry(facts), chosen)
    return found.select("verdict_id", "reason_code", "fact_a", "fact_b", joined(F.col("labels_a")).alias("labels_a"), joined(F.col("labels_b")).alias("labels_b"), "within")


@query
def entity_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = report_facts(spark, sf_dir)
    return views.busiest_entities(reconcile.reconcile(facts), report_registry(facts))


# Cells


@query
def cell_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.axes(_prepared(spark, sf_dir))


@query
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.grid(_prepared(spark, sf_dir)).select("fact_id", "row_key", "col_key", "row_val", "col_val", "conflict")


@query
def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.summary(_prepared(spark, sf_dir)).select("entity_id", "row_key", "col_key", joined(F.col("rows")).alias("rows"), joined(F.col("cols")).alias("cols"), "n_facts")


@query
def cell_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = report_facts(spark, sf_dir)
    return cells.candidates(facts, report_registry(facts))


# Read queries


@query
def facts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts_search(report_facts(spark, sf_dir), report_documents(spark), q="brand#1% SALES").select("fact_id", "title", "page_index", "claim_text", "value", "unit")


@query
def entities_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entities_search(report_registry(report_facts(spark, sf_dir)), "BRAND#_2").select("id", "canonical", "n")


@query
def largest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.largest_entities(report_registry(report_facts(spark, sf_dir))).select("id", "canonical", "n")


@query
def fact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.totals(report_facts(spark, sf_dir))


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The driver's documents as pages of their sources: ``documents``, ``pages`` and ``blocks``."""
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("(none)")))
    pages = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_index"), F.array(F.col("doc_id").cast("string")).alias("labels"), F.sha2("text", 256).alias("page_hash"), F.lit("text").alias("route"), (F.col("doc_id") % 2 == 0).alias("extracted"), F.col("text"))
    documents = docs.groupBy(F.col("source").alias("doc_id")).agg(F.min("doc_id").alias("added_at")).withColumn("title", F.upper("doc_id"))
    blocks = pages.select("doc_id", "page_index", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return documents, pages.drop("text"), blocks


@query
def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pages, blocks = _library(spark, sf_dir)
    return views.document_inventory(documents, pages, blocks.where("ord > 0")).select("doc_id", "title", "added_at", "n_pages", "n_facts")


@query
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.document_status(*_library(spark, sf_dir))


@query
def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pages, blocks = _library(spark, sf_dir)
    found = views.document_detail(documents, pages, blocks.where("ord > 0"), "src1")
    return found.select("doc_id", "title", "n_facts", F.explode("pages").alias("p")).select("doc_id", "title", "n_facts", "p.page_index", joined(F.col("p.labels")).alias("labels"), "p.extracted")


@query
def jobs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select(F.concat(F.lit("job"), F.col("event_id")).alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))
    return views.latest_jobs(jobs).select("job_id", "status")


# Ingest


@query
def page_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each source that are new when every third page is known."""
    _, pages, _ = _library(spark, sf_dir)
    known = pages.where("page_index % 3 = 0")
    return store.new_pages(known, pages).select("doc_id", "page_index", "page_hash")


@query
def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", naming.file_id(F.col("text").cast("binary")).alias("file_id"))


@query
def context_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, blocks = _library(spark, sf_dir)
    boxed = blocks.select("*", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return extraction.context_prompts(boxed).select("doc_id", F.length("prompt").alias("size"), F.sha2("prompt", 256).alias("digest"))


@query
def cited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each line of an order that cites its own line, the next one, and its own again; lines are blocks of the order's page."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("ord"), F.format_string("part %d", "l_partkey").alias("text"))
    blocks = lines.groupBy("doc_id", "page_index", "ord").agg(F.min("text").alias("text"))
    claims = blocks.select("doc_id", "page_index", F.col("ord").alias("claim"), F.array(F.col("ord") + 7, F.col("ord"), F.col("ord") + 1, F.col("ord")).alias("block_ids"))
    return extraction.cited(claims, blocks).select("doc_id", "claim", joined(F.col("block_ids").cast("array<string>")).alias("block_ids"), "cited_text")


@query
def documents_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that are new when those that end in 1 are known; each comes with every document of it."""
    documents, pages, _ = _library(spark, sf_dir)
    return store.new_documents(documents.where("doc_id like '%1'"), pages.select("doc_id")).select("doc_id")


@query
def pages_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page is there, and every second one comes in."""
    _, pages, _ = _library(spark, sf_dir)
    there, new = (pages.where(f"page_index % {n} = 0").select("doc_id", "page_index", F.lit(route).alias("route")) for n, route in ((3, "old"), (2, "new")))
    return store.upserted(there, new, ["doc_id", "page_index"])


@query
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a source with its blocks."""
    _, pages, blocks = _library(spark, sf_dir)
    first = pages.where("doc_id = 'src1'").agg(F.min("page_index")).first()[0] or 0
    row = store.page_row(pages, "src1", first).select("doc_id", "page_index", "page_hash")
    return row.join(store.page_blocks(blocks, "src1", first), ["doc_id", "page_index"]).select("doc_id", "page_index", "page_hash", "ord", "text")


@query
def pages_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages a fourth is read, and a fourth fails."""
    _, pages, _ = _library(spark, sf_dir)
    answers = pages.where("page_index % 4 < 2").select("doc_id", "page_index", F.expr("if(page_index % 4 = 1, 'failed', null)").alias("error"))
    return extraction.marked(pages, answers).select("doc_id", "page_index", "extracted")


@query
def job_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job of the first event."""
    jobs = table(spark, sf_dir, "events").select(F.concat(F.lit("job"), F.col("event_id")).alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))
    first = table(spark, sf_dir, "events").agg(F.min("event_id")).first()[0]
    return views.job(jobs, f"job{first}").select("job_id", "status")


@query
def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the embedding cache gains from the part types when those that begin with S are known."""
    forms = table(spark, sf_dir, "part").select(F.col("p_type").alias("form"))
    empty = spark.createDataFrame([], "key string, model string, dims int, vec array<float>")
    _, known = embedded(forms.where("form like 'S%'"), empty, HashedEmbedder())
    return embedded(forms, known, HashedEmbedder())[1].select("key", "model", "dims", F.size("vec").alias("width"))


@query
def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names under which answers about the documents are kept."""
    return table(spark, sf_dir, "documents").select("doc_id", completion_key("m1", F.coalesce("text", F.lit(""))).alias("key"))


# Layout


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text on a page for each order, in places that follow from its line items."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("line"))
        .agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("n"))
        .select("doc_id", F.lit(0).alias("page_index"), F.expr("line % 2").alias("raw_block"), "line", F.expr("cast(p % 40 * 12 as double) + 0.5").alias("x0"), F.expr("cast(s % 60 * 12 as double)").alias("y0"), F.expr("cast(p % 40 * 12 + n as double)").alias("x1"), F.expr("cast(s % 60 * 12 + 10 as double)").alias("y1"), F.format_string(" item %d ", "p").alias("text"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    )


@query
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _lines(spark, sf_dir).groupBy("doc_id").agg(layout.column_bands(F.collect_list("x0"), F.first("width")).alias("bands"))
    return edges.select("doc_id", F.size("bands").cast("long").alias("n_bands"), joined(F.transform("bands", lambda b: b.cast("int").cast("string"))).alias("bands"))


@query
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = layout.split_blocks(_lines(spark, sf_dir))
    return layout.reading_order(pieces).select("doc_id", "ord", "band", "x0", "y0", "x1", "y1", "text")


@query
def page_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _lines(spark, sf_dir).select("doc_id", "page_index", F.col("line").alias("ord"), "x0", "y0", "x1", "y1", F.concat("text", F.lit("\n"), "text").alias("text"))
    return layout.page_text(blocks).select("doc_id", "layout_text", "page_hash")


@query
def printed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _lines(spark, sf_dir).select("doc_id", "page_index", F.col("line").alias("seq"), "y0", "y1", "height", F.regexp_replace("text", "item", "").alias("text"), F.when(F.col("doc_id").endswith("7"), F.lit("vii")).alias("declared"))
    return layout.printed_labels(spans).select("doc_id", joined(F.col("labels")).alias("labels"))


@query
def evidence_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _lines(spark, sf_dir).withColumnRenamed("line", "ord")
    pages = blocks.select("doc_id", "page_index", "width", "height").distinct()
    facts = blocks.select(F.concat_ws("|", "doc_id", "ord").alias("fact_id"), "doc_id", "page_index", F.when(F.col("ord") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array("ord", F.col("ord") + 1)).alias("block_ids"))
    return evidence.clips(facts, blocks, pages)


# Registry and judge


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" "), "p_name").alias("subject"), F.col("p_type").alias("predicate"), F.element_at(F.array(*map(F.lit, ["%", "₹ Cr", "tons", "crore", ""])), (F.col("p_size") % 5 + 1)).alias("unit"))


@query
def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.surface_forms(_parts(spark, sf_dir), "predicate").select("form", "n", joined(F.col("units")).alias("units"))


@query
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("The "), F.col("c_name"), F.lit(" of "), F.col("c_mktsegment"), F.lit(" Pvt. Ltd"))
    return table(spark, sf_dir, "customer").select("c_custkey", joined(naming.content_tokens(name), " ").alias("tokens"), joined(naming.digit_runs(name), " ").alias("digits"))


@query
def registry_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of the parts, clustered by a deterministic embedding."""
    forms = registry.surface_forms(_parts(spark, sf_dir), "predicate")
    embed = HashedEmbedder()

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"form": batch["form"], "vec": embed(batch["form"].tolist())})

    vectors = forms.select("form").mapInPandas(run, "form string, vec array<float>")
    return registry.build(forms, vectors, "predicate", registry.PREDICATE_TAU).select("form", "id", "canonical", "n")


@query
def registry_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts with their brands; vectors are equal where second words begin alike, and units follow the name's length."""
    name = F.concat("p_name", F.lit(" "), "p_brand")
    parts = table(spark, sf_dir, "part").select(name.alias("predicate"), F.when(F.length(name) % 2 == 0, "%").otherwise("₹").alias("unit"))
    forms = registry.surface_forms(parts, "predicate")
    letter = F.ascii(F.lower(F.get(F.split("form", " "), F.lit(1)))) - 97
    vectors = forms.select("form", F.transform(F.sequence(F.lit(0), F.lit(25)), lambda d: (d == letter).cast("float")).alias("vec"))
    return registry.build(forms, vectors, "predicate", registry.PREDICATE_TAU).select("form", "id", "canonical", "n", "rank")


@query
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of the parts' types, clustered by size."""
    assigned = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("pre_"), "p_size").alias("id"), F.concat(F.lit("size "), "p_size").alias("canonical"), F.col("p_type").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("rank"), F.array().cast("array<float>").alias("centroid"))
    return registry.registry(assigned, "predicate").select("kind", "id", "canonical", joined(F.col("surface_forms")).alias("forms"), "n")


@query
def facts_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as facts about their brands; the registry lacks the brands that end in 3."""
    facts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("subject"), F.lit(None).cast("string").alias("entity_id"))
    assigned = facts.where("subject not like '%3'").select(F.col("subject").alias("form"), F.lower("subject").alias("id")).distinct()
    return registry.backfilled(facts, assigned, "subject", "entity_id").select("p_partkey", "subject", "entity_id")


@query
def diff_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A qualifier difference of each nation as JSON, one value missing."""
    diff = F.create_map(F.lower("n_name"), F.array(F.col("n_regionkey").cast("string"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", reconcile.diff_text(diff).alias("diff"))


class RuleJudge:
    """A stand-in for a model: the relation follows from the number of the second statement."""

    model = "rule"

    def __call__(self, prompt: str) -> str:
        names = ["equivalent", "state_transition", "contradiction", "unrelated"]
        pairs = re.findall(r"\[(\d+)\]\n  A \([^)]*\): \S+\n  B \([^)]*\): v(\d+)", prompt)
        return json.dumps({"judgements": [{"pair": int(i), "relation": names[int(b) % 4], "rationale": f"rule {int(b) % 4}"} for i, b in pairs]})


def _entity_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as entity-valued facts; their labels are the entities, and five documents hold them."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    name = F.format_string("v%08d", "vec_id")
    facts = rows.select(name.alias("fact_id"), F.pmod("vec_id", F.lit(5)).cast("string").alias("doc_id"), F.col("label").cast("string").alias("entity_id"), F.lit("p").alias("predicate_id"), name.alias("object_text"), name.alias("claim_text"), F.lit(None).cast("double").alias("value"), F.array().cast("array<string>").alias("grounding_issues"))
    return facts, rows.select(name.alias("object_text"), F.col("embedding").alias("vec"))


@query
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that pass the gate, judged by rule."""
    facts, vectors = _entity_facts(spark, sf_dir)
    documents = spark.createDataFrame([(str(i), f"T{i}") for i in range(5)], "doc_id string, title string")
    empty = spark.createDataFrame([], "key string, model string, response string, created_at timestamp")
    rows, _ = judge.judged(judge.gate(facts, vectors, 0.3), documents, RuleJudge(), empty)
    return rows.select("entity_id", "fact_a", "fact_b", "verdict", "reason_code", "trust", "explanation")


@query
def judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, vectors = _entity_facts(spark, sf_dir)
    return judge.gate(facts, vectors, 0.3).select("entity_id", F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"))


# Benchmark: the reconciliation where entities grow with the data


def reconcile_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reason_counts(reconcile.reconcile(report_facts(spark, sf_dir, "p_partkey")))
