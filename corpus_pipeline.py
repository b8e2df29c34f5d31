"""From documents to training sequences, in five stages.

Each stage takes what the one before it kept and calls one operator: low quality goes,
one document of each group of near copies stays, secrets are blotted out, sources are
mixed towards flatter shares, and what remains is packed in sequences of 4096 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, mixing, packing, quality, secrets
from factloom.llm.common import id_filter, materialise, passing, table
from factloom.llm.queries import MIX_TARGETS, tokenizer_path

#: The part of all tokens that mixing draws, and the power that flattens the sources' shares.
MIX_SHARE, MIX_POWER = 0.7, 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, of its smallest id (then the smallest digest, then row); rows without words, and those without an id, stay."""
    groups = materialise(jaccard.near_duplicate_rows(docs).where("doc_id is not null and label is not null"), "groups")
    # A row is known by its id and its digest; several of a group may have its smallest id, and the ``__rest`` of equal ones must go.
    heads = materialise(groups.where("doc_id = component_id").groupBy("label", "doc_id", "sig").agg(F.count(F.lit(1)).alias("n")), "heads")
    first = heads.groupBy("label").agg(F.min("sig").alias("first"))
    more = heads.join(first, "label").where("sig <> first or n > 1").select("doc_id", F.col("sig").alias("__sig"), F.expr("sig = first").alias("__rest"))
    others = groups.where("doc_id <> component_id").select("doc_id", F.col("sig").alias("__sig"), F.lit(False).alias("__rest")).distinct()
    marks = materialise(others.unionByName(more), "marks")
    # Only documents that may be dropped are joined; the others' texts stay where they are.
    at = F.xxhash64(F.col("doc_id").cast("long"))
    asked = passing(docs, id_filter(marks.select(F.xxhash64("doc_id").alias("at")), "at"), at)
    marked = docs.withColumn("__asked", asked)
    sure, open_rows = marked.where("not __asked").select(*docs.columns), marked.where("__asked").withColumn("__sig", jaccard.digests())
    kept = sure.unionByName(open_rows.join(marks, ["doc_id", "__sig"], "left_anti").select(*docs.columns))
    twins = marks.where("__rest").select("doc_id", "__sig")
    if not twins.limit(1).count():
        return kept
    one = open_rows.join(twins, ["doc_id", "__sig"]).groupBy("doc_id", "__sig").agg(F.min(F.struct(*docs.columns)).alias("__one"))
    return kept.unionByName(one.select("__one.*"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return secrets.redact(docs, secrets.survey(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of documents whose languages have the target shares of tokens, sources and topics flattened ones."""
    return mixing.mix(docs, share=MIX_SHARE, power=MIX_POWER, targets=MIX_TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed best-fit."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", blot_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
