"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, language, mixing, packing, quality, repeats, secrets, url_filter, vectors
from .common import held_out, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The contract's rules, and the engine's own list of hosts that are never wanted.
URL_RULES = [
    ("org", "/", "allow", "contract"),
    ("example.org", "/es/", "block", "contract"),
    ("example.org", "/en/1", "block", "contract"),
    ("com", "/fr/", "allow", "contract"),
    ("com", "/de/", "block", "contract"),
    ("adult-x.example.com", "/", "block", "method"),
    ("casino-win.example.net", "/", "block", "method"),
    ("ads-track.example.com", "/", "block", "method"),
]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs)
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


#: Target shares of tokens by language; other languages keep their own share of the rest, sources and forms are flattened.
MIX_TARGETS = {"lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}}


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.probabilities(table(spark, sf_dir, "documents"), share=0.7, power=0.7, targets=MIX_TARGETS)
    own = lambda c: F.col(f"{mixing.OWN}{c}")
    return found.select("doc_id", own("topic").alias("topic"), own("tokens").alias("n_tokens"), own("weight").alias("weight"), own("probability").alias("probability"), (mixing.draw() < own("probability")).alias("drawn"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string, source string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.ann_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_url_filter": op8_url_filter,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ann_search": op10_ann_search,
}
