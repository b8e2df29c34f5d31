"""The cell grid: a cell's facts over the two qualifiers that vary most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import CELL, key_spread

NONE = "—"


def axes(facts: DataFrame, most: int = 2) -> DataFrame:
    """``entity_id, predicate_id, axis, k, n_values``: discriminating keys by number of values, then name; the first ``most``."""
    order = Window.partitionBy(*CELL).orderBy(F.desc("n_values"), "k")
    ranked = key_spread(facts).where("discriminating").withColumn("axis", F.row_number().over(order))
    return ranked.where(F.col("axis") <= most).select(*CELL, "axis", "k", "n_values")


def grid(facts: DataFrame) -> DataFrame:
    """Each prepared fact with ``row_key, col_key, row_val, col_val`` and whether its square is in ``conflict``.

    A square is in conflict when its values span more than twice the largest tolerance of the whole grid.
    """
    chosen = axes(facts).groupBy(*CELL).agg(F.max(F.when(F.col("axis") == 1, F.col("k"))).alias("row_key"), F.max(F.when(F.col("axis") == 2, F.col("k"))).alias("col_key"))
    placed = facts.join(chosen, list(CELL), "left")

    def at(key: str):
        stated = F.element_at(F.filter("pairs", lambda q: q["key"] == F.col(key)), -1)["value"]
        has = F.exists("pairs", lambda q: q["key"] == F.col(key))
        return F.when(F.coalesce(has, F.lit(False)), stated).otherwise(F.lit(NONE))

    placed = placed.withColumns({"row_val": at("row_key"), "col_val": at("col_key")})
    spans = placed.groupBy(*CELL, "row_val", "col_val").agg(F.count("norm.value").alias("n"), (F.max("norm.value") - F.min("norm.value")).alias("span"))
    tolerance = facts.groupBy(*CELL).agg(F.coalesce(F.max("norm.tolerance"), F.lit(0.0)).alias("most"))
    squares = spans.join(tolerance, list(CELL)).select(*CELL, "row_val", "col_val", ((F.col("n") > 1) & (F.coalesce("span", F.lit(0.0)) > 2 * F.col("most"))).alias("conflict"))
    return placed.join(squares, [*CELL, "row_val", "col_val"])


def summary(facts: DataFrame) -> DataFrame:
    """A row for each grid: its axes, the sorted values of both, and the number of facts."""
    return grid(facts).groupBy(*CELL, "row_key", "col_key").agg(
        F.sort_array(F.collect_set("row_val")).alias("rows"), F.sort_array(F.collect_set("col_val")).alias("cols"), F.count(F.lit(1)).alias("n_facts")
    )


def candidates(facts: DataFrame, registry: DataFrame, most: int = 40) -> DataFrame:
    """Cells of several valued facts, by documents, then facts; with the registry's names."""
    valued = facts.where("entity_id is not null and value is not null")
    counted = valued.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")
    top = counted.orderBy(F.desc("docs"), F.desc("n"), *CELL).limit(most)

    def named(kind: str) -> DataFrame:
        return registry.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("canonical").alias(kind))

    return top.join(named("entity"), "entity_id", "left").join(named("predicate"), "predicate_id", "left")
