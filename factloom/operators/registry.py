"""Entity and predicate registries: surface forms clustered greedily, most frequent first.

A form may only join a cluster whose first form has the same digits (and, for
entities, the same identifying words).  These are equivalence classes, so the greedy
loop runs by class, in parallel, and gives what one loop over all forms would; ids follow
the global order of the clusters' first forms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import content_tokens, digit_runs
from ..functions.units import unit_class
from ..scratch import written

ENTITY_TAU, PREDICATE_TAU = 0.82, 0.78


def surface_forms(facts: DataFrame, column: str) -> DataFrame:
    """``form, n, units``: each non-empty form, its facts and the classes of their units."""
    forms = facts.where(F.col(column) != "").groupBy(F.col(column).alias("form"))
    return forms.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(unit_class(F.col("unit")))).alias("units"))


def may_merge(units_a: set[str], units_b: set[str]) -> bool:
    """The unit gate; ``unknown`` is no objection.  The gates of digits and words are the classes."""
    a, b = units_a - {"unknown"}, units_b - {"unknown"}
    return not a or not b or bool(a & b)


def clustered(rows: pd.DataFrame, tau: float) -> pd.DataFrame:
    """``rows`` (``form, n, units, vec`` in global order) with the first form of the cluster that each joins, and its centroid."""
    vectors = np.stack([np.asarray(v, np.float32) for v in rows["vec"]])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(norms == 0, 1, norms)
    units = [set(u) for u in rows["units"]]
    centroids = np.zeros_like(vectors)
    first: list[int] = []
    weight: list[int] = []
    own = []
    for i, n in enumerate(rows["n"]):
        sims = centroids[: len(first)] @ vectors[i]
        best = next((int(k) for k in np.argsort(-sims, kind="stable") if may_merge(units[i], units[first[k]])), None)
        if best is not None and sims[best] >= tau:
            mean = centroids[best] * weight[best] + vectors[i] * n
            size = np.linalg.norm(mean)
            centroids[best] = mean / (size if size else 1)
            weight[best] += n
        else:
            best = len(first)
            centroids[best] = vectors[i]
            first.append(i)
            weight.append(n)
        own.append(best)
    return rows.assign(canonical=[rows["form"].iloc[first[k]] for k in own], canonical_rank=[rows["rank"].iloc[first[k]] for k in own], centroid=[centroids[k].tolist() for k in own])


def numbered(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """``df`` with ``column``, the place of a row among all in an order without ties, from 1: a sort by ranges, and an offset for each of them."""
    placed = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), column)
    starts, total = [], 0
    for part, n in sorted(placed.groupBy("_range").count().collect()):  # a row for each range
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_range").withColumn(column, F.col("_before") + within).drop("_range", "_before")


def build(forms: DataFrame, vectors: DataFrame, kind: str, tau: float) -> DataFrame:
    """``form, id, canonical, n, rank, centroid`` of every form; ``vectors`` has ``form, vec``.

    Equal similarities go to the older cluster, equal frequencies to the smaller form.
    """
    ranked = numbered(forms, "rank", F.desc("n"), F.asc("form"))
    klass = F.array_join(digit_runs(F.col("form")), " ")
    if kind == "entity":
        klass = F.concat_ws("\x01", klass, F.array_join(content_tokens(F.col("form")), " "))
    ready = ranked.join(vectors, "form").withColumn("klass", klass)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = clustered(rows.sort_values("rank", kind="stable").reset_index(drop=True), tau)
        return out[["form", "n", "rank", "canonical", "canonical_rank", "centroid"]]

    assigned = ready.groupBy("klass").applyInPandas(run, "form string, n long, rank long, canonical string, canonical_rank long, centroid array<float>")
    # Written: the loop runs once, for the numbers of the clusters and for their members.
    assigned = written(assigned, "assigned")
    firsts = numbered(assigned.select("canonical_rank").distinct(), "number", F.asc("canonical_rank"))
    ids = firsts.select("canonical_rank", F.format_string("%s_%04d", F.lit(kind[:3]), F.col("number") - 1).alias("id"))
    return assigned.join(ids, "canonical_rank").select("form", "id", "canonical", "n", "rank", "centroid")


def registry(assigned: DataFrame, kind: str) -> DataFrame:
    """The registry table of one kind."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("rank", "form"))), lambda x: x["form"])
    return assigned.groupBy("id", "canonical").agg(members.alias("surface_forms"), F.first("centroid").alias("centroid"), F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "id", "canonical", "surface_forms", "centroid", "n")


def backfilled(facts: DataFrame, assigned: DataFrame, column: str, target: str) -> DataFrame:
    """``facts`` with ``target`` set to the id of the form in ``column``; empty forms stay null."""
    ids = assigned.select(F.col("form").alias(column), F.col("id").alias(target))
    return facts.drop(target).join(ids, column, "left")
