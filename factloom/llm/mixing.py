"""Raking token weights to target marginals, and sampling documents by the calibrated probabilities.

Iterative proportional fitting works on the table of cells (source by language by
topic), not on documents: one pass counts documents and tokens of each cell, the cells'
weights are scaled to each marginal in turn until they agree, and each document is
drawn with its cell's probability, by a hash of its id.  Up to ``DRIVER_CELLS`` cells
(a checked bound) are fitted on the driver; beyond that the same fit runs as joins of
the cell table with one factor for each value of a margin, which are written in the shared folder.
Both scale until the worst gap of a margin is below ``TOLERANCE``, and warn where ``ROUNDS``
rounds do not get there (targets that the cells cannot meet together).

Nulls in a margin are a value of their own (``(null)``); null and empty texts hold no
token and are drawn with their cell; a cell without tokens has weight 1 and the
probability ``share``.  Targets are shares; values without a target
keep their own share, and those that the data lack are left out.  Repeated ids are drawn together.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, union

DRIVER_CELLS = 200_000
#: A fit ends where no margin's gap is wider, or after so many rounds, with a warning.
TOLERANCE, ROUNDS = 1e-9, 200
NULL = "(null)"
#: Columns of this prefix are the operator's own.
OWN = "__mix_"
MARGINS = ("source", "lang", "topic")


def tokens(text: str = "text") -> Column:
    """Words between blanks, by counting where they begin."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse topic, told by a whole text's form alone (table, contact, long form); pass another column as the margin where there is a better one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("!!"), "shout")
        .when(t.contains("://") | t.contains("@"), "contact")
        .when(F.length(t) >= 6000, "longform")
        .when(F.length(t) >= 1500, "article")
        .otherwise("note")
    )


def tempered(shares: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares flattened towards equal ones: each to ``power``, made to sum to 1."""
    raised = {k: max(v, 0.0) ** power for k, v in shares.items() if v > 0}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def completed(own: Mapping[str, float], target: Mapping[str, float]) -> dict[str, float]:
    """A target share for each value that occurs: the given ones, and what they leave in the data's own proportions."""
    given = {k: v for k, v in target.items() if own.get(k, 0) > 0}
    rest = {k: v for k, v in own.items() if k not in given and v > 0}
    left = max(0.0, 1 - sum(given.values())) if rest else 0.0
    out = given | {k: left * v / sum(rest.values()) for k, v in rest.items()}
    total = sum(out.values()) or 1.0
    return {k: v / total for k, v in out.items()}


def settled(worst: float, rounds: int, tolerance: float) -> None:
    """Say so where a fit ended before its margins were met."""
    if worst >= tolerance:
        warnings.warn(f"raking: after {rounds} rounds a margin is still off by {worst:.1e}", RuntimeWarning, stacklevel=3)


def rake(cells: pd.DataFrame, targets: Sequence[Mapping[str, float]], margins: Sequence[str] = MARGINS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fitted token shares of the cells (columns ``margins`` and ``tokens``)."""
    w = cells["tokens"].to_numpy(float)
    w = w / w.sum() if w.sum() else w
    coded = [pd.factorize(cells[m], sort=True) for m in margins]
    want = [np.array([t.get(v, 0.0) for v in values]) for (_, values), t in zip(coded, targets, strict=True)]
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for (code, values), goal in zip(coded, want, strict=True):
            have = np.bincount(code, w, len(values))
            worst = max(worst, float(np.abs(have - goal).max(initial=0)))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code]
        if worst < tolerance:
            break
    settled(worst, rounds, tolerance)
    return w


def scale(share: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """The factor by which ratios are multiplied, and cut at 1, to keep ``share`` of all tokens.

    ``sums`` gives, for a factor, the own shares of cells that it brings to 1 and the
    fitted shares of the others.  What is kept is concave in the factor, so that
    Newton's steps come from below and end, at last where all cells are at 1.
    """
    c = 0.0
    while True:
        full, rest = sums(c)
        step = (share - full) / rest if rest > 0 else c
        if step <= c * (1 + 1e-12):
            return c
        c = step


def keep_probability(own: np.ndarray, fitted: np.ndarray, share: float) -> np.ndarray:
    """Probabilities proportional to ``fitted / own``, at most 1, that keep ``share`` of all tokens (or as near as cells of probability 1 allow)."""
    ratio = np.divide(fitted, own, out=np.zeros_like(fitted), where=own > 0)

    def sums(c: float) -> tuple[float, float]:
        full = c * ratio >= 1
        return float(own[full].sum()), float((own * ratio)[~full].sum())

    return np.minimum(1, scale(share, sums) * ratio)


def goals_of(counted: DataFrame, total: float, name: str, power: float, target: Mapping[str, float] | None) -> DataFrame:
    """``margin, value, goal`` of one margin: what ``completed`` or ``tempered`` give, of cells beyond the driver."""
    own = counted.groupBy(F.col(name).alias("value")).agg((F.sum("tokens") / F.lit(total)).alias("own")).where("own > 0")
    if target:
        given = counted.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], "value string, given double")
        own = own.join(F.broadcast(given), "value", "left")
        sums = own.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("own")))).first()
        left, rest = max(0.0, 1 - (sums[0] or 0.0)), sums[1] or 1.0
        own = own.select("value", F.coalesce("given", F.col("own") * F.lit(left / rest)).alias("goal"))
    else:
        own = own.select("value", F.pow("own", F.lit(float(power))).alias("goal"))
    whole = own.agg(F.sum("goal")).first()[0] or 1.0
    return own.select(F.lit(name).alias("margin"), "value", (F.col("goal") / F.lit(whole)).alias("goal"))


def rake_cells(cells: DataFrame, total: float, targets: DataFrame, margins: Sequence[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same fit as joins, for cell tables beyond the driver: ``cells`` that hold tokens, with their fitted share ``w``.

    ``targets`` has ``margin, value, goal``.  A round rewrites only the logarithm of each value's factor.
    """
    goals = {m: targets.where(F.col("margin") == m).select(F.col("value").alias(m), F.col("goal").alias("_goal")) for m in margins}
    logs = {m: goals[m].select(m, F.lit(0.0).alias(f"_log{k}")) for k, m in enumerate(margins)}
    cells = cells.where("tokens > 0")

    def fitted() -> DataFrame:
        w = cells
        for m in margins:
            w = w.join(logs[m], m)
        return w.withColumn("w", F.col("tokens") / F.lit(total) * F.exp(sum((F.col(f"_log{k}") for k in range(1, len(margins))), F.col("_log0"))))

    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for k, m in enumerate(margins):
            have = fitted().groupBy(m, f"_log{k}").agg(F.sum("w").alias("_have")).join(goals[m], m)
            factor = F.when((F.col("_have") > 0) & (F.col("_goal") > 0), F.col(f"_log{k}") + F.log(F.col("_goal") / F.col("_have"))).otherwise(F.lit(float("-inf")))
            step = materialise(have.select(m, factor.alias(f"_log{k}"), F.abs(F.col("_have") - F.col("_goal")).alias("_gap")), "rake")
            worst = max(worst, step.agg(F.max("_gap")).first()[0] or 0.0)
            logs[m] = step.select(m, f"_log{k}")
        if worst < tolerance:
            break
    settled(worst, rounds, tolerance)
    return materialise(fitted().select(*cells.columns, "w"), "raked")


def probabilities(docs: DataFrame, share: float, power: float, targets: Mapping[str, Mapping[str, float]] | None = None, margins: Mapping[str, Column] | None = None) -> DataFrame:
    """``docs`` with the margins, ``tokens``, ``weight`` and ``probability`` of each row, their names prefixed by ``OWN``.

    Targets are, where not given, the data's own shares tempered by ``power``.
    ``share`` is the part of all tokens to draw.
    """
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic()}
    names = [f"{OWN}{m}" for m in margins]
    marked = docs.withColumns({f"{OWN}{m}": F.coalesce(c.cast("string"), F.lit(NULL)) for m, c in margins.items()} | {f"{OWN}tokens": tokens()})
    counted = marked.groupBy(*names).agg(F.sum(f"{OWN}tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    counted = materialise(counted, "cells")
    if counted.count() <= DRIVER_CELLS:
        cells = counted.orderBy(*names).toPandas()
        goals = []
        for m in margins:
            own = cells.groupby(f"{OWN}{m}")["tokens"].sum().astype(float).to_dict()
            total = sum(own.values()) or 1
            own = {k: v / total for k, v in own.items()}
            goals.append(completed(own, (targets or {}).get(m) or tempered(own, power)))
        fitted = rake(cells, goals, names)
        own = cells["tokens"].to_numpy(float)
        own = own / own.sum() if own.sum() else own
        p = np.where(own > 0, keep_probability(own, fitted, share), share)
        cells[f"{OWN}weight"], cells[f"{OWN}probability"] = np.divide(fitted, own, out=np.ones_like(own), where=own > 0), p
        fit = docs.sparkSession.createDataFrame(list(cells[[*names, f"{OWN}weight", f"{OWN}probability"]].itertuples(index=False, name=None)), ", ".join(f"{n} string" for n in names) + f", {OWN}weight double, {OWN}probability double")
        return marked.join(F.broadcast(fit), names)  # at most DRIVER_CELLS rows
    total = float(counted.agg(F.sum("tokens")).first()[0] or 1)
    goals = materialise(union(goals_of(counted, total, f"{OWN}{m}", power, (targets or {}).get(m)) for m in margins), "goals")
    own, weight = F.col("tokens") / F.lit(total), F.col("w") / (F.col("tokens") / F.lit(total))
    raked = rake_cells(counted, total, goals, names)

    def sums(c: float) -> tuple[float, float]:
        full = F.lit(c) * weight >= 1
        got = raked.agg(F.sum(F.when(full, own)), F.sum(F.when(~full, own * weight))).first()
        return got[0] or 0.0, got[1] or 0.0

    high = scale(share, sums)
    fit = raked.select(*names, weight.alias(f"{OWN}weight"), F.least(F.lit(1.0), F.lit(high) * weight).alias(f"{OWN}probability"))
    bare = counted.where("tokens = 0").select(*names, F.lit(1.0).alias(f"{OWN}weight"), F.lit(float(share)).alias(f"{OWN}probability"))
    return marked.join(fit.unionByName(bare), names)


def draw(key: str = "doc_id", seed: int = 20) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(docs: DataFrame, share: float = 0.7, power: float = 0.7, targets: Mapping[str, Mapping[str, float]] | None = None, key: str = "doc_id") -> DataFrame:
    """The documents drawn, with their own columns."""
    found = probabilities(docs, share, power, targets)
    return found.where(draw(key) < F.col(f"{OWN}probability")).select(*docs.columns)
