"""Quality by compression: how much better a dictionary of good text compresses a document than one of bad text.

Two zstandard dictionaries are built, of good and of bad labelled texts.  A text is
cut in blocks, so that a dictionary counts as much at the end of a long text as at
its start, and compressed with either.  The normalised difference of the two compressed
sizes is all that counts; isotonic regression on other labelled rows, each class
weighted to its share of all labels, makes it a score.

Learning takes a bounded sample of the labelled rows (``Bounds``), in the order of
a hash of the id.  An id with both labels is left out; of several rows of one id
the shortest text counts (then the smallest).  Null texts count as empty; those, like any text, get the score
that the calibration gives, so equal texts have equal scores.  Where one of the labels has no row to learn from,
every score is the share of good labels, or 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches

BLOCK = 1024
#: Rows of the common mean in each step of the calibration.
PRIOR_ROWS = 4.0
LEVEL = 3


@dataclass(frozen=True)
class Bounds:
    """What learning reads at most: labelled rows of a class, and bytes of their texts for the dictionary and the calibration."""

    rows: int = 4_000
    dictionary_bytes: int = 3_000_000
    calibration_bytes: int = 6_000_000
    dictionary_size: int = 262_144


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    at: tuple[float, ...]  # size differences, growing, and the score of each
    value: tuple[float, ...]
    constant: float | None = None


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


class Sizes:
    """The normalised difference of a text's compressed sizes under the two dictionaries: positive where the good one does better."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        import zstandard as zs

        kw = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.both = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d), **kw) for d in (bad, good)]

    def difference(self, text: str | None) -> float:
        parts = blocks(text)
        bad, good = (sum(len(c.compress(p)) for p in parts) for c in self.both)
        return (bad - good) / (bad + good)


def dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; of texts too few to train one, their own bytes."""
    import zstandard as zs

    samples = [b for t in texts for b in blocks(t) if b]
    try:
        return zs.train_dictionary(size, samples, k=200, d=8, level=LEVEL).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b" " * 8


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to ``y``, by pooling adjacent violators: both ends of each step and its value.

    Each step also holds ``prior`` rows of the common mean, which counts where there are few rows.
    """
    order = np.argsort(x, kind="stable")
    at, first = np.unique(x[order], return_index=True)  # equal differences have one score
    total = np.add.reduceat(weight[order], first)
    mean = np.add.reduceat((weight * y)[order], first) / total
    steps: list[list[float]] = []  # first, last, weight, value
    for a, w, v in zip(at, total, mean, strict=True):
        steps.append([a, a, w, v])
        while len(steps) > 1 and steps[-2][3] >= steps[-1][3]:
            _, last, w1, v1 = steps.pop()
            step = steps[-1]
            step[1], step[2], step[3] = last, step[2] + w1, (step[2] * step[3] + w1 * v1) / (step[2] + w1)
    rows = np.array([s[2] for s in steps]) * len(x) / weight.sum()
    value = (rows * [s[3] for s in steps] + prior * np.average(y, weights=weight)) / (rows + prior)
    return np.array([e for s in steps for e in s[:2]]), np.repeat(np.maximum.accumulate(value), 2)


def learn(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fit on rows of ``labels`` (``doc_id, quality``) outside fold 1, with the texts of ``docs``."""
    spark = docs.sparkSession
    train = labels.where("doc_id is not null and quality in (0, 1)").where(fold() != 1).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    train = train.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality", F.xxhash64("doc_id").alias("at"))
    # The first rows of each class by hash: a top-k of ids, then their sizes, then the texts that fit.
    ids = [train.where(F.col("quality") == q).orderBy("at", "doc_id").limit(bounds.rows).collect() for q in (0, 1)]
    known = {r.doc_id: (r.quality, r.at) for q in ids for r in q}
    counts = [len(q) for q in ids]
    if not all(counts):
        return Model(b"", b"", (), (), counts[1] / sum(counts) if sum(counts) else 0.5)
    total = dict(train.groupBy("quality").count().collect())
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    wanted = spark.createDataFrame([(k,) for k in known], "doc_id long")
    sizes = dict(texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.octet_length("text"))).collect())
    chosen: dict[int, str] = {}
    for q in (0, 1):
        room = {"dictionary": bounds.dictionary_bytes, "calibration": bounds.calibration_bytes}
        for k, doc in enumerate(r.doc_id for r in ids[q] if r.doc_id in sizes):
            part = "calibration" if k % 3 else "dictionary"
            if sizes[doc] <= room[part]:
                room[part] -= sizes[doc]
                chosen[doc] = part
    if not chosen:
        return Model(b"", b"", (), (), counts[1] / sum(counts))
    picked = spark.createDataFrame([(k, sizes[k]) for k in chosen], "doc_id long, size int")
    got = sorted(texts.join(F.broadcast(picked), "doc_id").where("octet_length(text) = size").groupBy("doc_id").agg(F.min("text")).collect(), key=lambda x: known[x[0]][1])
    made = [dictionary([t for d, t in got if chosen[d] == "dictionary" and known[d][0] == q], bounds.dictionary_size) for q in (0, 1)]
    sized = Sizes(*made)
    fit = [(d, t) for d, t in got if chosen[d] == "calibration"] or got
    x, y = np.array([sized.difference(t) for _, t in fit]), np.array([known[d][0] for d, _ in fit], float)
    # Classes were sampled to a bound each; each weighs what all its labels do.
    share = [total[q] / max(1, (y == q).sum()) for q in (0, 1)]
    at, value = isotonic(x, y, np.where(y == 1, share[1], share[0]), PRIOR_ROWS)
    return Model(*made, tuple(at.tolist()), tuple(value.tolist()))


def score(model: Model, text: str | Column = "text") -> Column:
    """The score of a text, 0 to 1."""
    if model.constant is not None:
        return F.lit(float(model.constant))

    @F.pandas_udf("double")
    def compressed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sized = Sizes(model.bad, model.good)
        for texts in batches:
            yield pd.Series(np.interp([sized.difference(t) for t in texts], model.at, model.value), dtype=float)

    return compressed(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, existing columns of those names replaced."""
    small_batches(docs.sparkSession)
    return docs.withColumn("score", score(model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
