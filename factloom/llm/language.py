"""Language by string kernel: ridge regression over n-gram presence, with Nystroem landmarks.

The kernel of two texts is the number of n-grams (1 to ``LONGEST`` signs, of the
lower-cased text, what isn't a letter being one blank) that both hold, over the
geometric mean of what each holds: the blended spectrum, by presence.  N-grams
count as far as some landmark has them, each exactly, in a hash table that grows with them.  ``landmarks`` texts of each language span the
feature space, one ridge regression for each language (one against the rest) is solved
in it, and all of that is linear in the presence of n-grams, so that it folds into one
matrix of n-grams by languages: scoring is a product of a batch's presence matrix with it.

Learning takes a bounded sample, gathered in one pass: of each language ``rows`` texts, those of at most
``longest`` signs, in the order of a hash of the id (then the id, then the text); many languages
share ``texts`` texts, and no language goes without one, and ``marks`` landmarks, which need not be of every language.  A text that is null or has
no letter is ``und`` with score 0; so is every text where nothing could be learned.  Equal
scores go to the language that comes first by name; rows of one id, and equal texts, are judged each by its own text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, slices, small_batches

LONGEST = 3
#: Texts of one presence matrix.
ROWS = 64
BROADCAST_LANGUAGES = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bounds:
    """Of each language, texts to learn from, and landmarks among them; signs of a text; texts and landmarks of all languages."""

    rows: int = 400
    landmarks: int = 48
    longest: int = 20_000
    texts: int = 8_000
    marks: int = 1_000


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    grams: np.ndarray  # the n-grams that landmarks have
    weights: np.ndarray  # n-grams by languages


class Table:
    """The place of each known n-gram: open addressing, at most an eighth full."""

    def __init__(self, known: np.ndarray) -> None:
        self.width, self.bits = len(known), max(10, (8 * len(known)).bit_length())
        self.gram, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        left, at = np.arange(len(known)), self.slot(known)
        while len(left):
            free = self.gram[at] == 0
            self.gram[at[free]] = known[left[free]]  # of several one stays, the others go on
            placed = self.gram[at] == known[left]
            self.place[at[placed]] = left[placed]
            left, at = left[~placed], self.after(at[~placed])

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the n-grams are known, by index, and their places."""
        at = self.slot(gram)
        there = self.gram[at]
        hit = there == gram
        found, places = [np.flatnonzero(hit)], [self.place[at[hit]]]
        left = np.flatnonzero(~hit & (there != 0))
        at = at[left]
        while len(left):
            at = self.after(at)
            there = self.gram[at]
            hit = there == gram[left]
            found.append(left[hit])
            places.append(self.place[at[hit]])
            on = ~hit & (there != 0)
            left, at = left[on], at[on]
        return np.concatenate(found), np.concatenate(places)


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def signs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts in a row, a blank at either end of each; the text of each, and which texts have a letter."""
    lows = [" " + (t or "").lower() + " " for t in texts]
    code = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    low = code < 0x10000
    is_letter = np.where(low, letters()[np.where(low, code, 0).astype(np.int64)], True)
    any_letter = np.zeros(len(texts), bool)
    any_letter[owner[is_letter & low]] = True
    for i in np.unique(owner[~low]):
        any_letter[i] = any_letter[i] or any(c.isalpha() for c in lows[i])
    keep = is_letter | np.concatenate([[True], is_letter[:-1] | (owner[1:] != owner[:-1])])  # one blank of several
    return np.where(is_letter, code, np.uint64(32))[keep], owner[keep], any_letter


def grams(code: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, owners) for each n; 21 bits a sign."""
    out, gram = [], code
    for n in range(1, LONGEST + 1):
        if n > 1:
            gram = (gram[:-1] << np.uint64(21)) | code[n - 1 :]
        same = owner[: len(gram)] == owner[n - 1 :] if len(gram) else np.zeros(0, bool)
        out.append((gram[same], owner[: len(gram)][same]))
    return out


def presence(texts: list[str | None], table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Texts by known n-grams, whether it occurs; and which texts have a letter."""
    code, owner, any_letter = signs(texts)
    out = np.zeros(len(texts) * table.width, bool)
    for gram, own in grams(code, owner):
        hit, place = table.find(gram)
        out[own[hit] * table.width + place] = True
    return out.reshape(len(texts), -1), any_letter


def fit(rows: list[tuple[str, str]], landmarks: int, ridge: float = 1e-3, most: int = 1_000) -> Model:
    """Learn from (language, text) pairs; the first ``landmarks`` of each language are landmarks, ``most`` in all."""
    languages = sorted({k for k, _ in rows})
    taken: dict[str, int] = {}
    marks = []
    for k, text in rows:
        taken[k] = taken.get(k, 0) + 1
        if taken[k] <= landmarks and len(marks) < most:
            marks.append(text)
    code, owner, _ = signs(marks)
    known = np.concatenate([np.unique(g) for g, _ in grams(code, owner)])  # no n-gram is 0, nor equal to one of another length
    table = Table(known)

    def rowwise(texts: list[str]) -> np.ndarray:
        return np.concatenate([presence(texts[i : i + ROWS], table)[0] for i in range(0, len(texts), ROWS)]).astype(np.float32)

    def norm(p: np.ndarray) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(p.sum(1), 1))

    mark = rowwise(marks)
    mark *= norm(mark)[:, None]
    k_mm = (mark @ mark.T).astype(float)
    kernel = []
    for i in range(0, len(rows), 256):
        p = rowwise([t for _, t in rows[i : i + 256]])
        kernel.append((p @ mark.T) * norm(p)[:, None])
    k_nm = np.concatenate(kernel).astype(float)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_nm @ root
    y = np.where(np.array([k for k, _ in rows])[:, None] == np.array(languages), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(tuple(languages), known, (mark.T @ (root @ beta)).astype(np.float32))


def learn(docs: DataFrame, bounds: Bounds = Bounds()) -> Model | None:
    """Fit on rows of ``docs`` (``doc_id, text, lang``) outside fold 1 that have a language."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null").where(fold() != 1)
    rows = rows.where(F.length("text").between(1, bounds.longest)).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("at"))
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return None
    each, marks = max(1, min(bounds.rows, bounds.texts // languages)), max(1, min(bounds.landmarks, bounds.marks // languages))
    # Twice what is wanted of a language passes by its hash; of that the first are taken.
    few = counts.select("lang", F.least(F.lit(1.0), F.lit(2.0 * each + 20) / F.col("count")).alias("_part"))
    # Texts stay where they are unless there are more languages than a broadcast may hold.
    wide = rows.join(F.broadcast(few) if languages <= BROADCAST_LANGUAGES else few, "lang").where((F.col("at") / F.lit(2.0**64) + 0.5) < F.col("_part"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id", "text"))
    got = wide.withColumn("_turn", turn).where(F.col("_turn") <= each).orderBy("lang", "_turn").select("lang", "text").collect()
    return fit([(r.lang, r.text) for r in got], marks, most=bounds.marks) if got else None


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, best, table = [], np.zeros(len(texts)), Table(model.grams)
    sizes = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    for first, last in slices(sizes, 400_000):
        for a in range(first, last, ROWS):
            p, any_letter = presence(texts[a : min(a + ROWS, last)], table)
            held = p.sum(1)
            raw = (p.astype(np.float32) @ model.weights) / np.sqrt(np.maximum(held, 1))[:, None]
            top = raw.argmax(1)
            names += [model.languages[t] if ok else "und" for t, ok in zip(top, any_letter, strict=True)]
            best[a : a + len(p)] = np.where(any_letter, np.clip((raw.max(1) + 1) / 2, 0, 1), 0)
    return names, best


def predict(model: Model | None, text: str | Column = "text") -> Column:
    """A struct of the language and the score."""
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def kernel(texts: pd.Series) -> pd.DataFrame:
        names, best = predict_texts(model, texts.tolist())
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": best})

    return kernel(text)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, existing columns of those names replaced."""
    small_batches(docs.sparkSession)
    hit = docs.withColumn("__lang_hit", predict(model))
    return hit.withColumns({"lang_pred": F.col("__lang_hit.lang_pred"), "score": F.col("__lang_hit.score")}).drop("__lang_hit")
