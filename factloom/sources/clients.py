"""Model clients behind a cache: what was asked once is not asked again."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 100
LEAST_INTERVAL, ATTEMPTS = 4.5, 5
RETRY = (429, 500, 503)


class Completer(Protocol):
    model: str

    def __call__(self, prompt: str) -> str: ...


class Embedder(Protocol):
    model: str
    dims: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Overloaded(RuntimeError):
    """A model that can't answer now."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


class Throttled:
    """A completer that waits between calls, repeats failed ones with growing pauses, and falls back to another model."""

    def __init__(self, first: Completer, fallback: Completer | None = None, interval: float = LEAST_INTERVAL, sleep: Callable[[float], None] = time.sleep) -> None:
        self.first, self.fallback, self.interval, self.sleep, self.last = first, fallback, interval, sleep, 0.0
        self.model = first.model

    def _asked(self, client: Completer, prompt: str) -> str:
        for turn in range(ATTEMPTS):
            self.sleep(max(0.0, self.last + self.interval - time.monotonic()))
            self.last = time.monotonic()
            try:
                return client(prompt)
            except Overloaded as e:
                if e.status not in RETRY or turn == ATTEMPTS - 1:
                    raise
                self.sleep(5 * 2**turn)
        raise AssertionError

    def __call__(self, prompt: str) -> str:
        try:
            return self._asked(self.first, prompt)
        except Overloaded as e:
            if self.fallback is None or e.status not in (429, 503):
                raise
            return self._asked(self.fallback, prompt)


class HashedEmbedder:
    """A deterministic stand-in: character trigrams hashed to a few dimensions, of unit length."""

    def __init__(self, dims: int = 64) -> None:
        self.dims, self.model = dims, f"hashed-{dims}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dims)
            low = f"  {text.lower()} "
            for i in range(len(low) - 2):
                d = hashlib.blake2b(low[i : i + 3].encode(), digest_size=4).digest()
                v[int.from_bytes(d[:3], "little") % self.dims] += 1 if d[3] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def completion_key(model: str, body: Column) -> Column:
    """The name of an answer: a digest of the model and what it was asked, a length between them so that no two run together."""
    return F.sha2(F.concat(F.lit(f"{len(model)}|{model}|"), body), 256)


def load_env(path: str) -> None:
    """Settings ``NAME=value`` of a file, where the environment lacks them."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, found, value = line.strip().partition("=")
                if found and not name.startswith("#"):
                    os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def embedded(texts: DataFrame, cache: DataFrame, embed: Embedder, column: str = "form") -> tuple[DataFrame, DataFrame]:
    """(``column, vec`` of the distinct texts, rows to add to the cache)."""
    model, dims = embed.model, embed.dims
    keyed = texts.select(column).where(F.col(column).isNotNull()).distinct().withColumn("key", F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dims)), column), 256))
    known = cache.where((F.col("model") == model) & (F.col("dims") == dims)).select("key", "vec")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                asked = part[column].tolist()
                yield pd.DataFrame({column: pd.Series(asked, dtype=object), "key": pd.Series(part["key"].tolist(), dtype=object), "vec": embed(asked)})

    fresh = keyed.join(known, "key", "left_anti").select(column, "key").mapInPandas(run, f"{column} string, key string, vec array<float>")
    found = keyed.join(known, "key").select(column, "vec").unionByName(fresh.select(column, "vec"))
    return found, fresh.select("key", F.lit(model).alias("model"), F.lit(dims).alias("dims"), "vec")


def completed(prompts: DataFrame, cache: DataFrame, complete: Completer, column: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(``column, response, error`` of the distinct prompts, rows to add to the cache); a failing prompt gives an error and not an exception."""
    model = complete.model
    keyed = prompts.select(column).distinct().withColumn("key", completion_key(model, F.col(column)))
    known = cache.where(F.col("model") == model).select("key", "response")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(prompt: str) -> tuple[str | None, str | None]:
            try:
                return complete(prompt), None
            except Exception as e:  # noqa: BLE001  the boundary to a service: its errors are data
                return None, f"{type(e).__name__}: {e}"[:500]

        for batch in batches:
            prompts = batch[column].tolist()
            answers = [ask(p) for p in prompts]
            columns = {column: prompts, "key": batch["key"].tolist(), "response": [a[0] for a in answers], "error": [a[1] for a in answers]}
            yield pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})

    fresh = keyed.join(known, "key", "left_anti").select(column, "key").mapInPandas(run, f"{column} string, key string, response string, error string")
    found = keyed.join(known, "key").select(column, "response", F.lit(None).cast("string").alias("error")).unionByName(fresh.select(column, "response", "error"))
    new = fresh.where("error is null").select("key", F.lit(model).alias("model"), "response", F.current_timestamp().alias("created_at"))
    return found, new
