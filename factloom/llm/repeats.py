"""Removal of repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

Winnowing with rolling hashes, in place of prefix doubling: strings are named by 64-bit hashes, which a task
computes by itself, so there are no ranks and no rounds of sorting; a shuffle by name finds
which names are shared, and positions whose name is unique go no further:

1. At ``SEED`` bytes only elected positions are shuffled.  Each 100-byte window
   elects the smallest seed name in it (the leftmost of equal ones).  Equal windows elect the same name
   at the same offset, so windows need comparing only where they share it; consecutive
   windows of one elected position travel together, as a *run* with the name of all its bytes.
2. Runs that are equal to an earlier one are covered altogether.  Where runs of one
   elected name differ, the earliest of each kind is *contested*.
3. Contested runs bring their bytes, every window in them is named at 100 bytes, and all
   but the earliest of a name are covered.

Positions are ordered by document id and start; matches never cross documents.  Null texts count as
empty, a null id comes before all others.  Rows of one id are one document: equal
starts in them cover nothing.  Texts of any length are worked on in pieces of ``CHUNK`` bytes, which overlap so that no
window is lost; a run that ends with a piece is compared window by window where its copies end elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_filter, lean, materialise, partitions, passing, ranges, slices, small_batches, text_bytes
from .shingles import mixed

LENGTH, SEED = 100, 32
WINDOW = LENGTH - SEED + 1
CHUNK = 500_000
#: Bytes of a piece of a long text.
PIECE = 4_000_000
PLACE_BITS = np.uint64(28)
ROOT = np.uint64(0xD6E8FEB86659FD93)
ROOT_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
BYTE = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: Contested runs of one name above which each of their windows travels by itself.
CROWD = 2_000
#: Partitions of contested runs for one of runs: a task holds some 80 bytes for each window, of which a byte of text starts one.
SPREAD = 4
LOWEST = -(2**63)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((ROOT, ROOT_INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


class Names:
    """Names of the substrings of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def seeds(self) -> np.ndarray:
        n = len(self.prefix) - SEED
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.prefix[SEED:] - self.prefix[:n]) * self.down[:n] + np.uint64(SEED))

    def windows(self, start: np.ndarray) -> np.ndarray:
        """Names of ``LENGTH`` bytes, each of the names of four seeds that cover it."""
        seed = self.seeds()
        pair = lambda x, y: mixed(x * ROOT + y)
        gap = LENGTH - 2 * SEED
        return pair(pair(seed[start], seed[start + SEED]), pair(seed[start + gap], seed[start + gap + SEED]))


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of windows with one elected position, of texts in a row: ``doc`` (which text), ``name``, ``place`` of the
    elected position, ``first`` and ``last`` window start (in the text), and ``whole``, the name of all bytes of the run."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return {"doc": none, "name": none.astype(np.uint64), "place": none, "first": none, "last": none, "whole": none.astype(np.uint64)}
    names = Names(data)
    seed = names.seeds()
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # A seed that crosses the end of its text is never part of a window that doesn't.
    low = ((seed >> PLACE_BITS) << PLACE_BITS) | np.arange(len(seed), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = WINDOW - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    start = np.arange(n - LENGTH + 1)
    valid = doc[: n - LENGTH + 1] == doc[LENGTH - 1 :]
    start, elected = start[valid], (low[valid] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    if not len(start):
        return runs(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    new = np.flatnonzero(np.concatenate([[True], elected[1:] != elected[:-1]]))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    place, own = elected[new], doc[first]
    base = offsets[own]
    return {"doc": own, "name": seed[place], "place": place - base, "first": first - base, "last": last - base, "whole": names.of(first, last + LENGTH)}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, bytes, offsets, where the bytes begin in it): several texts whole, or a part of a long one."""
    for a, b in slices(offsets, CHUNK):
        at = offsets[a : b + 1]
        size = int(at[-1] - at[0])
        if b - a > 1 or size <= PIECE + LENGTH:
            yield a, data[at[0] : at[-1]], at - at[0], 0
            continue
        for start in range(0, size - LENGTH + 1, PIECE):
            part = data[at[0] + start : min(at[0] + start + PIECE + LENGTH - 1, at[-1])]
            yield a, part, np.array([0, len(part)]), start


def _sampled(docs: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            key, twin = (batch.column(k).to_numpy() for k in (0, 1))
            for a, part, at, begin in _pieces(data, offsets):
                r = runs(part, at)
                doc, place, before, more = key[a + r["doc"]], r["place"] + begin, r["place"] - r["first"], r["last"] - r["first"]
                # Of equal runs in a chunk the earliest stands for all; the others are covered already and go anywhere but to its group.
                same = mixed(r["name"] + _kind(r["whole"], before, more))
                order = np.lexsort((place, doc, same))
                new = _starts(same[order])
                earliest = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                covered = np.zeros(len(order), bool)
                covered[order] = (doc[order] != doc[earliest]) | (place[order] != place[earliest])
                name = np.where(covered, mixed(same + np.arange(len(same), dtype=np.uint64)), r["name"])
                yield pa.RecordBatch.from_arrays(
                    [_signed(name), pa.array(doc), pa.array(twin[a + r["doc"]]), pa.array(place.astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(more.astype(np.int16)), _signed(r["whole"]), pa.array(covered)],
                    names=["name", "doc", "twin", "place", "before", "more", "whole", "covered"],
                )

    return docs.select("doc", "twin", "text").mapInArrow(run, "name long, doc long, twin long, place int, before short, more short, whole long, covered boolean")


def _kind(whole: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A name for all that equal runs of one elected name have in common."""
    return mixed(whole.view(np.uint64) + (before.astype(np.uint64) << np.uint64(8)) + more.astype(np.uint64))


def _read(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return {k: t.column(k).to_numpy(zero_copy_only=False) for k in t.column_names}


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


RUNS = "doc long, twin long, first int, last int, place int, name long, crowded boolean, contested boolean"


def _run_batch(x: dict[str, np.ndarray], crowded: np.ndarray, contested: np.ndarray) -> pa.RecordBatch:
    first = x["place"] - x["before"]
    cols = (x["doc"], x["twin"], first, first + x["more"], x["place"], x["name"], crowded, contested)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in RUNS.split(", ")])


def _compare_runs(sampled: DataFrame, parts: int) -> DataFrame:
    """Runs that are covered, or contested; those of unique names are gone."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _read(batches)
        if x is None:
            return
        known = np.flatnonzero(x["covered"])
        yield _run_batch({k: v[known] for k, v in x.items()}, np.zeros(len(known), bool), np.zeros(len(known), bool))
        x = {k: v[~x["covered"]] for k, v in x.items()}
        kind = _kind(x["whole"], x["before"], x["more"])
        order = np.lexsort((x["place"], x["doc"], kind, x["name"]))
        x, kind = {k: v[order] for k, v in x.items()}, kind[order]
        by_name, by_kind = _starts(x["name"]), _starts(x["name"], kind)
        name_of, kind_of = np.cumsum(by_name) - 1, np.cumsum(by_kind) - 1
        earliest = np.flatnonzero(by_kind)[kind_of]
        covered = (x["doc"] != x["doc"][earliest]) | (x["place"] != x["place"][earliest])
        kinds = np.bincount(name_of[by_kind])
        contested = ~covered & (kinds[name_of] > 1)
        keep = covered | contested
        yield _run_batch({k: v[keep] for k, v in x.items()}, (kinds[name_of] > CROWD)[keep], contested[keep])

    return sampled.repartition(parts, "name").mapInArrow(run, RUNS)


def _split(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with ``wanted``: whether the document may be among those of the given rows."""
    bits = id_filter(wanted.select(F.xxhash64("doc", "twin").alias("at")), "at")
    return docs.withColumn("wanted", passing(docs, bits, F.xxhash64("doc", "twin")))


def _intervals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "twin").agg(F.collect_list(F.struct("first", "last")).alias("found"))


def _windows(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """``key`` (a run's elected name; a crowded window's own name), ``offset``, ``doc, twin, first`` and the bytes of each contested run."""
    listed = contested.groupBy("doc", "twin").agg(F.collect_list(F.struct("first", "last", "place", "name", "crowded")).alias("runs"))
    joined = _split(docs, contested).where("wanted").select("doc", "twin", "text").join(listed, ["doc", "twin"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            lists = batch.column(3)
            flat, owner = lists.flatten(), np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            first, last, place, name, crowded = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            doc, twin = batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner]
            at = offsets[:-1][owner] + first
            size = last - first + LENGTH
            for a, b in slices(np.concatenate([[0], np.cumsum(size)]), CHUNK):
                own = data[ranges(at[a:b], size[a:b])]
                ends = np.concatenate([[0], np.cumsum(size[a:b])])
                plain = np.flatnonzero(~crowded[a:b])
                strings = [own[ends[i] : ends[i + 1]].tobytes() for i in plain]
                p = a + plain
                yield _window_batch(name[p], (place - first)[p], doc[p], twin[p], first[p], strings)
                many = np.flatnonzero(crowded[a:b])
                if len(many):
                    names = Names(own)
                    count = size[a:b][many] - LENGTH + 1
                    start = ranges(ends[many], count)
                    m = np.repeat(a + many, count)
                    offset = start - np.repeat(ends[many], count)
                    back = (place - first)[m] - offset
                    key = mixed(names.windows(start) + mixed(name[m].view(np.uint64) + back.astype(np.uint64)))
                    yield _window_batch(key.view(np.int64), back, doc[m], twin[m], first[m] + offset, [b""] * len(m))

    return joined.mapInArrow(run, WINDOWS)


WINDOWS = "key long, back int, doc long, twin long, first int, bytes binary"


def _window_batch(key, back, doc, twin, first, strings) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(back.astype(np.int32)), pa.array(doc), pa.array(twin), pa.array(first.astype(np.int32)), pa.array(strings, pa.binary())], names=[c.split()[0] for c in WINDOWS.split(", ")])


def _compare_windows(windows: DataFrame, parts: int) -> DataFrame:
    """``doc, twin, first, last``: ranges of starts of windows that also start earlier."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, back, doc, twin, first = (t.column(k).to_numpy() for k in ("key", "back", "doc", "twin", "first"))
        strings = pa.concat_arrays([c.cast(pa.large_binary()) for c in t.column("bytes").chunks])
        offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        count = np.where(size > 0, size - LENGTH + 1, 1)
        row = np.repeat(np.arange(len(key)), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        plain = size[row] > 0
        names = np.zeros(len(row), np.uint64)
        if plain.any():
            at = offsets[:-1][row[plain]] + offset[plain]
            for a in range(0, len(at), CHUNK):  # strings lie in a row, so a stretch of them is one array
                part = at[a : a + CHUNK]
                names[np.flatnonzero(plain)[a : a + CHUNK]] = Names(data[part[0] : part[-1] + LENGTH]).windows(part - part[0])
            names[plain] = mixed(names[plain] + mixed(key[row[plain]].view(np.uint64) + (back[row[plain]] - offset[plain]).astype(np.uint64)))
        names[~plain] = key[row[~plain]].view(np.uint64)
        start = first[row].astype(np.int64) + offset
        order = np.lexsort((start, doc[row], names))
        new = _starts(names[order])
        earliest = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        covered = np.zeros(len(row), bool)
        covered[order] = (doc[row][order] != doc[row][earliest]) | (start[order] != start[earliest])
        row, start = row[covered], start[covered]
        if not len(row):
            return
        begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
        end = np.append(begin[1:], len(row)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[row[begin]]), pa.array(twin[row[begin]]), pa.array(start[begin].astype(np.int32)), pa.array(start[end].astype(np.int32))], names=["doc", "twin", "first", "last"])

    return windows.repartition(parts, "key").mapInArrow(run, "doc long, twin long, first int, last int")


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that ranges of window starts cover."""
    out: list[list[int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + LENGTH)
        else:
            out.append([first, last + LENGTH])
    return [(a, b) for a, b in out]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@lean
def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = text or b""
            spans = merged([(f["first"], f["last"]) for f in found or []])
            kept, end = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[end:a])
                end = b
            kept.update(data[end:])
            rows.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", *(c.split()[0] for c in RESULT.split(", "))])


def covered_ranges(docs: DataFrame) -> DataFrame:
    """``doc, twin, first, last`` of all ranges of window starts that are covered; ``docs`` has ``doc, twin, text``."""
    parts = partitions(docs)
    found = materialise(_compare_runs(_sampled(docs), parts), "runs")
    contested = found.where("contested")
    windows = materialise(_compare_windows(_windows(docs, contested), SPREAD * parts), "windows")
    return found.where("not contested").select("doc", "twin", "first", "last").unionByName(windows)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("doc"))
    repeated = ids.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    # Rows that share an id are told apart by their text.
    twin = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("doc"), twin.alias("twin"), F.col(text).alias("text"))
    found = covered_ranges(keyed)
    split = _split(keyed, found)
    clean = split.where("not wanted").select("doc_id", "text", F.lit(None).cast("array<struct<first:int,last:int>>").alias("found"))
    touched = split.where("wanted").join(_intervals(found), ["doc", "twin"], "left").select("doc_id", "text", "found")
    result = f"doc_id long, {RESULT}"
    return clean.mapInArrow(_apply, result).unionByName(touched.mapInArrow(_apply, result))
