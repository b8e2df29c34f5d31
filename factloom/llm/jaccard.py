"""Near-duplicate documents: an exact join of shingle sets by Jaccard similarity, size-aware.

Copies first: sets are named by a digest, and only distinct sets take part further.

*Small sets* (up to a size that a cost comparison chooses) enumerate their subsets of the size that two
sets must share to be linked; whoever meets in a subset shares it, so sets that are
small enough for it are linked, each to the smallest one there.  Subsets are known by hashes, so the links are confirmed on the sets.

*Large sets* put a prefix of their shingles in inverted lists, rare shingles first.  Two
linked sets share a shingle of their prefixes, and moreover so many that what is left of either
could not make up for fewer: pairs are counted over the lists, and only those with
enough in common are compared.  How often shingles occur in prefixes is counted over all
documents; those above ``HEAVY`` are *heavy*, go last in the order, and their lists
are not paired out (tasks know them by a table of at most ``SLOTS_MOST`` slots; what shares a slot with
a heavy shingle is treated as one, which changes the work and no link): a list first meets its own most typical member (a star), and only pairs that are
then still in different components are looked at.  Those are paired by sketches, which differ in no more bits than
the sets differ in shingles, so whoever differs in too many bits is not linked.  The others are compared within a task that
has their sets, unless links found before connect them, and a forest of links is given.  So a large group of near copies
gives no more links than it has members, only its sketches are held against one another, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_filter, in_filter, lean, materialise, partitions, small_batches
from .components import connected
from .shingles import mixed, shingle_sets, signature

#: Shingles of more prefixes than this are heavy.  Tasks are sent a table of so many slots for each, a byte a slot, and of so many slots at most.
HEAVY, SLOTS_EACH, SLOTS_MOST = 16, 16, 1 << 23
#: Largest size for which subsets are considered.
SMALL_MOST = 16
KNOWN = 1 << 20
#: Entries that a task gathers before it gives them on.
FLUSH = 1_000_000
#: Bits of a sketch for each shingle (the next power of two is taken), and at most.
SKETCH_EACH, SKETCH_MOST = 8, 1 << 14
#: Members of a block of a group, and shingles in all that it may hold.
DEALT, SHINGLES_MOST = 1 << 14, 1 << 22

PAIR = "a long, na int, ha int, b long, nb int, hb int, c int"


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    """n - ceil(0.8 n) + 1"""
    return n - (4 * n + 4) // 5 + 1


def shared(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """What sets of these sizes must share to be linked: ceil(4/9 (n + m))."""
    return (4 * (n + m) + 8) // 9


def subset_sizes(n: int, most: int) -> list[int]:
    return sorted({shared(n, m) for m in range((4 * n + 4) // 5, min(5 * n // 4, most) + 1)} & {*range(1, n + 1)})


def subsets(n: int, most: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, most))


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest small size: where subsets cost least, against prefixes whose shingles meet ``list_length`` others each."""
    def cost(x: int) -> float:
        few = sum(k * subsets(n, x) for n, k in sizes.items() if n <= x)
        lists = sum(k * prefix_size(n) * (1 + list_length) for n, k in sizes.items() if 5 * n >= 4 * (x + 1))
        return few + lists

    return min(range(1, SMALL_MOST + 1), key=lambda x: (cost(x), -x))


class Heavy:
    """How heavy a shingle is, by its slot in a table: 0 for light ones."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots, self.mask = slots, np.uint64(len(slots) - 1)

    def grades(self, x: np.ndarray) -> np.ndarray:
        return self.slots[(x & self.mask).astype(np.int64)]

    def ordered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set (in order of hash) rare shingles first, and the grades."""
        g = self.grades(x)
        if g.any():
            order = np.argsort(g, kind="stable")
            x, g = x[order], g[order]
        return x, g


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, sig, few`` of every row: the size and a digest of its set, and of a small set the shingles themselves."""
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), signature(s), s.tobytes() if 0 < len(s) <= SMALL_MOST else None) for _, s in shingle_sets(batch.column(1))]
            cols = list(zip(*got, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n", "sig", "few"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n int, sig long, few binary")


def _distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(digest, set) of the sets of a task, each once."""
    seen: set[int] = set()
    for batch in batches:
        for _, s in shingle_sets(batch.column(0)):
            if len(s) and (sig := signature(s)) not in seen:
                seen.add(sig)
                yield sig, s


def count_prefixes(texts: DataFrame, heavy: Heavy | None) -> DataFrame:
    """``h, c``: in how many prefixes each shingle stands.  Sets whose prefix is heavy to a fifth are counted whole."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(h), pa.array(c, pa.int64())], names=["h", "c"])

        for _, s in _distinct_sets(batches):
            p = prefix_size(len(s))
            if heavy is None:
                s = s[:p]
            elif 5 * (heavy.grades(s[:p]) > 0).sum() < p:
                s = heavy.ordered(s)[0][:p]
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _collect_heavy(counts: DataFrame) -> Heavy:
    heavy = counts.where(F.col("c") > HEAVY)
    n = max(1, heavy.count())
    size = min(SLOTS_MOST, 1 << (n * SLOTS_EACH - 1).bit_length())
    rows = heavy.groupBy(F.expr(f"cast(h & {size - 1}L as int)").alias("slot")).agg(F.max(F.floor(F.log2("c"))).cast("byte").alias("grade")).toPandas()  # at most a row a slot
    slots = np.zeros(size, np.uint8)
    slots[rows["slot"].to_numpy(np.int64)] = rows["grade"].to_numpy(np.uint8)
    return Heavy(slots)


def subset_links(small: DataFrame, x: int, parts: int) -> DataFrame:
    """Links ``a, b`` among the sets ``sig, few`` of at most ``x`` shingles, enough of them to connect all that are linked; each is confirmed."""

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(np.array(cols[0], np.uint64).view(np.int64)), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int64(), pa.int32()), strict=True))], names=["key", "c", "sig", "n"])

        for sig, few in (r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            s = np.frombuffer(few, np.uint64)
            hashed = mixed(s)
            for c in subset_sizes(len(s), x):
                chosen = np.array(list(combinations(range(len(s)), c)))
                keys = mixed(hashed[chosen].sum(1, dtype=np.uint64) + np.uint64(c))
                rows += [(int(k), c, sig, len(s)) for k in keys]
            if len(rows) > FLUSH // 10:
                yield out()
                rows = []
        yield out()

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, c, sig, n = (t.column(k).to_numpy() for k in ("key", "c", "sig", "n"))
        order = np.lexsort((sig, n, c, key))
        key, c, sig, n = key[order], c[order], sig[order], n[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        link = (sig != sig[first]) & (shared(n, n[first]) <= c)
        pairs = np.unique(np.column_stack([sig[first][link], sig[link]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    met = small.select("sig", "few").mapInArrow(spread, "key long, c int, sig long, n int").repartition(parts, "key").mapInArrow(meet, "a long, b long").distinct()
    left, right = (small.select(F.col("sig").alias(end), F.col("few").alias(x)) for end, x in (("a", "x"), ("b", "y")))
    return met.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")


def postings(texts: DataFrame, heavy: Heavy, least: int) -> DataFrame:
    """``h, sig, n, heavies, turn``: the prefixes of sets of at least ``least`` shingles; ``turn`` counts the heavy ones from 1, light ones have 0."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, who, size = [], [], 0

        def out() -> pa.RecordBatch:
            sig, n, many, lengths = (np.array(c) for c in zip(*((w[0], w[1], int(w[2].sum()), len(w[2])) for w in who), strict=True))
            wide = lambda v, t: pa.array(np.repeat(v, lengths).astype(t))
            turn = np.concatenate([np.where(w[2], np.cumsum(w[2]), 0) for w in who]).astype(np.int32)
            return pa.RecordBatch.from_arrays([_signed(np.concatenate(h)), wide(sig, np.int64), wide(n, np.int32), wide(many, np.int32), pa.array(turn)], names=["h", "sig", "n", "heavies", "turn"])

        for sig, s in _distinct_sets(batches):
            if len(s) < least:
                continue
            p = prefix_size(len(s))
            x, g = heavy.ordered(s)
            h.append(x[:p])
            who.append((sig, len(s), g[:p] > 0))
            size += p
            if size >= FLUSH // 4:
                yield out()
                h, who, size = [], [], 0
        if who:
            yield out()

    return texts.mapInArrow(run, "h long, sig long, n int, heavies int, turn int")


def _lists(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], minor: str) -> dict[str, np.ndarray] | None:
    """A partition's postings, each list's in order of size, its repeated entries gone; ``left``: how many follow in the list."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    x = {k: t.column(k).to_numpy(zero_copy_only=False) for k in columns}
    order = np.lexsort((x[minor], x["n"], x["h"]))
    x = {k: v[order] for k, v in x.items()}
    keep = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["sig"][1:] != x["sig"][:-1])])
    x = {k: v[keep] for k, v in x.items()}
    new = np.concatenate([[True], x["h"][1:] != x["h"][:-1]])
    begin = np.flatnonzero(new)
    length = np.diff(begin, append=len(new))
    x["list"] = np.cumsum(new) - 1
    x["length"] = length[x["list"]]
    x["left"] = (begin + length)[x["list"]] - 1 - np.arange(len(new))
    return x


def _pairs(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, c: int) -> dict[str, np.ndarray]:
    """Rows of ``PAIR``, the smaller set (then the smaller digest) first, each pair once with its count."""
    swap = (x["n"][i] > x["n"][j]) | ((x["n"][i] == x["n"][j]) & (x["sig"][i] > x["sig"][j]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((x["sig"][j], x["sig"][i]))
    i, j = i[order], j[order]
    new = np.concatenate([[True], (x["sig"][i][1:] != x["sig"][i][:-1]) | (x["sig"][j][1:] != x["sig"][j][:-1])]) if len(i) else np.zeros(0, bool)
    count = np.diff(np.flatnonzero(new), append=len(i)) if len(i) else np.zeros(0, np.int64)
    i, j = i[new], j[new]
    return {"a": x["sig"][i], "na": x["n"][i], "ha": x["heavies"][i], "b": x["sig"][j], "nb": x["n"][j], "hb": x["heavies"][j], "c": np.minimum(count * c, KNOWN)}


_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def _pair_batch(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(rows.values(), _KINDS, strict=True)], names=list(rows))


def _in_reach(x: dict[str, np.ndarray], active: np.ndarray, c: int) -> Iterator[dict[str, np.ndarray]]:
    """All pairs of each list whose sizes allow a link, by growing distance in the list."""
    held_i, held_j, held, d = [], [], 0, 1
    active = active[x["left"][active] >= 1]
    while len(active):
        active = active[x["left"][active] >= d]
        near = 5 * x["n"][active].astype(np.int64) >= 4 * x["n"][active + d] if len(active) else np.zeros(0, bool)
        active = active[near]  # sizes only grow along a list
        held_i.append(active)
        held_j.append(active + d)
        held += len(active)
        if held > FLUSH:
            yield _pairs(x, np.concatenate(held_i), np.concatenate(held_j), c)
            held_i, held_j, held = [], [], 0
        d += 1
    if held:
        yield _pairs(x, np.concatenate(held_i), np.concatenate(held_j), c)


HOT = "h long, sig long, n int, heavies int, turn int"


def met_in_lists(lists: DataFrame) -> DataFrame:
    """Of light lists the pairs, counted within each task (``h`` is null); of heavy ones of several members the entries."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _lists(batches, ("h", "sig", "n", "heavies", "turn"), "sig")
        if x is None:
            return
        for rows in _in_reach(x, np.flatnonzero(x["turn"] == 0), 1):
            pairs = _pair_batch(rows)
            none = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*pairs.columns, *none], names=[*pairs.schema.names, "h", "sig", "n", "heavies", "turn"])
        hot = (x["turn"] > 0) & (x["length"] > 1)
        if hot.any():
            none = [pa.nulls(int(hot.sum()), t) for t in _KINDS]
            own = [pa.array(x[k][hot]) for k in ("h", "sig", "n", "heavies", "turn")]
            yield pa.RecordBatch.from_arrays([*none, *own], names=["a", "na", "ha", "b", "nb", "hb", "c", "h", "sig", "n", "heavies", "turn"])

    return lists.mapInArrow(run, f"{PAIR}, {HOT}")


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many heavy shingles of their prefixes sets of these sizes must share if they share no light one, at least."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return np.maximum(shared(n, m) - np.maximum(n - prefix_size(n), m - prefix_size(m)), 1)


def _centres(x: dict[str, np.ndarray]) -> np.ndarray:
    """For each entry the most typical one of its list: the least part of light shingles."""
    light = (prefix_size(x["n"]) - x["heavies"]) / x["n"]
    order = np.lexsort((x["sig"].view(np.uint64), light, x["list"]))
    return order[np.searchsorted(x["list"][order], np.arange(int(x["list"][-1]) + 1))][x["list"]]


def star_pairs(lists: DataFrame) -> DataFrame:
    """Of each heavy list: its most typical member with all others that it may be linked with."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _lists(batches, ("h", "sig", "n", "heavies", "turn"), "sig")
        if x is None:
            return
        centre = _centres(x)
        i = np.arange(len(centre))
        keep = (i != centre) & (5 * np.minimum(x["n"], x["n"][centre]).astype(np.int64) >= 4 * np.maximum(x["n"], x["n"][centre]))
        keep &= np.minimum(x["heavies"], x["heavies"][centre]) >= _needed(x["n"], x["n"][centre])
        yield _pair_batch(_pairs(x, centre[keep], i[keep], KNOWN))

    return lists.mapInArrow(run, PAIR)


def unsettled(lists: DataFrame) -> DataFrame:
    """``centre, sig, n, heavies, lists`` of the members of heavy lists (with ``label``) that lie in several components.

    Lists of one centre form a group, in which a member has one row however many of them it is in; in ``lists`` each list sets a bit.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _lists(batches, ("h", "sig", "n", "heavies", "label"), "sig")
        if x is None:
            return
        names = np.lexsort((x["label"], x["list"]))
        many = np.bincount(x["list"][names][1:], (x["list"][names][1:] == x["list"][names][:-1]) & (x["label"][names][1:] != x["label"][names][:-1]), int(x["list"][-1]) + 1) > 0
        take = many[x["list"]]
        bit = np.left_shift(np.uint64(1), x["h"].view(np.uint64) & np.uint64(63))
        cols = (x["sig"][_centres(x)], x["sig"], x["n"], x["heavies"], bit.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in cols], names=["centre", "sig", "n", "heavies", "lists"])

    members = lists.mapInArrow(run, "centre long, sig long, n int, heavies int, lists long")
    return members.groupBy("centre", "sig", "n", "heavies").agg(F.bit_or("lists").alias("lists"))


def sketch(s: np.ndarray, most: int) -> bytes:
    """Which of at most so many bits an odd number of a set's shingles falls on: two sketches differ in no more bits than the sets in shingles."""
    bits = min(most, max(64, 1 << (len(s) * SKETCH_EACH - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _alike_sets(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= 80 * (len(x) + len(y) - common)


def _forest(x: dict[str, np.ndarray], sets: list[np.ndarray], most: int) -> Iterator[tuple[int, int]]:
    """Links, by their places, among members in order of size: of all that join different components, enough to connect these."""
    n, block, comp = x["n"].astype(np.int64), x["block"], np.unique(x["label"], return_inverse=True)[1]
    across = x["first"][0] != x["second"][0]  # pairs of one block meet elsewhere
    drawn = [sketch(s, most) for s in sets]
    width = np.array([len(d) for d in drawn])  # grows with the size; of a pair one is twice the other at most, and folds to it
    start = {int(w): int(np.searchsorted(width, w)) for w in np.unique(width)}
    words = {w: np.frombuffer(b"".join(drawn[f : int(np.searchsorted(width, w, side="right"))]), np.uint64).reshape(-1, w // 8) for w, f in start.items()}
    folded = {w: v[:, : w // 16] ^ v[:, w // 16 :] for w, v in words.items() if w // 2 in words}
    for k in range(len(n) - 1):
        to = np.arange(k + 1, np.searchsorted(n, 5 * n[k] // 4, side="right"))
        to = to[(comp[to] != comp[k]) & (x["lists"][to] & x["lists"][k] != 0)]
        if across:
            to = to[block[to] != block[k]]
        to = to[np.minimum(x["heavies"][to], x["heavies"][k]) >= _needed(np.full(len(to), n[k]), n[to])]
        if not len(to):
            continue
        w = int(width[k])
        own, cut = words[w], int(np.searchsorted(to, start[w] + len(words[w])))
        differ = np.bitwise_count(own[to[:cut] - start[w]] ^ own[k - start[w]]).sum(1, dtype=np.int64)
        if cut < len(to):
            differ = np.concatenate([differ, np.bitwise_count(folded[2 * w][to[cut:] - start[2 * w]] ^ own[k - start[w]]).sum(1, dtype=np.int64)])
        spare = n[to] + n[k] - 2 * shared(n[to], n[k]) - differ
        for j in to[spare >= 0][np.argsort(-spare[spare >= 0], kind="stable")]:
            if comp[j] != comp[k] and _alike_sets(sets[k], sets[j]):
                comp[comp == comp[j]] = comp[k]
                yield k, int(j)


def linked_apart(members: DataFrame) -> DataFrame:
    """Links ``a, b`` of different components (``label``) in each group, dealt out by pairs of its blocks (``first, second``): no more than members, and what they leave apart is not linked."""
    most = SKETCH_MOST

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        x = {k: t.column(k).to_numpy() for k in ("centre", "first", "second", "block", "sig", "n", "heavies", "lists", "label")}
        order = np.lexsort((x["sig"], x["n"], x["second"], x["first"], x["centre"]))
        x = {k: v[order] for k, v in x.items()}
        new = np.concatenate([[True], np.any([x[k][1:] != x[k][:-1] for k in ("centre", "first", "second")], axis=0)])
        begin = np.flatnonzero(new)
        for first, last in zip(begin, [*begin[1:], len(order)], strict=True):
            own = {k: v[first:last] for k, v in x.items()}
            sets = [np.frombuffer(t.column("shingles")[int(at)].as_buffer(), np.uint64) for at in order[first:last]]
            links = np.array([*_forest(own, sets, most)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(own["sig"][links[:, 0]]), pa.array(own["sig"][links[:, 1]])], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long").distinct()


def enough(pairs: DataFrame) -> DataFrame:
    """Pairs of which enough is common: the light shingles that were counted, all heavy ones of the prefixes, and all behind the prefixes."""
    p = lambda n: F.expr(f"{n} - (4 * {n} + 4) div 5 + 1")
    need = F.expr("(4 * (na + nb) + 8) div 9")
    behind = F.greatest(F.col("na") - p("na"), F.col("nb") - p("nb"))
    whole = pairs.groupBy("a", "na", "ha", "b", "nb", "hb").agg(F.sum("c").alias("c"))
    return whole.where((F.col("na") * 5 >= F.col("nb") * 4) & (F.col("c") + F.least("ha", "hb") + behind >= need)).select("a", "b")


@lean
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` whose whole sets ``x, y`` are linked."""
    for batch in batches:
        keep = [_alike_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def whole_sets(docs: DataFrame, sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """``sig, shingles`` of the sets named by ``sigs`` (each once), and of a few others.

    ``docs`` has ``at`` (a hash of the id) and the text, ``classes`` the ``at`` of a document of each set.
    """
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(sigs.join(classes, "sig"), "at"))

    @lean
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select([1]).filter(pa.array(in_filter(sent.value, batch.column(0).to_numpy())))

        sigs, sets, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(sets, pa.binary())], names=["sig", "shingles"])

        for sig, s in _distinct_sets(asked()):
            sigs.append(sig)
            sets.append(s.tobytes())
            size += len(sets[-1])
            if size > 4_000_000:
                yield out()
                sigs, sets, size = [], [], 0
        if sigs:
            yield out()

    return docs.mapInArrow(wanted, "sig long, shingles binary").dropDuplicates(["sig"])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs``, each pair's whole sets compared."""
    left = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")


def _dealt(members: DataFrame) -> DataFrame:
    """The members of each group for all pairs of its blocks."""
    blocks = F.expr(f"cast((count(*) - 1) div greatest(1, least({DEALT}, {SHINGLES_MOST} div max(n))) + 1 as int)")
    sized = members.join(members.groupBy("centre").agg(blocks.alias("blocks")), "centre")
    out = sized.withColumn("block", F.expr("cast(pmod(xxhash64(sig), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return out.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("blocks", "other")


def digests(text: str = "text") -> Column:
    """The digest of each row's set, as ``near_duplicate_rows`` gives it; null without words."""

    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(s) if len(s) else None for _, s in shingle_sets(pa.array(texts, pa.string()))], dtype="Int64")

    return digest(F.col(text))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A text without words, null ones included, has no shingles and is linked with
    nothing.  Rows of one id keep a row each.  A null id stays null and counts only
    where its class has no other.
    """
    return near_duplicate_rows(docs, key, text).select("doc_id", "n_shingles", "component_id")


def near_duplicate_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``near_duplicates`` with ``sig``, the digest of the set, and ``label``, which names the class also where ids repeat; both null without words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text)
    place = F.xxhash64(F.col(key).cast("long"))
    parts = partitions(docs)
    described = materialise(describe(docs, key, text), "described")
    full = described.where("n > 0")
    # Of each set one document whose text is read again, where the set itself is needed.
    classes = materialise(full.groupBy("sig").agg(F.min("doc_id").alias("first"), F.min(F.xxhash64("doc_id")).alias("at")), "classes")

    counts = materialise(count_prefixes(texts, None).where(f"c > {HEAVY // 4}"), "counts")
    again = materialise(count_prefixes(texts, _collect_heavy(counts)).where(f"c > {HEAVY // 4}"), "counts")
    spent = [counts, again]
    counts = counts.unionByName(again).groupBy("h").agg(F.max("c").alias("c"))
    heavy = _collect_heavy(counts)
    meets = counts.where(f"c <= {HEAVY}").agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
    entries = full.agg(F.sum(F.expr("n - (4 * n + 4) div 5 + 1"))).first()[0] or 0
    sizes = dict(full.where(f"n <= {2 * SMALL_MOST}").groupBy("n").count().collect())
    x = boundary(sizes, float(meets) / max(1, entries))

    small = full.where(F.col("n") <= x).groupBy("sig").agg(F.first("few").alias("few"))
    links = materialise(subset_links(small, x, parts), "subset-links")
    lists = postings(texts, heavy, -(-4 * (x + 1) // 5)).repartition(parts, "h")
    met = materialise(met_in_lists(lists), "lists")
    hot = met.where("h is not null").select("h", "sig", "n", "heavies", "turn")
    light = enough(met.where("h is null").select("a", "na", "ha", "b", "nb", "hb", "c"))
    star = star_pairs(hot.repartition(parts, "h")).select("a", "b")
    done = materialise(light.unionByName(star).distinct(), "pairs")
    placed = docs.select(place.alias("at"), F.col(text).alias("text"))
    ends = done.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    found = materialise(compare(done, whole_sets(placed, ends, classes)), "links")
    spent += [links, met, done, found, classes]
    links = links.unionByName(found)
    labels = connected(links)
    if hot.limit(1).count():
        labelled = hot.join(labels, hot["sig"] == labels["node"], "left").select("h", "sig", "n", "heavies", F.coalesce("label", "sig").alias("label"))
        members = materialise(unsettled(labelled.repartition(parts, "h")), "unsettled")
        spent.append(members)
        if members.limit(1).count():
            sets = materialise(whole_sets(placed, members.select("sig").distinct(), classes), "unsettled-sets")
            apart = _dealt(members).join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
            more = materialise(linked_apart(apart.join(sets, "sig").repartition(parts, "centre", "first", "second")), "links-apart")
            spent += [sets, more]
            if more.limit(1).count():
                labels = connected(links.unionByName(more))

    named = materialise(classes.join(labels, classes["sig"] == labels["node"], "left").select("sig", "first", F.coalesce("label", "sig").alias("label")), "named")
    discard(*spent)
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = named.join(lowest, "label").select("sig", "component_id", "label")
    linked = full.join(known, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "sig", "label")
    none = F.lit(None).cast("long")
    empty = described.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("sig"), none.alias("label"))
    return linked.unionByName(empty)
