"""Exact and approximate nearest neighbours by inner product.

Both searches deal the rows spatially over blocks, each of which lies in one place and is
read once, and send a query only to the blocks that may hold something for it.

Exact top-k (:func:`exact_top_k`) is a dual-tree search.  The upper levels are common:
pivots, far apart, that a farthest-first walk picks from a bounded sample; every row and every
query goes to its nearest pivot.  A query group's worst k-th score is known from
below by the sample's rows, and where no inner product between two groups can
pass it (by centres c, d and covering radii r, s at most ``c.d + r|d| + s|c| + rs``),
no vector of the pair is moved.  The lower levels are two cover trees, of a block's rows (made
once) and of the queries that came, descended together under the same bound.

Approximate search (:func:`ann_search`) is an inverted file: coarse centroids, about
``2 sqrt(n)`` of them, residuals cut in sub-vectors and each coded by the nearest of its codewords.
Rows are coded once, and stored by list.  A query probes a share of the lists, those whose centroids are
nearest, scores their codes by tables of asymmetric distances, and the best candidates
of each block, with all that the coding error may have put behind them, are scored again on the vectors themselves.

Vectors that are null, or hold null or non-finite components, take no part, nor do
those of another dimension than most (an inner product needs equal ones).  Ties go to the smaller id.  An id that stands on
several rows is a candidate, and a query, as often as it stands; rows with a query's own
id are not its candidates.  Large finite components are exact too: see :func:`products`.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, ranges, small_batches

#: Rows of a block, and queries that meet it at once.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048
#: Rows on which pivots and bounds rest, and pivots at most.
SAMPLE, PIVOTS = 4_096, 1_024
#: Rows and queries of a leaf, and children of a node: one that needs more is a leaf, for no bound tells so many apart.
LEAF, QUERY_LEAF, FAN = 256, 16, 64
#: Integer components up to this size give exact products in doubles.
PLAIN = 2.0**20
NONE, LARGEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PARTS_MOST = 20_000
#: Queries whose tables of distances are held at once, and the coding errors by which a candidate may seem worse than it is.
CHUNK, MARGIN = 256, 2.0
MET = "query_id long, copy long, vec_id long"
log = logging.getLogger(__name__)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("embedding"))
    common = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("embedding") == (common[0].n if common else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 1))


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(most).toArrow()
    return got.column("vec_id").to_numpy(), matrix(got.column("embedding"))


# Trees


@dataclass
class Node:
    """A centre, which is one of the rows, and the radius that covers them all.

    Children's centres lie more than ``apart`` from each other, and each child's rows within ``apart`` of its centre, the
    first of which is the parent's own.
    """

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    length: float
    apart: float = 0.0
    children: list["Node"] = field(default_factory=list)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF, centre: int | None = None) -> Node:
    """Nested covers, of half the radius from level to level."""
    rows = np.arange(len(x)) if rows is None else rows
    own = x[rows]
    if centre is None:
        centre = int(rows[((own - own.mean(0)) ** 2).sum(1).argmin()])
    nearest = _far(own, x[centre])
    node = Node(rows, x[centre], float(nearest.max()), float(np.sqrt(x[centre] @ x[centre])))
    if len(rows) <= leaf or node.radius == 0:
        return node
    owner, centres, apart = np.zeros(len(rows), np.int64), [centre], node.radius / 2
    while (far := int(nearest.argmax())) >= 0 and nearest[far] > apart:
        if len(centres) == FAN:
            return node
        centres.append(int(rows[far]))
        d = _far(own, own[far])
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], len(centres) - 1
    node.apart = apart
    node.children = [cover_tree(x, rows[owner == k], leaf, c) for k, c in enumerate(centres)]
    return node


def bound(centre: np.ndarray, radius: float, length: float, other: Node) -> float:
    """What no inner product between two groups passes."""
    most = float(centre @ other.centre) + radius * other.length + other.radius * length + radius * other.radius
    return most + 1e-9 * (abs(most) + 1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (given as doubles): exact, and brought to the nearest 64-bit number where they exceed one."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= PLAIN and q.shape[1] <= 2**53 / PLAIN**2:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, NONE + 1, LARGEST).astype(np.int64)


class Best:
    """The k best scores and ids of each query so far (score descending, id ascending); ``least`` is known to be reached by k rows."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int) -> None:
        self.ids, self.least, self.k, self.scored = ids, least, k, 0
        self.scores, self.found = np.full((len(ids), k), NONE), np.full((len(ids), k), LARGEST)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.least[rows])

    def take(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        self.scored += s.size
        s = np.where(self.ids[rows][:, None] == ids[None, :], NONE, s)
        s[s < self.worst(rows)[:, None]] = NONE  # equal scores may still win by id
        if not (s > NONE).any():
            return
        all_s = np.concatenate([self.scores[rows], s], 1)
        all_i = np.where(all_s > NONE, np.concatenate([self.found[rows], np.broadcast_to(ids, s.shape)], 1), LARGEST)
        order = np.lexsort((all_i, ~all_s), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)


def dual_tree(best: Best, queries: np.ndarray, q_root: Node, x: np.ndarray, ids: np.ndarray, root: Node) -> None:
    """Descend both trees, the most promising pairs first."""

    def visit(q: Node, r: Node, most: float) -> None:
        if most < float(best.worst(q.rows).min()):
            return
        if not q.children and not r.children:
            for a in range(0, len(r.rows), 4 * LEAF):
                part = r.rows[a : a + 4 * LEAF]
                best.take(q.rows, products(queries[q.rows], x[part]), ids[part])
            return
        pairs = [(bound(a.centre, a.radius, a.length, b), i, a, b) for i, (a, b) in enumerate((a, b) for a in (q.children or [q]) for b in (r.children or [r]))]
        for most, _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1])):
            visit(a, b, most)

    visit(q_root, root, bound(q_root.centre, q_root.radius, q_root.length, root))


# Rows and queries in one place


def _at_blocks(rows: DataFrame, queries: DataFrame, blocks: int, prepare: Callable, answer: Callable, score: str) -> DataFrame:
    """Every query meets the block it is sent to: ``prepare`` of a block's rows, once, then ``answer`` of that and some of the queries.

    Both have ``block, vec_id, copy, embedding, mark, code``; a task holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, asked, n, state = None, [], [], 0, None

        def out() -> pa.RecordBatch:
            cols = answer(state, pa.Table.from_batches(asked))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int64() if score == "long" else pa.float64())], names=["query_id", "copy", "vec_id", "score"])

        for batch in batches:
            block, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == b:
                    continue
                if block[a] != here:
                    if asked:
                        yield out()
                    here, rows, asked, n, state = block[a], [], [], 0, None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    rows.append(part)
                    continue
                if state is None:
                    if not rows:
                        continue
                    state, rows = prepare(pa.Table.from_batches(rows)), [part.slice(0, 0)]
                asked.append(part)
                n += b - a
                if n >= BLOCK_QUERIES:
                    yield out()
                    asked, n = [], 0
        if asked:
            yield out()

    columns = ["vec_id", "copy", "embedding", "mark", "code"]
    both = rows.select("block", F.lit(False).alias("is_query"), *columns).unionByName(queries.select("block", F.lit(True).alias("is_query"), *columns))
    there = both.repartition(max(1, min(blocks, PARTS_MOST)), "block").sortWithinPartitions("block", "is_query")
    return there.mapInArrow(run, f"{MET}, score {score}")


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked."""
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _flat(best: Best, copies: np.ndarray) -> tuple[np.ndarray, ...]:
    real = best.scores > NONE
    at = np.nonzero(real)[0]
    return best.ids[at], copies[at], best.found[real], best.scores[real]


# Exact search


def pivots_of(x: np.ndarray, most: int) -> np.ndarray:
    """A farthest-first walk from the row nearest to the mean: each prefix of it is far apart and covers the sample."""
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    nearest = _far(x, x[at[0]])
    while len(at) < most and nearest.max() > 0:
        at.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _far(x, x[at[-1]]))
    return x[at]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance; rows with a large component go to a group of their own, the last."""
    wide = np.abs(x).max(1, initial=0) > PLAIN
    safe = np.where(wide[:, None], 0, x)
    own = (safe @ pivots.T - (pivots**2).sum(1) / 2).argmax(1) if len(pivots) else np.zeros(len(x), np.int64)
    far = np.sqrt(((safe - pivots[own]) ** 2).sum(1)) if len(pivots) else np.zeros(len(x))
    return np.where(wide, len(pivots), own), np.where(wide, 0.0, far)


def _placed(rows: DataFrame, pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> DataFrame:
    """``vec_id, embedding, copy`` (a number of the row's own), ``pivot, far, mark``: of queries a score that k rows of the sample reach."""
    sent = rows.sparkSession.sparkContext.broadcast((pivots, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample = sent.value
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            if not len(x):
                continue
            own, far = _nearest(x, pivots)
            least = np.full(len(x), NONE)
            if sample is not None and len(sample[0]) > k:
                wide = own == len(pivots)
                s = np.where(wide[:, None], NONE, products(np.where(wide[:, None], 0, x), sample[1]))
                s[ids[:, None] == sample[0][None, :]] = NONE
                least = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own.astype(np.int32)), pa.array(far), pa.array(least)], names=["vec_id", "embedding", "copy", "pivot", "far", "mark"])

    return rows.select("vec_id", "embedding", F.monotonically_increasing_id().alias("copy")).mapInArrow(run, "vec_id long, embedding array<double>, copy long, pivot int, far double, mark long")


def met_groups(pivots: np.ndarray, q_pivots: int, rows: dict[int, float], queries: dict[int, tuple[float, int]]) -> dict[int, list[int]]:
    """Which row groups (with their radii) each query group (radius, worst k-th score) must see; the last groups, of large components, see and are seen by all."""
    out = {}
    length = np.sqrt((pivots**2).sum(1))
    for g, (radius, worst) in queries.items():
        if g == q_pivots:
            out[g] = sorted(rows)
            continue
        seen = lambda r: r == len(pivots) or bound(pivots[g], radius, float(length[g]), Node(np.zeros(0), pivots[r], rows[r], float(length[r]))) >= worst  # noqa: B023, E731
        out[g] = [r for r in sorted(rows) if seen(r)]
    return out


def exact_top_k(vectors: DataFrame, which: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` over the components ``floor(scale * x)``; ``which`` picks the query rows.

    Scores beyond 64 bits show as the nearest such number and are ranked by it; vectors that ``scale`` makes infinite take no part.
    """
    small_batches(vectors.sparkSession)
    floored = F.transform("embedding", lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = usable(vectors).withColumn("embedding", floored).where(~F.exists("embedding", lambda x: F.abs(x) == float("inf")))
    rows = materialise(rows, "vectors")
    n, m = rows.count(), rows.where(which).count()
    ids, x = _sample(rows.where(~F.exists("embedding", lambda x: F.abs(x) > PLAIN)), SAMPLE)
    pivots = pivots_of(x, min(PIVOTS, max(1, -(-n // BLOCK_ROWS)))) if len(x) else np.zeros((0, 1))
    q_pivots = pivots[: max(1, min(len(pivots), -(-m // BLOCK_QUERIES)))]
    placed = materialise(_placed(rows, pivots, None, k), "placed-rows")
    asked = materialise(_placed(rows.where(which), q_pivots, (ids, x), k), "placed-queries")
    discard(rows)
    counts = {r.pivot: (r.n, r.far) for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # at most PIVOTS + 1 rows
    groups = {r.pivot: (r.far, r.least) for r in asked.groupBy("pivot").agg(F.max("far").alias("far"), F.min("mark").alias("least")).collect()}
    met = met_groups(pivots, len(q_pivots), {p: far for p, (_, far) in counts.items()}, groups)
    parts = {p: -(-c // BLOCK_ROWS) for p, (c, _) in counts.items()}
    first = dict(zip(sorted(parts), np.concatenate([[0], np.cumsum([parts[p] for p in sorted(parts)])]).tolist(), strict=False))
    blocks = sum(parts.values())
    log.info("exact top-k: %d of %d pairs of groups pruned", len(met) * len(counts) - sum(map(len, met.values())), len(met) * len(counts))
    spark = vectors.sparkSession
    where = F.broadcast(spark.createDataFrame([(p, first[p], parts[p]) for p in parts], "pivot int, first long, parts long"))  # at most PIVOTS + 1 rows
    seen = F.broadcast(spark.createDataFrame([(g, r) for g, found in met.items() for r in found], "pivot int, sees int"))  # at most (PIVOTS + 1) squared
    none = F.lit(None).cast("binary").alias("code")
    dealt = placed.join(where, "pivot").select((F.col("first") + F.pmod(F.xxhash64("copy"), F.col("parts"))).alias("block"), "vec_id", "copy", "embedding", "mark", none)
    sent = asked.join(seen, "pivot").drop("pivot").join(where.withColumnRenamed("pivot", "sees"), "sees")
    sent = sent.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block"), "vec_id", "copy", "embedding", "mark", none)

    def prepare(t: pa.Table) -> tuple:
        x, ids = matrix(t.column("embedding")), t.column("vec_id").to_numpy()
        wide = np.abs(x).max(1, initial=0) > PLAIN
        plain = np.flatnonzero(~wide)
        return x, ids, wide, cover_tree(x, plain) if len(plain) else None

    def answer(state: tuple, t: pa.Table) -> tuple[np.ndarray, ...]:
        x, ids, wide, root = state
        q = matrix(t.column("embedding"))
        best = Best(t.column("vec_id").to_numpy(), t.column("mark").to_numpy(), k)
        q_wide = np.abs(q).max(1, initial=0) > PLAIN
        plain, others = np.flatnonzero(~q_wide), np.flatnonzero(q_wide)
        if len(plain) and root is not None:
            dual_tree(best, q, cover_tree(q, plain, QUERY_LEAF), x, ids, root)
        for a, b in ((others, np.arange(len(x))), (plain, np.flatnonzero(wide))):
            if len(a) and len(b):
                best.take(a, products(q[a], x[b]), ids[b])
        return _flat(best, t.column("copy").to_numpy())

    return _best(_at_blocks(dealt, sent, blocks, prepare, answer, "long"), k)


# Approximate search


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    codebooks: np.ndarray  # sub-vectors by codewords by width

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - (self.centroids**2).sum(1) / 2).argmax(1)

    def code(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (x - self.centroids[cell]).reshape(len(x), len(self.codebooks), -1)
        return np.stack([(rest[:, j] @ b.T - (b**2).sum(1) / 2).argmax(1) for j, b in enumerate(self.codebooks)], 1).astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with the centroids, and which lists each query probes: the nearest that hold rows, and more until they hold ``least`` rows."""
        near = q @ self.centroids.T
        order = np.argsort(np.where(counts > 0, -near, np.inf), axis=1, kind="stable")
        before = np.cumsum(counts[order], 1) - counts[order]
        mask = np.zeros(near.shape, bool)
        np.put_along_axis(mask, order, (np.arange(near.shape[1]) < probes) | (before < least), 1)
        return near, mask


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def train_index(sample: np.ndarray, cells: int, parts: int, words: int = 128) -> Index:
    """Coarse centroids and residual codebooks, from a bounded sample."""
    coarse = kmeans(sample, cells)
    own = (sample @ coarse.T - (coarse**2).sum(1) / 2).argmax(1)
    rest = (sample - coarse[own]).reshape(len(sample), parts, -1)
    books = [kmeans(rest[:, j], words, seed=j) for j in range(parts)]
    return Index(coarse, np.stack(books))


def dealt_lists(centroids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each list and how many it has: near lists share one, a list of more rows than a block has several."""
    groups = max(1, min(len(centroids), -(-int(counts.sum()) // BLOCK_ROWS)))
    middle = kmeans(centroids, groups)
    order = np.argsort((centroids @ middle.T - (middle**2).sum(1) / 2).argmax(1), kind="stable")
    first, parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // BLOCK_ROWS))
    block, held = 0, 0
    for c in order:
        if held and held + counts[c] > BLOCK_ROWS:
            block, held = block + 1, 0
        first[c] = block
        if parts[c] > 1:
            block, held = block + int(parts[c]), 0
        else:
            held += int(counts[c])
    return first, parts


@dataclass(frozen=True)
class Lists:
    """A block's rows, list by list and code by code: rows of equal codes, which no table of distances tells apart, are one candidate."""

    x: np.ndarray
    ids: np.ndarray
    code: np.ndarray  # of each candidate
    begin: np.ndarray  # the first candidate of each list
    start: np.ndarray  # the first row of each candidate
    size: np.ndarray
    error: float  # what coding adds to an inner product with a unit vector, root mean square


def lists_of(x: np.ndarray, ids: np.ndarray, cell: np.ndarray, code: np.ndarray, index: Index) -> Lists:
    with np.errstate(over="ignore", invalid="ignore"):
        rest = x - index.centroids[cell] - np.concatenate([b[code[:, j]] for j, b in enumerate(index.codebooks)], 1)
        off = (rest * rest).sum(1) / x.shape[1]
    _, kind = np.unique(np.ascontiguousarray(code).view(np.dtype((np.void, code.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind, cell))
    cell, kind = cell[order], kind[order]
    start = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])]))
    return Lists(x[order], ids[order], code[order][start], np.searchsorted(cell[start], np.arange(len(index.centroids) + 1)), start, np.diff(start, append=len(x)), float(np.sqrt(np.median(off))))


def ann_search(vectors: DataFrame, which: Column, k: int = 20, lists: float = 2.0, lists_most: int = 4_096, sample_each: int = 16, share: float = 0.7, rerank: int = 12) -> DataFrame:
    """``query_id, rank, vec_id, score``: an inverted file of ``lists * sqrt(n)`` lists, at most ``lists_most``, that holds every row.

    It is fitted on ``SAMPLE`` rows, or ``sample_each`` for each list where that is more (in the order of a hash of the id).
    Copies in the sample count once.  Each query probes ``share`` of the lists that hold rows, more where they hold less than ``rerank * k`` rows, and in each block
    of rows takes on the ``rerank * k`` best candidates by asymmetric distance (a candidate being all rows of one code), and
    all others within ``MARGIN`` coding errors of the k-th, to be scored exactly.
    Zero vectors take no part.
    """
    small_batches(vectors.sparkSession)
    rows = materialise(usable(vectors).where(F.exists("embedding", lambda x: x != 0)), "vectors")
    spark = vectors.sparkSession
    n = rows.count()
    cells = max(1, min(lists_most, int(lists * n**0.5)))
    _, sample = _sample(rows, max(SAMPLE, sample_each * cells))
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    parts = next(p for p in (16, 8, 4, 2, 1) if sample.shape[1] % p == 0)
    # Outsized components would leave no centroid for the others; rows with them lie in lists as all do.
    typical = np.abs(sample).max(1) <= 1e6 * np.median(np.abs(sample).max(1))
    index = train_index(np.unique(sample[typical], axis=0), cells, parts)
    cells = len(index.centroids)
    sent = spark.sparkContext.broadcast(index)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                with np.errstate(over="ignore", invalid="ignore"):
                    cell = sent.value.assign(x)
                    code = sent.value.code(x, cell)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "embedding", "copy", "mark", "code"])

    stored = materialise(rows.select("vec_id", "embedding", F.monotonically_increasing_id().alias("copy")).mapInArrow(coded, "vec_id long, embedding array<double>, copy long, mark long, code binary"), "coded")
    counts = np.zeros(cells, np.int64)
    for r in stored.groupBy("mark").count().collect():  # at most lists_most rows
        counts[r.mark] = r["count"]
    probes = max(1, -(-int(share * 1000) * int((counts > 0).sum()) // 1000))
    first, spread = dealt_lists(index.centroids, counts)
    where = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(spread[c])) for c in range(cells)], "mark long, first long, parts long"))
    blocks = int((first + spread).max())

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                _, mask = sent.value.probed(x, probes, counts, rerank * k)
            to = []
            for probed in mask:
                own = np.flatnonzero(probed & (counts > 0))
                to.append(np.unique(ranges(first[own], spread[own])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int64()))], names=["vec_id", "embedding", "copy", "to"])

    asked = rows.where(which).select("vec_id", "embedding", F.monotonically_increasing_id().alias("copy")).mapInArrow(routed, "vec_id long, embedding array<double>, copy long, to array<long>")
    asked = materialise(asked, "routed")
    discard(rows)
    dealt = stored.join(where, "mark").select((F.col("first") + F.pmod(F.xxhash64("copy"), F.col("parts"))).alias("block"), "vec_id", "copy", "embedding", "mark", "code")
    sent_queries = asked.select(F.explode("to").alias("block"), "vec_id", "copy", "embedding", F.lit(0).cast("long").alias("mark"), F.lit(None).cast("binary").alias("code"))

    def prepare(t: pa.Table) -> Lists:
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return lists_of(matrix(t.column("embedding")), t.column("vec_id").to_numpy(), t.column("mark").to_numpy(), code, sent.value)

    def nearest(state: Lists, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query's place, id, score) of the k best candidates of each query, all where there are fewer."""
        code, begin, index = state.code, state.begin, sent.value
        near, mask = index.probed(q, probes, counts, rerank * k)
        # The table of each query: what each codeword adds to its score.
        table = np.einsum("jwd,qjd->jqw", index.codebooks, q.reshape(len(q), len(index.codebooks), -1)).astype(np.float32)
        guess = np.full((len(q), len(code)), -np.inf, np.float32)
        for c in np.flatnonzero(np.diff(begin)):
            asks = np.flatnonzero(mask[:, c])
            s = np.repeat(near[asks, c].astype(np.float32)[:, None], begin[c + 1] - begin[c], 1)
            for j, part in enumerate(table):
                s += part[asks][:, code[begin[c] : begin[c + 1], j]]
            guess[asks, begin[c] : begin[c + 1]] = np.nan_to_num(s, nan=np.finfo(np.float32).max, neginf=np.finfo(np.float32).min)  # what can't be told is looked at
        # Scored exactly: the best guesses, and all that the coding error may have put behind the k-th of them.
        ends = [len(code) - min(n, len(code)) for n in (rerank * k, k)]
        cut, kth = np.partition(guess, ends, axis=1)[:, ends].T.astype(float)
        cut = np.minimum(cut, kth - MARGIN * state.error * np.sqrt((q * q).sum(1)))
        who, at = np.nonzero((guess >= np.nan_to_num(cut, nan=-np.inf)[:, None]) & (guess > -np.inf))
        who, rows = np.repeat(who, state.size[at]), ranges(state.start[at], state.size[at])
        others = state.ids[rows] != own[who]
        who, rows = who[others], rows[others]
        score = inner(state.x, rows, q, who)
        order = np.lexsort((state.ids[rows], -score, who))
        order = order[~np.isnan(score[order])]  # sums of opposite infinities have no place
        who = who[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[best], state.ids[rows[order[best]]], score[order[best]]

    def answer(state: Lists, t: pa.Table) -> tuple[np.ndarray, ...]:
        q, own, copies = matrix(t.column("embedding")), t.column("vec_id").to_numpy(), t.column("copy").to_numpy()
        got = []
        with np.errstate(over="ignore", invalid="ignore"):
            for a in range(0, len(q), CHUNK):
                who, found, score = nearest(state, q[a : a + CHUNK], own[a : a + CHUNK])
                got.append((own[a + who], copies[a + who], found, score))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))

    return _best(_at_blocks(dealt, sent_queries, blocks, prepare, answer, "double"), k)


def inner(x: np.ndarray, rows: np.ndarray, q: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Inner products of pairs of a row and a query in double precision, summed component by component, so that the result doesn't hang on the block."""
    total = np.zeros(len(rows))
    for j in range(x.shape[1]):
        total += x[:, j][rows] * q[:, j][who]
    return total
