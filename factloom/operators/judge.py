"""Entity-valued facts: a deterministic gate, and a model that judges what passes it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import verdict_id
from ..schemas import JUDGEMENTS
from ..scratch import written
from ..sources.clients import Completer, completed

SIMILARITY = 0.60
PAIRS_PER_CALL = 8
#: Facts of a block, rows of it that are multiplied at once, and by how much a product of matrices may be off.
BLOCK, ROWS, ROUNDING = 2_048, 512, 1e-9
# What a judged relation means; an unrelated pair has no verdict.
RELATIONS = {
    "equivalent": ("CORROBORATED", "JUDGE:EQUIVALENT"),
    "state_transition": ("VARIANT_EXPLAINED_BY", "JUDGE:STATE_TRANSITION"),
    "contradiction": ("CONTRADICTION", "JUDGE:CONTRADICTION"),
}


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_length(v: Column) -> Column:
    """A vector over its length; zero vectors stay zero."""
    size = F.sqrt(dot(v, v))
    return F.when(size == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def _dealt(side: DataFrame) -> DataFrame:
    """``side`` with ``i, j``, the pair of blocks in which a row meets others, and ``block``, its own; each two blocks of an entity meet once.

    An entity of at most ``BLOCK`` rows is one block, a larger one is dealt out.
    """
    large = side.groupBy("entity_id").count().where(F.col("count") > BLOCK).select("entity_id", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    sized = side.join(F.broadcast(large), "entity_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("fact_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by ``keys``, each whole."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[-1] != table.column(k)[0] for k in keys):
            yield pa.concat_tables(held)
            held = []
        for a, b in pairwise([0, *new.tolist()]):
            yield pa.concat_tables([*held, table.slice(a, b - a)])
            held = []
        held.append(table.slice(int(new[-1]) if len(new) else 0))
    if held:
        yield pa.concat_tables(held)


def _similar(left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``left``, row of ``right``, similarity) of the pairs that reach ``least``, as sums in order of the components give it; NaN reaches all."""
    for first in range(0, len(left), ROWS):
        near = left[first : first + ROWS] @ right.T
        i, j = np.nonzero(~(near < least - ROUNDING))
        i += first
        exact = np.zeros(len(i))
        for k in range(left.shape[1]):
            exact += left[i, k] * right[j, k]
        keep = ~(exact < least)
        yield i[keep], j[keep], exact[keep]


def gate(facts: DataFrame, vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` of value-less facts of one entity, of different documents and texts, with a ``similarity`` of at least that; ``vectors`` has ``object_text, vec``.

    The facts of an entity meet in blocks, as products of matrices; what is about as large as the bound is summed again in order.
    Vectors of different lengths, and those that lack a component, are similar to nothing.
    """
    open_facts = facts.where("value is null and entity_id is not null and fact_id is not null and doc_id is not null").select("fact_id", "doc_id", "entity_id", "predicate_id", "object_text", "claim_text", (F.coalesce(F.size("grounding_issues"), F.lit(0)) <= 0).alias("trusted"))
    known = open_facts.join(vectors.where(F.forall("vec", lambda x: x.isNotNull())).select("object_text", unit_length(F.col("vec")).alias("vec")), "object_text")
    side = _dealt(known.select("entity_id", "fact_id", F.struct("fact_id", "doc_id", "predicate_id", "object_text", "claim_text", "trusted").alias("a"), "vec"))
    keys = ["entity_id", "i", "j"]
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as small partitions made one would leave cores idle
    sorted_ = side.repartition(parts, *keys).sortWithinPartitions(*keys).select(*keys, "block", "a", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            if group.num_rows < 2:
                continue
            i, j, block = (group.column(k).to_numpy() for k in ("i", "j", "block"))
            entity, own = group.column("entity_id").combine_chunks(), group.column("a").combine_chunks()
            fact, doc, text = (own.field(k).to_numpy(zero_copy_only=False) for k in ("fact_id", "doc_id", "object_text"))
            lists = group.column("vec").combine_chunks()
            length, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
            start = np.cumsum(length) - length
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                left, right = rows[block[rows] == i[0]], rows[block[rows] == j[0]]
                of = lambda r: flat[start[r][:, None] + np.arange(n)]  # noqa: B023, E731
                for x, y, near in _similar(of(left), of(right), similarity):
                    x, y = left[x], right[y]
                    # Within one block each pair comes both ways, between two it may come the wrong way round.
                    ahead = fact[x] < fact[y]
                    keep = (doc[x] != doc[y]) & (text[x] != text[y]) & (ahead if i[0] == j[0] else fact[x] != fact[y])
                    x, y, near = np.where(ahead, x, y)[keep], np.where(ahead, y, x)[keep], near[keep]
                    for at in range(0, len(x), ROWS * 16):
                        part = slice(at, at + ROWS * 16)
                        yield pa.RecordBatch.from_arrays([entity.take(pa.array(x[part])), own.take(pa.array(x[part])), own.take(pa.array(y[part])), pa.array(near[part])], names=["entity_id", "a", "b", "similarity"])

    kind = side.schema["a"].dataType.simpleString()
    return sorted_.mapInArrow(run, f"entity_id {side.schema['entity_id'].dataType.simpleString()}, a {kind}, b {kind}, similarity double")


#: What a model is told before the pairs.
JUDGE_TASK = """You are given numbered pairs of statements, A and B, about one subject, each with the title of the document it is from.
For each pair say how B stands to A:
equivalent - both say the same, however worded;
state_transition - both can be true, one at an earlier and one at a later time;
contradiction - they cannot both be true of the same time;
unrelated - they speak of different things.
Give the reason in one sentence. Return one JSON object with the field judgements, an array of objects with the fields
pair (the number), relation (one of the four words) and rationale."""
#: Pairs of a bucket, in which calls are numbered.
BUCKET = 2_048


def calls(pairs: DataFrame, documents: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the pairs with ``bucket, call`` and ``pair``, their number in the call; ``bucket, call, prompt``), both written; the same pairs always make the same calls."""
    titles = documents.select("doc_id", "title")
    flat = pairs.select("entity_id", F.col("a.predicate_id").alias("predicate_id"), F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.col("a.claim_text").alias("claim_a"), F.col("b.claim_text").alias("claim_b"), (F.col("a.trusted") & F.col("b.trusted")).alias("trusted"))
    flat = flat.join(titles.toDF("doc_a", "title_a"), "doc_a").join(titles.toDF("doc_b", "title_b"), "doc_b")
    if limit:
        flat = flat.orderBy("fact_a", "fact_b").limit(limit)
    flat = written(flat, "judge-pairs")
    buckets = max(1, -(-flat.count() // BUCKET))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("fact_a", "fact_b")) - 1
    placed = flat.withColumn("bucket", F.pmod(F.xxhash64("fact_a", "fact_b"), F.lit(buckets))).withColumn("turn", turn)
    placed = written(placed.withColumns({"call": F.floor(F.col("turn") / PAIRS_PER_CALL), "pair": F.col("turn") % PAIRS_PER_CALL}), "judge-placed")
    lines = F.concat(F.lit("["), F.col("pair"), F.lit("]\n  A ("), "title_a", F.lit("): "), "claim_a", F.lit("\n  B ("), "title_b", F.lit("): "), "claim_b", F.lit("\n"))
    said = placed.groupBy("bucket", "call").agg(F.array_sort(F.collect_list(F.struct("pair", lines.alias("said")))).alias("said"))
    return placed, written(said.select("bucket", "call", F.concat_ws("\n\n", F.lit(JUDGE_TASK), F.array_join(F.transform("said", lambda x: x["said"]), "\n")).alias("prompt")), "judge-calls")


def judged(pairs: DataFrame, documents: DataFrame, complete: Completer, cache: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdict rows of the pairs, rows to add to the cache of answers); a model is asked what the cache lacks.

    Answers about pairs that the call lacks are dropped, and of several about one pair the first counts; calls that fail give no verdict.
    ``limit`` bounds the pairs; none, or 0, is no bound.
    """
    placed, asked = calls(pairs, documents, limit)
    found, new = completed(asked, cache, complete)
    told = found.where("error is null").select("prompt", F.posexplode(F.from_json("response", f"judgements {JUDGEMENTS}")["judgements"]).alias("at", "j"))
    first = told.groupBy("prompt", F.col("j.pair").alias("pair")).agg(F.min_by("j", "at").alias("j"))
    answers = placed.join(asked.join(first, "prompt").drop("prompt"), ["bucket", "call", "pair"]).select("entity_id", "predicate_id", "fact_a", "fact_b", "trusted", F.col("j.relation").alias("relation"), F.coalesce("j.rationale", F.lit("")).alias("rationale"))
    answers, model = answers.where(F.col("relation").isin(*RELATIONS)), complete.model
    verdict = F.create_map(*[F.lit(x) for k, v in RELATIONS.items() for x in (k, v[0])])
    reason = F.create_map(*[F.lit(x) for k, v in RELATIONS.items() for x in (k, v[1])])
    rows = answers.select(
        verdict_id(F.col("fact_a"), F.col("fact_b"), "judge").alias("verdict_id"),
        verdict[F.col("relation")].alias("verdict"),
        reason[F.col("relation")].alias("reason_code"),
        "fact_a",
        "fact_b",
        "entity_id",
        "predicate_id",
        F.from_json(F.lit("{}"), "map<string,array<string>>").alias("qualifier_diff"),
        F.lit(None).cast("double").alias("delta"),
        F.lit(None).cast("double").alias("tolerance"),
        F.lit(True).alias("cross_document"),
        F.when(F.col("trusted"), "high").otherwise("low").alias("trust"),
        F.concat("rationale", F.lit(f"  [{model}]")).alias("explanation"),
    )
    return rows, new


def renewed(existing: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A verdict table after a new judge run: the comparator's rows stay."""
    return existing.where(~F.col("reason_code").startswith("JUDGE:")).unionByName(verdicts)

