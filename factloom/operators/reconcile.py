"""Reconciliation: facts meet only inside a comparison cell, and every comparable pair gets a verdict.

The keys that tell a cell's facts apart are aggregated before the pair join, and a
fact carries its signature over them into it, so that the join moves small rows.
Facts that differ in two positions have no verdict and do not meet: the join is by what
is left of a signature without one position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grounding, qualifiers, units
from ..functions.naming import verdict_id
from ..scratch import written

CELL = ("entity_id", "predicate_id")
#: A cell is paired by blocks where its facts are so many times the block rows that each of them makes.
FEW = 4
#: Facts of one block that a task pairs with the others of it; larger blocks are dealt out.
SHARE = 500


def prepared(facts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Facts of both ids, with ``norm``, ``pairs`` (normalised qualifiers), ``inherited`` and ``trusted``; facts of unknown documents go if ``documents`` is given."""
    facts = facts.where("entity_id is not null and predicate_id is not null")
    if documents is not None:
        facts = facts.join(documents.select("doc_id", "title"), "doc_id")
    issues = F.coalesce("grounding_issues", F.array().cast("array<string>"))
    return facts.withColumns(
        {
            "norm": units.normalise(F.col("value"), F.col("unit")),
            "pairs": qualifiers.normalised(F.col("qualifiers")),
            "inherited": grounding.inherited(issues),
            "trusted": F.size(issues) == 0,
        }
    )


def key_spread(facts: DataFrame) -> DataFrame:
    """``entity_id, predicate_id, k, n_values, carriers, n_facts, discriminating`` over prepared facts, value-less ones included."""
    counts = facts.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_facts"))
    stated = facts.select(*CELL, "fact_id", F.explode("pairs").alias("q")).select(*CELL, "fact_id", F.col("q.key").alias("k"), F.col("q.value").alias("v"))
    # One row for each key and value first: its carriers are counted on the way.
    by_key = stated.groupBy(*CELL, "k").agg(F.count_distinct("v").alias("n_values"), F.count_distinct("fact_id").alias("carriers"))
    spread = by_key.join(counts, list(CELL))
    return spread.withColumn("discriminating", (F.col("n_values") >= 2) | ((F.col("n_facts") > 1) & (F.col("carriers") < F.col("n_facts"))))


def discriminating_keys(facts: DataFrame) -> DataFrame:
    """``entity_id, predicate_id, keys``: the sorted keys that tell the facts of a cell apart; cells without one have no row."""
    return key_spread(facts).where("discriminating").groupBy(*CELL).agg(F.sort_array(F.collect_set("k")).alias("keys"))


def signed(facts: DataFrame) -> DataFrame:
    """Prepared facts with their cell's ``keys``, their ``sig`` over them, and ``position``: its value, or null, for each key."""
    keys = discriminating_keys(facts)
    out = facts.join(keys, list(CELL), "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    signed_facts = out.withColumn("sig", qualifiers.signature(F.col("pairs"), F.col("keys")))
    return signed_facts.withColumn("position", F.transform("keys", lambda k: F.try_element_at("sig", k)))


def _blocks(slim: DataFrame) -> DataFrame:
    """``slim`` with ``turn`` and the blocks ``as_a``, ``as_b`` in which a fact meets others as either side.

    A missing position differs from nothing, so facts meet by the pattern of what both miss: a fact makes a row
    for each pattern of its cell and each position that is left out (``turn``), and its block is what both sides
    state elsewhere.  Cells of many patterns are one block, of turn -1.
    """
    shaped = slim.withColumn("gaps", F.transform("side.position", lambda x: x.isNull()))
    cell = Window.partitionBy(*CELL)
    patterns = shaped.groupBy(*CELL, "gaps").agg(F.count(F.lit(1)).alias("n")).withColumns({"n_facts": F.sum("n").over(cell), "n_patterns": F.count(F.lit(1)).over(cell)})
    worth = (F.size("gaps") > 0) & (F.col("n_patterns") * F.size("gaps") * FEW <= F.col("n_facts"))
    others = patterns.select(*CELL, F.when(worth, F.col("gaps")).alias("other")).distinct()
    missed = lambda i: F.get("gaps", i) | F.get("other", i)
    turns = F.filter(F.sequence(F.lit(0), F.size("gaps") - 1), lambda i: (i == 0) | ~missed(i))
    rows = shaped.join(others, list(CELL)).withColumn("turn", F.explode(F.when(F.col("other").isNull(), F.array(F.lit(-1))).otherwise(turns)))
    stated = F.transform("side.position", lambda x, i: F.when((i == F.col("turn")) | missed(i), None).otherwise(x))
    block = lambda a, b: F.when(F.col("turn") < 0, F.lit(0)).otherwise(F.xxhash64("turn", a, b, stated))
    return rows.withColumns({"as_a": block("gaps", "other"), "as_b": block("other", "gaps")})


def paired(facts: DataFrame) -> DataFrame:
    """Comparable pairs of valued facts of a cell as structs ``a`` and ``b``, the smaller id first, that differ in one position at most.

    ``state`` says of each position whether the sides agree (0), one misses it (1) or they differ (2); ``conflicts`` counts the last.
    Blocks are known by hashes, and each pair is looked at again: one that differs in a position counts where that is left out, one that does not where the first is.
    """
    slim = facts.where("norm is not null").select(*CELL, "keys", F.struct("fact_id", "doc_id", "predicate", "norm", "position", "inherited", "trusted").alias("side"))
    rows = _blocks(slim)
    left = rows.select(*CELL, "keys", "turn", F.col("as_a").alias("block"), F.col("side").alias("a"))
    right = rows.select(*CELL, F.col("as_b").alias("block"), F.col("side").alias("b"))
    meet = [*CELL, "block"]
    shares = left.groupBy(*meet).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARE).select(*meet, F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    of = F.coalesce("shares", F.lit(1))
    left = left.join(shares, meet, "left").withColumn("share", F.pmod(F.xxhash64("a.fact_id"), of).cast("int")).drop("shares")
    right = right.join(shares, meet, "left").withColumn("share", F.explode(F.sequence(F.lit(0), of - 1))).drop("shares")
    # A partition's work is its pairs, not its bytes: the number of partitions stays what the session says.
    parts, meet = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*meet, "share"]
    pairs = left.repartition(parts, *meet).join(right.repartition(parts, *meet), meet).where(F.col("a.fact_id") < F.col("b.fact_id"))
    # Positions are aligned with the sorted keys, so a pair is compared without building maps; those are made for the rows that stay.
    state = F.zip_with("a.position", "b.position", lambda x, y: F.when(x.isNull() | y.isNull(), 1).when(x != y, 2).otherwise(0))
    pairs = pairs.where(units.comparable(F.col("a.norm"), F.col("b.norm"))).withColumn("state", state).withColumn("conflicts", F.size(F.filter("state", lambda x: x == 2)))
    turn, conflicts = F.col("turn"), F.col("conflicts")
    once = ((conflicts == 0) & (turn <= 0)) | ((conflicts == 1) & ((turn < 0) | (F.get("state", turn) == 2)))
    return pairs.where(once).select(*CELL, "keys", "a", "b", "state", "conflicts")


def _raw(predicate: Column) -> Column:
    return F.lower(F.regexp_replace(predicate, r"(?U)^\s+|\s+$", ""))


#: The decisions, by the number of their rule from 1: verdict, reason (or what it begins with), explanation.
DECISIONS = (
    ("VARIANT_EXPLAINED_BY", "QUALIFIER_DIFF:", "values differ, and so does one qualifier"),
    ("CORROBORATED", "AGREE_ON_SHARED_QUALIFIERS", "values agree within printed precision; not every qualifier is stated"),
    ("INSUFFICIENT_CONTEXT", "MISSING_QUALIFIER:", "values differ, but a qualifier that matters here is not stated"),
    ("CORROBORATED", "SAME_CELL_AGREE", "values agree within printed precision"),
    ("INSUFFICIENT_CONTEXT", "INHERITED_QUALIFIER", "a literal of either fact is not in the text it cites"),
    ("INSUFFICIENT_CONTEXT", "PREDICATE_UNCERTAIN", "the wordings of the predicate differ"),
    ("CONTRADICTION", "SAME_CELL_DISAGREE", "same position, values beyond printed precision"),
)


def compared(pairs: DataFrame) -> DataFrame:
    """A verdict for each pair of the decision table; pairs that it leaves out have none.  Columns that a reader leaves out cost nothing."""
    side = lambda s, i: F.get(F.col(f"{s}.position"), i)

    def diff(wanted: int) -> Column:
        """The keys in a state, with both values; of missing ones those that a side states."""
        at = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: (F.get("state", i) == wanted) & (side("a", i).isNotNull() | side("b", i).isNotNull()))
        return F.map_from_arrays(F.transform(at, lambda i: F.get("keys", i)), F.transform(at, lambda i: F.array(side("a", i), side("b", i))))

    base = pairs.withColumns({"delta": F.abs(F.col("a.norm.value") - F.col("b.norm.value")), "tolerance": F.col("a.norm.tolerance") + F.col("b.norm.tolerance")})
    base = base.withColumn("agree", F.col("delta") <= F.col("tolerance")).where("conflicts = 0 or not agree")
    agree, gap = F.col("agree"), F.array_contains("state", 1)
    ruled = base.withColumn(
        "rule",
        F.when(F.col("conflicts") == 1, 1)
        .when(gap & agree, 2)
        .when(gap, 3)
        .when(agree, 4)
        .when(F.col("a.inherited") | F.col("b.inherited"), 5)
        .when(_raw(F.col("a.predicate")) != _raw(F.col("b.predicate")), 6)
        .otherwise(7),
    )
    rule = F.col("rule")
    key, first_missing = (F.get("keys", (F.array_position("state", k) - 1).cast("int")) for k in (2, 1))
    told = lambda k: F.element_at(F.array(*[F.lit(d[k]) for d in DECISIONS]), rule)
    no_diff = F.from_json(F.lit("{}"), "map<string,array<string>>")
    wording = F.create_map(F.lit("predicate"), F.array("a.predicate", "b.predicate"))
    return ruled.select(
        verdict_id(F.col("a.fact_id"), F.col("b.fact_id")).alias("verdict_id"),
        told(0).alias("verdict"),
        F.when(rule == 1, F.concat(told(1), key)).when(rule == 3, F.concat(told(1), first_missing)).otherwise(told(1)).alias("reason_code"),
        F.col("a.fact_id").alias("fact_a"),
        F.col("b.fact_id").alias("fact_b"),
        *CELL,
        F.when(rule == 1, diff(2)).when(rule.isin(2, 3), diff(1)).when(rule == 6, wording).otherwise(no_diff).alias("qualifier_diff"),
        "delta",
        "tolerance",
        (F.col("a.doc_id") != F.col("b.doc_id")).alias("cross_document"),
        F.when(F.col("a.trusted") & F.col("b.trusted"), "high").otherwise("low").alias("trust"),
        told(2).alias("explanation"),
    )


def reconcile(facts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All verdicts of the comparator over ``facts``.

    The signed facts, slim and read by both sides of the pair join, are written once.
    """
    own = signed(prepared(facts, documents)).where("norm is not null")
    slim = own.select(*CELL, "keys", "fact_id", "doc_id", "predicate", "norm", "position", "inherited", "trusted")
    return compared(paired(written(slim, "signed-facts")))


def renewed(existing: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A verdict table after a new run: the judge's own rows stay, the comparator's are replaced."""
    return existing.where(F.col("reason_code").startswith("JUDGE:")).unionByName(verdicts)


def diff_text(diff: Column) -> Column:
    """A qualifier difference as JSON text."""
    return F.to_json(diff)
