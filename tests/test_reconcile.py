"""The decision table, its invariants, and the golden counts of the facts view."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import cells, reconcile
from factloom.plans import facts as report

from conftest import SMALL

SCHEMA = "fact_id string, doc_id string, predicate string, value double, unit string, qualifiers array<struct<key:string,value:string>>, grounding_issues array<string>"


def facts(spark, *rows):
    made = [(f"f{i}", doc, predicate, value, "INR million", list(quals.items()) if isinstance(quals, dict) else quals, issues) for i, (doc, predicate, value, quals, issues) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).withColumns({"entity_id": F.lit("e"), "predicate_id": F.lit("p")})


def verdicts(spark, *rows):
    return {(r.fact_a, r.fact_b): r for r in reconcile.reconcile(facts(spark, *rows)).collect()}


FY24 = {"period": "FY24", "basis": "standalone"}


@pytest.mark.parametrize(
    ("rows", "verdict", "reason"),
    [
        ([("d1", "revenue", 81415.38, FY24, []), ("d2", "revenue", 72253.01, FY24, [])], "CONTRADICTION", "SAME_CELL_DISAGREE"),
        ([("d1", "revenue", 81415.38, FY24, []), ("d2", "revenue", 81415.38, FY24, [])], "CORROBORATED", "SAME_CELL_AGREE"),
        ([("d1", "total income", 81415.38, {"period": "FY24"}, []), ("d2", "finance income", 72253.01, {"period": "FY24"}, [])], "INSUFFICIENT_CONTEXT", "PREDICATE_UNCERTAIN"),
        ([("d1", "revenue", 1.2, {"period": "Q2 FY25"}, []), ("d2", "revenue", 0.2, {"period": "2025Q2"}, [])], "VARIANT_EXPLAINED_BY", "QUALIFIER_DIFF:period"),
        ([("d1", "revenue", 1.2, {"period": "FY25"}, []), ("d2", "revenue", 0.2, {"period": "FY2024-25"}, ["value 0.2 not in cited blocks"])], "INSUFFICIENT_CONTEXT", "INHERITED_QUALIFIER"),
        ([("d1", "revenue", 1.2, {"period": "FY25"}, []), ("d2", "revenue", 0.2, {}, [])], "INSUFFICIENT_CONTEXT", "MISSING_QUALIFIER:period"),
        ([("d1", "revenue", 1.2, {"period": "FY25"}, []), ("d2", "revenue", 1.2, None, [])], "CORROBORATED", "AGREE_ON_SHARED_QUALIFIERS"),
    ],
)
def test_decision_table(spark, rows, verdict, reason):
    (found,) = verdicts(spark, *rows).values()
    assert (found.verdict, found.reason_code) == (verdict, reason)
    turned = verdicts(spark, *rows[::-1])
    assert [(v.verdict, v.reason_code) for v in turned.values()] == [(verdict, reason)]


def test_no_row(spark):
    assert not verdicts(spark, ("d1", "r", None, FY24, []), ("d2", "r", 1.0, FY24, []))
    assert not verdicts(spark, ("d1", "r", 1.0, {"period": "FY24", "basis": "a"}, []), ("d2", "r", 2.0, {"period": "FY23", "basis": "b"}, []))
    assert not verdicts(spark, ("d1", "r", 1.0, {"period": "FY24"}, []), ("d2", "r", 1.0, {"period": "FY23"}, []))


def test_keys_that_differ_discriminate(spark):
    rows = [("d", "r", 1.0, q, []) for q in ({"period": "FY24", "basis": "standalone"}, {"period": "FY24", "basis": "consolidated"}, {"period": "FY2023-24"}, {"Period": "FY24"})]
    assert reconcile.discriminating_keys(reconcile.prepared(facts(spark, *rows))).first()["keys"] == ["basis"]


def test_the_last_of_repeated_keys_counts(spark):
    rows = [("d1", "r", 1.0, [("Basis", "a"), ("basis", "b")], []), ("d2", "r", 5.0, [("basis", "a")], [])]
    (found,) = verdicts(spark, *rows).values()
    assert found.reason_code == "QUALIFIER_DIFF:basis" and found.qualifier_diff == {"basis": ["b", "a"]}


def test_empty(spark):
    assert reconcile.reconcile(facts(spark, ("d", "r", 1.0, FY24, [])).limit(0)).count() == 0


GOLDEN = {
    "QUALIFIER_DIFF:period": 75_614,
    "QUALIFIER_DIFF:basis": 4_955,
    "SAME_CELL_AGREE": 2_303,
    "AGREE_ON_SHARED_QUALIFIERS": 691,
    "MISSING_QUALIFIER:basis": 248,
    "INHERITED_QUALIFIER": 23,
    "PREDICATE_UNCERTAIN": 3,
    "SAME_CELL_DISAGREE": 66,
}


def test_golden_counts(spark):
    found = reconcile.reconcile(report.facts(spark, SMALL)).select("verdict", "reason_code", "trust", "delta", "tolerance", "verdict_id").collect()
    assert Counter(r.reason_code for r in found) == GOLDEN
    assert all(r.trust == "high" for r in found if r.verdict == "CONTRADICTION")
    assert all(r.trust == "low" for r in found if r.reason_code == "INHERITED_QUALIFIER")
    assert all(r.delta is not None and r.tolerance is not None for r in found)
    assert len({r.verdict_id for r in found}) == len(found)


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Signatures with gaps, by blocks, dealt blocks and whole cells, against a plain loop."""
    rng = random.Random(5)
    rows = []
    for _ in range(90):
        quals = {k: rng.choice(("x", "y", "z")) for k in ("basis", "segment", "scope") if rng.random() < 0.8}
        rows.append((rng.choice(("d1", "d2")), "revenue", float(rng.randint(1, 3)), quals, []))
    rows += rows[:5]
    want = {}
    for (i, a), (j, b) in ((x, y) for x in enumerate(rows) for y in enumerate(rows)):
        if f"f{i}" < f"f{j}":
            clash = [k for k in a[3] if k in b[3] and a[3][k] != b[3][k]]
            if not clash:
                want[f"f{i}", f"f{j}"] = abs(a[2] - b[2]) <= 1  # each is printed to a half
            elif len(clash) == 1 and abs(a[2] - b[2]) > 1:
                want[f"f{i}", f"f{j}"] = clash[0]
    for few, share in ((0, 500), (0, 3), (10**6, 500), (10**6, 7)):
        monkeypatch.setattr(reconcile, "FEW", few)
        monkeypatch.setattr(reconcile, "SHARE", share)
        found = reconcile.reconcile(facts(spark, *rows)).select("fact_a", "fact_b", "verdict", "reason_code").collect()
        got = {(r.fact_a, r.fact_b): r.reason_code.split(":")[1] if r.reason_code.startswith("QUALIFIER_DIFF") else r.verdict == "CORROBORATED" for r in found}
        assert len(found) == len(got) and got == want


def test_grid_conflict(spark):
    rows = [("d1", "r", 1.0, FY24, []), ("d2", "r", 9.0, FY24, []), ("d2", "r", 3.0, {"period": "FY23", "basis": "standalone"}, []), ("d2", "r", None, {}, [])]
    got = {r.fact_id: (r.row_val, r.col_val, r.conflict) for r in cells.grid(reconcile.prepared(facts(spark, *rows))).collect()}
    assert got["f0"] == ("2024", "standalone", True) and got["f1"][2] and got["f2"] == ("2023", "standalone", False) and got["f3"] == ("—", "—", False)
    whole = cells.summary(reconcile.prepared(facts(spark, *rows))).first()
    assert (whole.row_key, whole.col_key, whole.n_facts) == ("period", "basis", 4)
