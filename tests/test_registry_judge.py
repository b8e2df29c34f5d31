import json
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factloom.operators import judge, registry
from factloom.sources.clients import HashedEmbedder, Overloaded, Throttled, completed, embedded

FACTS = "fact_id string, doc_id string, entity_id string, predicate_id string, object_text string, claim_text string, value double, grounding_issues array<string>"


def test_clusters_by_class_are_those_of_one_loop(spark):
    rng = random.Random(3)
    words = ["Alpha", "Beta Ltd", "Alpha Limited", "Mr Beta", "Gamma 8", "Gamma 9", "The Gamma 8", "Delta of Alpha"]
    rows = [(w, rng.choice(["%", "₹", None])) for w in words for _ in range(rng.randint(1, 6))]
    facts = spark.createDataFrame(rows, "subject string, unit string")
    forms = registry.surface_forms(facts, "subject")
    vec = {w: [1.0, 0.01 * i, 0.0] for i, w in enumerate(words)}
    vectors = spark.createDataFrame(list(vec.items()), "form string, vec array<float>")
    got = {r.form: r for r in registry.build(forms, vectors, "entity", 0.82).collect()}
    assert got["Alpha"].id == got["Alpha Limited"].id and got["Beta Ltd"].id == got["Mr Beta"].id and got["Gamma 8"].id == got["The Gamma 8"].id
    assert got["Gamma 8"].id != got["Gamma 9"].id and got["Delta of Alpha"].id != got["Alpha"].id
    # One loop over all forms, in global order, with the gates inside.
    order = sorted(((r.form, r.n, r.units) for r in forms.collect()), key=lambda r: (-r[1], r[0]))
    key = {r.form: (tuple(r.t), tuple(r.d)) for r in forms.select("form", registry.content_tokens(F.col("form")).alias("t"), registry.digit_runs(F.col("form")).alias("d")).collect()}
    first: list = []
    own = {}
    for form, _, units in order:
        hit = next((k for k, (f, u) in enumerate(first) if key[f] == key[form] and registry.may_merge(set(u), set(units))), None)
        if hit is None:
            hit = len(first)
            first.append((form, units))
        own[form] = f"ent_{hit:04d}"
    assert {f: r.id for f, r in got.items()} == own
    table = registry.registry(registry.build(forms, vectors, "entity", 0.82), "entity")
    assert table.agg(F.sum("n")).first()[0] == len(rows)
    filled = registry.backfilled(facts.withColumn("entity_id", F.lit(None).cast("string")), registry.build(forms, vectors, "entity", 0.82), "subject", "entity_id")
    assert filled.where("entity_id is null").count() == 0


def test_unit_gate():
    assert registry.may_merge({"unknown"}, {"unknown"}) and registry.may_merge({"mass", "unknown"}, {"mass"}) and not registry.may_merge({"mass"}, {"other"})


def test_clustered_survives_zero_vectors():
    rows = pd.DataFrame({"form": ["a", "b"], "n": [2, 1], "rank": [1, 2], "units": [[], []], "vec": [[0.0, 0.0], [0.0, 0.0]]})
    assert np.isfinite(np.array(registry.clustered(rows, 0.5)["centroid"].tolist())).all()


def test_judge(spark):
    facts = spark.createDataFrame([("f1", "d1", "e", "p", "chief executive", "c1", None, []), ("f2", "d2", "e", "q", "chief exec", "c2", None, ["x"]), ("f3", "d2", "e", "p", "banana", "c3", None, []), ("f4", "d2", "e", "p", "chief executive", "c4", None, []), ("f5", "d3", "e", "p", "chief exec.", "c5", 1.0, [])], FACTS)
    documents = spark.createDataFrame([("d1", "One"), ("d2", "Two"), ("d3", "Three")], "doc_id string, title string")
    texts = facts.select("object_text").distinct()
    vectors, _ = embedded(texts, spark.createDataFrame([], "key string, model string, dims int, vec array<float>"), HashedEmbedder(), "object_text")
    pairs = judge.gate(facts, vectors)
    assert [(r.a.fact_id, r.b.fact_id) for r in pairs.collect()] == [("f1", "f2")]

    empty = spark.createDataFrame([], "key string, model string, response string, created_at timestamp")

    class Answer:
        model = "judge"

        def __init__(self, *judgements):
            self.text = json.dumps({"judgements": judgements})

        def __call__(self, prompt):
            assert "equivalent" in prompt and prompt.endswith("[0]\n  A (One): c1\n  B (Two): c2\n")
            return self.text

    given = Answer({"pair": 7, "relation": "equivalent"}, {"pair": 0, "relation": "equivalent", "rationale": "same"}, {"pair": 0, "relation": "contradiction"})
    rows, new = judge.judged(pairs, documents, given, empty)
    (row,) = rows.collect()
    assert (row.verdict, row.reason_code, row.trust, row.cross_document, row.explanation) == ("CORROBORATED", "JUDGE:EQUIVALENT", "low", True, "same  [judge]")
    assert judge.judged(pairs, documents, Answer({"pair": 0, "relation": "unrelated"}), empty)[0].count() == 0
    assert judge.judged(pairs, documents, Answer({"pair": 0}), empty)[0].count() == 0

    class Silent:
        model = "judge"

        def __call__(self, prompt):
            raise AssertionError("asked again")

    kept = spark.createDataFrame(new.collect(), new.schema)
    again, more = judge.judged(pairs, documents, Silent(), kept)
    assert [r.explanation for r in again.collect()] == ["same  [judge]"] and more.count() == 0


def test_gate_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(judge, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(f"f{k:03d}", f"d{k % 3}", "abc"[min(k % 7, 2)], "p", f"t{k // 2}", f"c{k}", None, []) for k in range(90)]
    vec = {f"t{k}": rng.integers(-2, 3, 3 if k % 5 else 2).astype(float).tolist() for k in range(45)}
    vec["t7"], vec["t8"] = [0.0, 0.0, 0.0], [1.0, None, 0.0]
    facts = spark.createDataFrame(rows, FACTS)
    vectors = spark.createDataFrame(list(vec.items()), "object_text string, vec array<double>")
    pairs = judge.gate(facts, vectors, 0.5)
    assert "CartesianProduct" not in (plan := pairs._jdf.queryExecution().toString()) and "MapInArrow" in plan
    unit = {t: np.array(v) / (np.linalg.norm(v) or 1) for t, v in vec.items() if None not in v}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] and a[4] != b[4] and a[4] in unit and b[4] in unit and len(unit[a[4]]) == len(unit[b[4]]) and unit[a[4]] @ unit[b[4]] >= 0.5 - 1e-12:
                want.add((a[2], a[0], b[0]))
    got = [(r.entity_id, r.a.fact_id, r.b.fact_id) for r in pairs.collect()]
    near = {r for r in want if abs(unit[rows[int(r[1][1:])][4]] @ unit[rows[int(r[2][1:])][4]] - 0.5) < 1e-12}
    assert len(got) == len(set(got)) and want - near <= set(got) <= want and len(got) > 100


class Flaky:
    model = "m"

    def __init__(self):
        self.calls = 0

    def __call__(self, prompt):
        self.calls += 1
        if self.calls < 3:
            raise Overloaded(503)
        return prompt.upper()


def test_throttle_repeats_and_falls_back():
    pauses = []
    client = Throttled(Flaky(), sleep=pauses.append)
    assert client("x") == "X" and 5 in pauses and 10 in pauses

    class Down:
        model = "d"

        def __call__(self, prompt):
            raise Overloaded(429)

    assert Throttled(Down(), fallback=lambda p: "f", sleep=lambda s: None)("x") == "f"


def test_cache_answers_what_was_asked(spark):
    class Once:
        model = "m"

        def __call__(self, prompt):
            if prompt == "bad":
                raise ValueError("no")
            return prompt + "!"

    empty = spark.createDataFrame([], "key string, model string, response string, created_at timestamp")
    prompts = spark.createDataFrame([("a",), ("a",), ("bad",)], "prompt string")
    found, new = completed(prompts, empty, Once())
    rows = {r.prompt: r for r in found.collect()}
    assert rows["a"].response == "a!" and rows["bad"].error.startswith("ValueError")
    cache = spark.createDataFrame(new.collect(), new.schema)

    class Never:
        model = "m"

        def __call__(self, prompt):
            raise AssertionError

    found, _ = completed(prompts.where("prompt = 'a'"), cache, Never())
    assert [r.response for r in found.collect()] == ["a!"]
