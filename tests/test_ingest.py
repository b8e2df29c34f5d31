import json
import re

from factloom.operators import evidence, layout
from factloom.plans import pipeline
from factloom.sources import pages, store
from factloom.sources.clients import HashedEmbedder
from factloom.streaming.incremental import ingest_stream


class Model:
    """Answers every page with one claim about the first figure that it sees."""

    model = "stub"

    def __call__(self, prompt: str) -> str:
        if "[b" not in prompt:
            return json.dumps({"issuer": "ACME", "doc_type": "report", "reporting_period": "FY24", "as_of": "2024", "summary": "s"})
        value = float(re.search(r"\] [^\n]*?(\d+\.?\d*)", prompt)[1])
        claim = {"claim_text": f"revenue {value}", "subject": "ACME Ltd", "predicate": "revenue", "object_text": str(value), "value": value, "unit": "INR million", "value_type": "quantity", "qualifiers": [{"key": "period", "value": "FY24"}], "modality": "asserted", "approximate": False, "confidence": 1.0, "block_ids": [0, 99]}
        return json.dumps({"claims": [claim, claim | {"block_ids": [77]}]})


def test_files_to_verdicts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Revenue 100.5\n\nnote\tside\f page two 7 \n")
    (folder / "b.txt").write_text("Revenue was 90.5 in all\n")
    kept = store.Store(spark, str(tmp_path / "store"))
    assert pipeline.ingest_path(kept, str(folder)) == {"added": 3, "skipped": 0}
    assert pipeline.ingest_path(kept, str(folder)) == {"added": 0, "skipped": 3}
    assert kept.read("documents").count() == 2
    (folder / "c.txt").write_text("Revenue was 91 here\n")
    query = ingest_stream(kept, str(folder), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None and kept.read("pages").count() == 4
    assert pipeline.extract(kept, Model()) == 4
    assert pipeline.extract(kept, Model()) == 0
    facts = kept.read("facts").collect()
    assert all(f.block_ids == [0] and f.grounding_issues == [] for f in facts)
    assert pipeline.resolve(kept, HashedEmbedder()) == {"entity": 1, "predicate": 1}
    counts = {r.verdict: r["count"] for r in pipeline.reconcile_all(kept).collect()}
    assert counts["CONTRADICTION"] == 5 and sum(counts.values()) == 6  # 91 and 90.5 agree within what 91 shows
    clips = evidence.clips(kept.read("facts"), kept.read("blocks"), kept.read("pages")).collect()
    assert len(clips) == 4 and all(0 <= c.x0 < c.x1 <= 612 and 90 <= c.y1 - c.y0 + 40 for c in clips)
    pages_read = store.page_blocks(kept.read("blocks"), facts[0].doc_id, 0)
    assert [r.ord for r in pages_read.collect()] == list(range(pages_read.count()))


def test_columns_are_not_spliced(spark):
    lines = [("d", 0, 612.0, 792.0, None, 0, i * 10 + k, 40.0 + 300 * k, 50.0 + 12 * i, 100.0 + 300 * k, 60.0 + 12 * i, t) for i, row in enumerate([("Name one", "id 1"), ("Name two", "id 2")]) for k, t in enumerate(row)]
    frame = spark.createDataFrame(lines, f"doc_id string, {pages.LINES}")
    blocks = layout.reading_order(layout.split_blocks(frame)).orderBy("ord").collect()
    assert [b.text for b in blocks] == ["Name one\nName two", "id 1\nid 2"]
    text = layout.page_text(spark.createDataFrame([("d", 0, 0, 0.5, 1.5, 2.5, 3.49, "a\nb")], "doc_id string, page_index int, ord int, x0 double, y0 double, x1 double, y1 double, text string")).first()
    assert text.layout_text == "[b0 0,2 2,3] a / b" and text.text == "a\nb"


def test_of_equal_pages_the_first_stays(spark):
    rows = spark.createDataFrame([("d", 3, "h"), ("d", 1, "h"), ("e", 2, "h")], "doc_id string, page_index int, page_hash string")
    assert sorted(tuple(r) for r in store.new_pages(rows.limit(0), rows).select("doc_id", "page_index").collect()) == [("d", 1), ("e", 2)]
