"""Table schemas: payloads that are open-ended stay nested columns, never JSON text."""

from __future__ import annotations

DOCUMENTS = "doc_id string, path string, title string, context string, added_at timestamp"
PAGES = "doc_id string, page_index int, labels array<string>, page_hash string, width double, height double, route string, extracted boolean"
BLOCKS = "doc_id string, page_index int, ord int, x0 double, y0 double, x1 double, y1 double, text string"
QUALIFIERS = "array<struct<key:string,value:string>>"
CLAIM = (
    "claim_text string, subject string, predicate string, object_text string, value double, unit string, value_type string, "
    f"qualifiers {QUALIFIERS}, modality string, approximate boolean, confidence double, block_ids array<int>"
)
FACTS = f"fact_id string, doc_id string, page_index int, {CLAIM}, grounding_issues array<string>, source_modality string, created_at timestamp, entity_id string, predicate_id string"
REGISTRY = "kind string, id string, canonical string, surface_forms array<string>, centroid array<float>, n long"
VERDICTS = (
    "verdict_id string, verdict string, reason_code string, fact_a string, fact_b string, entity_id string, predicate_id string, "
    "qualifier_diff map<string,array<string>>, delta double, tolerance double, cross_document boolean, trust string, explanation string"
)
JOBS = "job_id string, filename string, status string, detail string, started_at timestamp"
COMPLETIONS = "key string, model string, response string, created_at timestamp"
EMBEDDINGS = "key string, model string, dims int, vec array<float>"
CONTEXT_CARD = "issuer string, doc_type string, reporting_period string, as_of string, summary string"
JUDGEMENTS = "array<struct<pair:int,relation:string,rationale:string>>"
