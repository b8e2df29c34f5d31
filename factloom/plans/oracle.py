"""DuckDB SQL for the fact layer's queries, written against the same tables."""

from __future__ import annotations

from .facts import FACTS_SQL, VERDICTS_SQL

# What each unit wording of the queries parses to: unit, currency, magnitude, dimension, residual, class.
UNIT_ROWS = """(VALUES
  ('₹ million', 'INR', 1e6, 'currency', '', 'currency'), ('Cr', NULL, 1e7, 'magnitude', '', 'other'), ('crores', NULL, 1e7, 'magnitude', '', 'other'),
  ('Indian Rupees in millions', 'INR', 1e6, 'currency', 'indian', 'currency'), ('INR million', 'INR', 1e6, 'currency', '', 'currency'), ('Mn Tons', NULL, 1e6, 'mass', 'tons', 'mass'),
  ('%', NULL, 1, 'ratio', '%', 'ratio'), ('percent of revenue', NULL, 1, 'ratio', '%', 'ratio'), ('''000 Tons', NULL, 1e3, 'mass', 'tons', 'mass'),
  ('US$ bn', 'USD', 1e9, 'currency', 'us', 'currency'), ('shipments', NULL, 1, 'count', 'shipments', 'other'), ('lakh shares', NULL, 1e5, 'count', 'shares', 'other'),
  ('€ k', 'EUR', 1e3, 'currency', '', 'other'), ('  ', NULL, 1, 'magnitude', '', 'other'), ('', NULL, 1, 'unknown', '', 'unknown'),
  ('kg per unit', NULL, 1, 'mass', 'kg unit', 'other'), ('rs', 'INR', 1, 'currency', '', 'currency'), ('hours', NULL, 1, 'count', 'hours', 'currency'),
  ('cartons', NULL, 1, 'mass', 'cartons', 'mass'), (NULL, NULL, 1, 'unknown', '', 'unknown')) u(unit, currency, magnitude, dimension, residual, unit_class)"""


def tolerance(value: str, magnitude: str) -> str:
    t = f"format('{{:.10g}}', abs({value}))"
    return f"""CASE WHEN {value} = 0 THEN {magnitude} * 0.5
      WHEN contains({t}, '.') THEN 0.5::DOUBLE * CAST('1e-' || length(split_part({t}, '.', 2)) AS DOUBLE) * {magnitude}
      ELSE 0.5::DOUBLE * CAST('1e' || (length({t}) - length(rtrim({t}, '0'))) AS DOUBLE) * {magnitude} END"""


LINES = """lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS line, l_linenumber % 2 AS raw_block, CAST(min(l_partkey) % 40 * 12 AS DOUBLE) + 0.5::DOUBLE AS x0,
         CAST(min(l_suppkey) % 60 * 12 AS DOUBLE) AS y0, CAST(min(l_partkey) % 40 * 12 + CAST(min(l_quantity) AS INTEGER) AS DOUBLE) AS x1,
         CAST(min(l_suppkey) % 60 * 12 + 10 AS DOUBLE) AS y1, 'item ' || min(l_partkey) AS word
  FROM lineitem GROUP BY ALL
)"""


def bands(edges: str) -> str:
    """Band edges of a list: each further than 5 % of the page from the edge before."""
    return f"list_reduce(list_transform(list_sort({edges}), lambda e: [e]), lambda acc, e: CASE WHEN e[1] - acc[-1] > 612.0::DOUBLE * 0.05::DOUBLE THEN list_concat(acc, e) ELSE acc END)"


BAND_OF = "len(list_filter({b}, lambda b: {x} >= b - 0.01::DOUBLE)) - 1"

LIBRARY = """pages AS (
  SELECT coalesce(source, '(none)') AS doc_id, CAST(doc_id AS INTEGER) AS page_index, sha256(text) AS page_hash, doc_id % 2 = 0 AS extracted, text, string_split(text, chr(10)) AS rows FROM documents
), library AS (SELECT coalesce(source, '(none)') AS doc_id, min(doc_id) AS added_at, upper(coalesce(source, '(none)')) AS title FROM documents GROUP BY ALL)"""
GATE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
      u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
      gate AS (SELECT CAST(a.label AS VARCHAR) AS entity_id, a.vec_id AS a, b.vec_id AS b, 'v' || lpad(CAST(a.vec_id AS VARCHAR), 8, '0') AS fact_a, 'v' || lpad(CAST(b.vec_id AS VARCHAR), 8, '0') AS fact_b
      FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id % 5 <> b.vec_id % 5 WHERE list_dot_product(a.e, b.e) >= 0.3)"""

NOTICES = """notices AS (
  SELECT o_orderkey, o_totalprice,
         CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
         CASE o_orderkey % 4 WHEN 1 THEN round_even(o_totalprice, 0) ELSE o_totalprice END AS printed
  FROM orders
)"""

CARRIERS = """stated AS (
  SELECT entity_id, predicate_id, fact_id, 'period' AS k, period AS v FROM facts UNION ALL SELECT entity_id, predicate_id, fact_id, 'basis', basis FROM facts WHERE basis IS NOT NULL
), cells AS (SELECT entity_id, predicate_id, count(*) AS n_facts FROM facts GROUP BY ALL
), spread AS (
  SELECT entity_id, predicate_id, k, count(DISTINCT v) AS n_values, count(DISTINCT fact_id) AS carriers FROM stated GROUP BY ALL
), keys AS (
  SELECT *, n_values >= 2 OR (n_facts > 1 AND carriers < n_facts) AS discriminating FROM spread JOIN cells USING (entity_id, predicate_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, predicate_id ORDER BY n_values DESC, k) AS axis FROM keys WHERE discriminating
), axes AS (
  SELECT entity_id, predicate_id, max(CASE WHEN axis = 1 THEN k END) AS row_key, max(CASE WHEN axis = 2 THEN k END) AS col_key FROM ranked GROUP BY ALL
), placed AS (
  SELECT f.*, row_key, col_key, coalesce(CASE row_key WHEN 'period' THEN period WHEN 'basis' THEN basis END, '—') AS row_val, coalesce(CASE col_key WHEN 'period' THEN period WHEN 'basis' THEN basis END, '—') AS col_val
  FROM facts f LEFT JOIN axes USING (entity_id, predicate_id)
)"""

DATE = r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
SCIENCE = "CASE WHEN x = 0 THEN '0' ELSE format('{:.9e}', x) END"

ORACLES: dict[str, str] = {
    "unit_parse": f"SELECT r_regionkey, unit, currency, CAST(magnitude AS DOUBLE) AS magnitude, dimension, residual, unit_class FROM region, {UNIT_ROWS}",
    "unit_comparable": f"""SELECT a.unit AS unit_a, b.unit AS unit_b,
      a.dimension = 'unknown' OR b.dimension = 'unknown' OR ((a.dimension = b.dimension OR (a.dimension IN ('magnitude', 'currency') AND b.dimension IN ('magnitude', 'currency')))
        AND (a.currency IS NULL OR b.currency IS NULL OR a.currency = b.currency)) AS comparable
      FROM {UNIT_ROWS.replace(" u(unit", " a(unit")}, {UNIT_ROWS.replace(" u(unit", " b(unit")}""",
    "precision_tolerance": f"""WITH v AS (SELECT l_orderkey AS k, l_extendedprice AS value FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT l_partkey, CAST(l_partkey * 10 AS DOUBLE) FROM lineitem)
      SELECT k, value, {tolerance("value", "1e6::DOUBLE")} AS tolerance FROM v""",
    "value_normalise": f"""WITH v AS (SELECT o_orderkey, o_totalprice AS v, CASE o_orderkey % 3 WHEN 0 THEN 1e7::DOUBLE WHEN 1 THEN 1e5::DOUBLE ELSE 1::DOUBLE END AS m FROM orders)
      SELECT o_orderkey, v * m AS value, {tolerance("v", "m")} AS tolerance, CASE WHEN o_orderkey % 3 = 0 THEN 'INR' END AS currency,
        CASE o_orderkey % 3 WHEN 0 THEN 'currency' WHEN 1 THEN 'magnitude' ELSE 'unknown' END AS dimension FROM v""",
    "value_shown": r"SELECT o_orderkey, regexp_replace(format('{:,.2f}', o_totalprice), '\.?0+$', '') AS shown, regexp_replace(format('{:,.2f}', CAST(o_custkey AS DOUBLE)), '\.?0+$', '') AS shown_key FROM orders",
    "period_normalise": """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, year(o_orderdate) AS y, quarter(o_orderdate) AS q, strftime(o_orderdate, '%y') AS short FROM orders)
      SELECT o_orderkey, CASE k WHEN 0 THEN 'Q' || q || ' FY' || y WHEN 1 THEN y || 'Q' || q WHEN 2 THEN 'year ended March 31, ' || y WHEN 3 THEN 'nine months ended December 31, ' || y
          WHEN 4 THEN 'H' || CASE WHEN q <= 2 THEN 1 ELSE 2 END || ' of financial year ' || y WHEN 5 THEN 'FY''' || short WHEN 6 THEN y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') ELSE 'to date' END AS label,
        CASE k WHEN 0 THEN y || 'Q' || q || 'F' WHEN 1 THEN y || 'Q' || q || 'C' WHEN 2 THEN CAST(y AS VARCHAR) WHEN 3 THEN y || 'PARTIAL'
          WHEN 4 THEN y || 'H' || CASE WHEN q <= 2 THEN 1 ELSE 2 END || 'F' WHEN 5 THEN '20' || short WHEN 6 THEN CAST(greatest(y, y // 100 * 100 + (y + 1) % 100) AS VARCHAR) END AS period FROM o""",
    "qualifier_keys": r"""WITH r AS (SELECT n_nationkey, unnest([n_name, '  ' || n_name || ' Date ', 'As Of', 'as_of_date', 'Reporting Period', '--' || n_name || '__dt', 'Fiscal-Year']) AS raw, unnest(range(7)) AS i FROM nation),
      t AS (SELECT n_nationkey, CAST(i AS INTEGER) AS i, regexp_replace(trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '_'), '_(date|dt)$', '') AS k FROM r)
      SELECT n_nationkey, i, CASE WHEN k IN ('asof', 'as_on') THEN 'as_of' WHEN k IN ('period_end', 'reporting_period', 'fiscal_year', 'financial_year', 'year') THEN 'period' ELSE k END AS k FROM t""",
    "qualifier_text": f"""WITH {FACTS_SQL} SELECT fact_id, CASE doc_id
        WHEN 'A' THEN 'Reporting period ' || fiscal || '  basis ' || basis WHEN 'C' THEN 'fiscal year ' || fiscal || '  basis ' || basis
        ELSE 'period ' || CASE WHEN ends_with(period, 'C') THEN rtrim(period, 'C') ELSE fiscal END || coalesce('  Basis ' || upper(basis), '') END AS text
      FROM (SELECT *, 'Q' || period[6:6] || ' FY' || period[1:4] AS fiscal FROM facts)""",
    "ground_numbers": rf"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(\d[\d,]*\.?\d*)', 1), lambda s: CAST(replace(s, ',', '') AS DOUBLE)) AS plain,
        list_transform(regexp_extract_all(text, '\(\s*(\d[\d,]*\.?\d*)\s*[^)\d]{{0,8}}\)', 1), lambda s: -CAST(replace(s, ',', '') AS DOUBLE)) AS neg FROM documents)
      SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(plain, neg), lambda x: {SCIENCE}))), ' ') AS numbers FROM t""",
    "ground_dates": f"WITH {NOTICES.replace('round_even(o_totalprice, 0)', 'o_totalprice')} SELECT o_orderkey, lower(regexp_replace(date, '[ ,]+', ' ', 'g')) AS dates FROM notices",
    "grounding_issues": f"""WITH {NOTICES}, t AS (
        SELECT o_orderkey, o_orderkey % 4 = 1 AND round_even(o_totalprice, 0) <> o_totalprice AS value_issue,
          o_orderkey % 5 = 0 AND date <> 'March 31, 2001' AS late, 'effective=March 31, 2001 not in cited blocks' AS said FROM notices)
      SELECT o_orderkey, CAST(value_issue AS BIGINT) + CAST(late AS BIGINT) AS n_issues, value_issue, CASE WHEN late THEN said END AS date_issue, value_issue OR late AS inherited FROM t""",
    "discriminating_keys": f"WITH {FACTS_SQL}, {CARRIERS} SELECT entity_id, predicate_id, k, n_values, carriers, n_facts, discriminating FROM keys",
    "cell_signatures": f"WITH {FACTS_SQL} SELECT fact_id, CASE WHEN basis IS NULL THEN 'period=' || period ELSE 'basis=' || basis || ';period=' || period END AS sig FROM facts",
    "reconcile_verdicts": f"WITH {VERDICTS_SQL} SELECT verdict_id, verdict, reason_code, fact_a, fact_b, entity_id, delta, tolerance, cross_document, trust FROM verdicts",
    "verdict_diffs": f"""WITH {VERDICTS_SQL}, sides AS (SELECT v.reason_code, v.fact_a, v.fact_b, a.period AS pa, b.period AS pb, a.basis AS ba, b.basis AS bb, a.predicate AS wa, b.predicate AS wb
        FROM verdicts v JOIN facts a ON a.fact_id = v.fact_a JOIN facts b ON b.fact_id = v.fact_b)
      SELECT fact_a, fact_b, 'period' AS k, pa AS value_a, pb AS value_b FROM sides WHERE reason_code = 'QUALIFIER_DIFF:period'
      UNION ALL SELECT fact_a, fact_b, 'basis', ba, bb FROM sides WHERE reason_code = 'QUALIFIER_DIFF:basis'
      UNION ALL SELECT fact_a, fact_b, 'basis', ba, bb FROM sides WHERE reason_code IN ('AGREE_ON_SHARED_QUALIFIERS', 'MISSING_QUALIFIER:basis') AND (ba IS NULL) <> (bb IS NULL)
      UNION ALL SELECT fact_a, fact_b, 'predicate', wa, wb FROM sides WHERE reason_code = 'PREDICATE_UNCERTAIN'""",
    "verdict_counts": f"WITH {VERDICTS_SQL} SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict",
    "verdict_reasons": f"WITH {VERDICTS_SQL} SELECT verdict, reason_code, count(*) AS n FROM verdicts GROUP BY ALL",
    "verdicts_renewed": f"""WITH {VERDICTS_SQL} SELECT verdict, reason_code, count(*) AS n FROM verdicts GROUP BY ALL
      UNION ALL SELECT verdict, 'JUDGE:CONTRADICTION', count(*) FROM verdicts WHERE verdict = 'CONTRADICTION' GROUP BY verdict""",
    "verdict_ids": """WITH n AS (SELECT o_orderkey, o_custkey, least('o' || o_orderkey, 'c' || o_custkey) || '|' || greatest('o' || o_orderkey, 'c' || o_custkey) AS pair FROM orders),
      h AS (SELECT o_orderkey, o_custkey, sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(pair || '|cmp')) AS c, sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(pair || '|judge')) AS j FROM n),
      d AS (SELECT o_orderkey, o_custkey, c[1:8] || '-' || c[9:12] || '-5' || c[14:16] || '-' || lower(to_hex((CAST('0x' || c[17:17] AS INTEGER) & 3) | 8)) || c[18:20] || '-' || c[21:32] AS c,
        j[1:8] || '-' || j[9:12] || '-5' || j[14:16] || '-' || lower(to_hex((CAST('0x' || j[17:17] AS INTEGER) & 3) | 8)) || j[18:20] || '-' || j[21:32] AS j FROM h)
      SELECT o_orderkey, o_custkey, c AS id_ab, c AS id_ba, j AS id_judge FROM d""",
    "cross_doc_contradictions": f"""WITH {VERDICTS_SQL} SELECT verdict_id, entity_id AS entity, 'revenue' AS predicate, delta, tolerance, trust, claim_a, claim_b,
        CASE fact_a[1:1] WHEN 'A' THEN 'Annual report' WHEN 'B' THEN 'Investor letter' ELSE 'Filing' END AS document_a, CASE fact_b[1:1] WHEN 'A' THEN 'Annual report' WHEN 'B' THEN 'Investor letter' ELSE 'Filing' END AS document_b,
        CAST(split_part(fact_a, '|', 4) AS INTEGER) AS page_a
      FROM verdicts WHERE verdict = 'CONTRADICTION' AND (lower(claim_a) LIKE '%revenue%' OR lower(claim_b) LIKE '%revenue%') ORDER BY cross_document DESC, verdict_id LIMIT 50""",
    "verdict_detail": f"""WITH {VERDICTS_SQL} SELECT verdict_id, reason_code, fact_a, fact_b, fact_a[1:1] || '-' || (CAST(split_part(fact_a, '|', 4) AS INTEGER) - 1) AS labels_a,
        fact_b[1:1] || '-' || (CAST(split_part(fact_b, '|', 4) AS INTEGER) - 1) AS labels_b, delta <= tolerance AS within FROM verdicts ORDER BY verdict_id LIMIT 1""",
    "entity_leaderboard": f"WITH {VERDICTS_SQL} SELECT entity_id, entity_id AS canonical, count(*) AS n FROM verdicts GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 30",
    "cell_axes": f"WITH {FACTS_SQL}, {CARRIERS} SELECT entity_id, predicate_id, CAST(axis AS INTEGER) AS axis, k, n_values FROM ranked WHERE axis <= 2",
    "cell_grid": f"""WITH {FACTS_SQL}, {CARRIERS}, squares AS (
        SELECT entity_id, predicate_id, row_val, col_val, count(base_value) > 1 AND max(base_value) - min(base_value) > 2 * any_value(most) AS conflict
        FROM placed JOIN (SELECT entity_id, predicate_id, max(tolerance) AS most FROM facts GROUP BY ALL) USING (entity_id, predicate_id) GROUP BY ALL)
      SELECT fact_id, row_key, col_key, row_val, col_val, conflict FROM placed JOIN squares USING (entity_id, predicate_id, row_val, col_val)""",
    "cell_summary": f"""WITH {FACTS_SQL}, {CARRIERS} SELECT entity_id, row_key, col_key, array_to_string(list_sort(list_distinct(list(row_val))), ';') AS rows,
        array_to_string(list_sort(list_distinct(list(col_val))), ';') AS cols, count(*) AS n_facts FROM placed GROUP BY entity_id, predicate_id, row_key, col_key""",
    "cell_candidates": f"""WITH {FACTS_SQL} SELECT entity_id, predicate_id, count(*) AS n, count(DISTINCT doc_id) AS docs, entity_id AS entity, 'revenue' AS predicate FROM facts
      GROUP BY entity_id, predicate_id HAVING count(*) > 1 ORDER BY docs DESC, n DESC, entity_id, predicate_id LIMIT 40""",
    "facts_search": f"""WITH {FACTS_SQL} SELECT fact_id, CASE doc_id WHEN 'A' THEN 'Annual report' WHEN 'B' THEN 'Investor letter' ELSE 'Filing' END AS title, page_index, claim_text, value, unit
      FROM facts WHERE lower(claim_text) LIKE '%brand#1% sales%' ORDER BY doc_id, page_index, fact_id LIMIT 80""",
    "entities_search": f"WITH {FACTS_SQL} SELECT entity_id AS id, entity_id AS canonical, count(*) AS n FROM facts WHERE lower(entity_id) LIKE '%brand#_2%' GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 100",
    "largest_entities": f"WITH {FACTS_SQL} SELECT entity_id AS id, entity_id AS canonical, count(*) AS n FROM facts GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 40",
    "fact_totals": f"WITH {FACTS_SQL} SELECT count(*) AS n_facts, count(DISTINCT entity_id) AS n_entities, count(DISTINCT predicate_id) AS n_predicates FROM facts",
    "document_inventory": f"WITH {LIBRARY} SELECT doc_id, title, added_at, count(*) AS n_pages, CAST(sum(len(rows) - 1) AS BIGINT) AS n_facts FROM library JOIN pages USING (doc_id) GROUP BY ALL",
    "document_status": f"WITH {LIBRARY} SELECT doc_id, title, count(*) AS n_pages, CAST(sum(len(rows)) AS BIGINT) AS n_blocks FROM library JOIN pages USING (doc_id) GROUP BY ALL",
    "document_detail": f"WITH {LIBRARY} SELECT doc_id, upper(doc_id) AS title, (SELECT CAST(sum(len(rows) - 1) AS BIGINT) FROM pages WHERE doc_id = 'src1') AS n_facts, page_index, CAST(page_index AS VARCHAR) AS labels, extracted FROM pages WHERE doc_id = 'src1'",
    "jobs_latest": "SELECT 'job' || event_id AS job_id, event_type AS status FROM events ORDER BY ts DESC, 'job' || event_id LIMIT 5",
    "page_hash_dedupe": f"""WITH {LIBRARY}, firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_hash ORDER BY page_index) AS n FROM pages)
      SELECT doc_id, page_index, page_hash FROM firsts f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM pages k WHERE k.page_index % 3 = 0 AND k.doc_id = f.doc_id AND k.page_hash = f.page_hash)""",
    "file_ids": "SELECT doc_id, sha256(text)[1:16] AS file_id FROM documents",
    "context_prompts": f"""WITH {LIBRARY}, firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS n FROM pages),
      t AS (SELECT doc_id, left(string_agg(text, chr(10) || chr(10) ORDER BY n), 12000) AS prompt FROM firsts WHERE n <= 2 GROUP BY doc_id)
      SELECT doc_id, CAST(length(prompt) AS INTEGER) AS size, sha256(prompt) AS digest FROM t""",
    "cited_claims": """WITH b AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS ord, min('part ' || l_partkey) AS text FROM lineitem GROUP BY ALL),
      c AS (SELECT a.doc_id, a.ord AS claim, a.text, f.text AS far, n.text AS next FROM b a LEFT JOIN b f ON f.doc_id = a.doc_id AND f.ord = a.ord + 7 LEFT JOIN b n ON n.doc_id = a.doc_id AND n.ord = a.ord + 1)
      SELECT doc_id, claim, concat_ws(';', CASE WHEN far IS NOT NULL THEN claim + 7 END, claim, CASE WHEN next IS NOT NULL THEN claim + 1 END, claim) AS block_ids, concat_ws(' ', far, text, next, text) AS cited_text FROM c""",
    "column_bands": f"""WITH {LINES}, t AS (SELECT doc_id, {bands("list(x0)")} AS b FROM lines GROUP BY doc_id)
      SELECT doc_id, len(b) AS n_bands, array_to_string(list_transform(b, lambda x: CAST(CAST(floor(x) AS INTEGER) AS VARCHAR)), ';') AS bands FROM t""",
    "layout_blocks": f"""WITH {LINES}, raw AS (SELECT doc_id, raw_block, {bands("list(x0)")} AS b FROM lines GROUP BY ALL),
      banded AS (SELECT l.*, {BAND_OF.format(b="r.b", x="l.x0")} AS piece FROM lines l JOIN raw r USING (doc_id, raw_block)),
      pieces AS (SELECT doc_id, raw_block, piece, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(word, chr(10) ORDER BY banded.y0, line) AS text FROM banded GROUP BY ALL),
      whole AS (SELECT doc_id, {bands("list(x0)")} AS b FROM pieces GROUP BY doc_id),
      placed AS (SELECT p.*, {BAND_OF.format(b="w.b", x="p.x0")} AS band FROM pieces p JOIN whole w USING (doc_id))
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY band, y0, raw_block, piece) - 1 AS INTEGER) AS ord, CAST(band AS INTEGER) AS band, x0, y0, x1, y1, text FROM placed""",
    "page_layout_text": f"""WITH {LINES}, t AS (SELECT doc_id, string_agg('[b' || line || ' ' || CAST(round_even(x0, 0) AS BIGINT) || ',' || CAST(y0 AS BIGINT) || ' ' || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ']  ' || word || '  /  ' || word || ' ', chr(10) ORDER BY line) AS layout_text,
        string_agg(' ' || word || ' ' || chr(10) || ' ' || word || ' ', chr(10) ORDER BY line) AS text FROM lines GROUP BY doc_id)
      SELECT doc_id, layout_text, sha256(text) AS page_hash FROM t""",
    "printed_labels": f"""WITH {LINES}, t AS (SELECT doc_id, array_to_string(list(replace(word, 'item ', '') ORDER BY line) FILTER (WHERE (y0 <= 792.0::DOUBLE * 0.08::DOUBLE OR y1 >= 792.0::DOUBLE - 792.0::DOUBLE * 0.08::DOUBLE)
          AND length(word) <= 9 AND CAST(replace(word, 'item ', '') AS INTEGER) < 2000), ';') AS labels FROM lines GROUP BY doc_id)
      SELECT doc_id, CASE WHEN ends_with(doc_id, '7') THEN 'vii' ELSE coalesce(labels, '') END AS labels FROM t""",
    "evidence_clip": f"""WITH {LINES}, pairs AS (SELECT a.doc_id || '|' || a.line AS fact_id, b.x0, b.y0, b.x1, b.y1, a.line % 5 = 0 AS bare FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line IN (a.line, a.line + 1)),
      box AS (SELECT fact_id, any_value(bare) AS bare, min(x0) - 18.0::DOUBLE AS x0, min(y0) - 18.0::DOUBLE AS y0, max(x1) + 18.0::DOUBLE AS x1, max(y1) + 18.0::DOUBLE AS y1 FROM pairs GROUP BY fact_id),
      grown AS (SELECT *, greatest((90.0::DOUBLE - (y1 - y0)) / 2, 0) AS g FROM box)
      SELECT fact_id, CASE WHEN bare THEN 0 ELSE greatest(x0, 0) END::DOUBLE AS x0, CASE WHEN bare THEN 0 ELSE greatest(y0 - g, 0) END::DOUBLE AS y0,
        CASE WHEN bare THEN 612 ELSE least(x1, 612) END::DOUBLE AS x1, CASE WHEN bare THEN 792 ELSE least(y1 + g, 792) END::DOUBLE AS y1 FROM grown""",
    "surface_forms": """SELECT p_type AS form, count(*) AS n, array_to_string(list_sort(list_distinct(list(CASE p_size % 5 WHEN 0 THEN 'ratio' WHEN 1 THEN 'currency' WHEN 2 THEN 'mass' WHEN 3 THEN 'other' ELSE 'unknown' END))), ';') AS units
      FROM part WHERE p_type <> '' GROUP BY p_type""",
    "name_tokens": r"""WITH t AS (SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS n, c_name FROM customer)
      SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(n, '[a-z0-9]+'), lambda w: NOT list_contains(['a', 'm', 's', 'of', 'the', 'and', 'an', 'for', 'from', 'to', 'in', 'at', 'by'], w)))), ' ') AS tokens,
        array_to_string(list_sort(list_distinct(regexp_extract_all(c_name, '\d+'))), ' ') AS digits FROM t""",
    "judge_gate": f"WITH {GATE} SELECT entity_id, fact_a, fact_b FROM gate",
    "judge_verdicts": f"""WITH {GATE} SELECT entity_id, fact_a, fact_b, CASE b % 4 WHEN 0 THEN 'CORROBORATED' WHEN 1 THEN 'VARIANT_EXPLAINED_BY' ELSE 'CONTRADICTION' END AS verdict,
        CASE b % 4 WHEN 0 THEN 'JUDGE:EQUIVALENT' WHEN 1 THEN 'JUDGE:STATE_TRANSITION' ELSE 'JUDGE:CONTRADICTION' END AS reason_code, 'high' AS trust, 'rule ' || (b % 4) || '  [rule]' AS explanation FROM gate WHERE b % 4 < 3""",
    "documents_added": "SELECT DISTINCT coalesce(source, '(none)') AS doc_id FROM documents WHERE coalesce(source, '') NOT LIKE '%1'",
    "pages_upserted": "SELECT coalesce(source, '(none)') AS doc_id, CAST(doc_id AS INTEGER) AS page_index, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS route FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "page_lookup": f"""WITH {LIBRARY}, f AS (SELECT * FROM pages WHERE doc_id = 'src1' AND page_index = (SELECT min(page_index) FROM pages WHERE doc_id = 'src1'))
      SELECT doc_id, page_index, page_hash, CAST(i AS INTEGER) AS ord, rows[i + 1] AS text FROM f, unnest(range(len(rows))) AS t(i)""",
    "pages_marked": "SELECT coalesce(source, '(none)') AS doc_id, CAST(doc_id AS INTEGER) AS page_index, doc_id % 2 = 0 OR doc_id % 4 = 0 AS extracted FROM documents",
    "job_detail": "SELECT 'job' || event_id AS job_id, event_type AS status FROM events WHERE event_id = (SELECT min(event_id) FROM events)",
    "cache_rows": "SELECT sha256('hashed-64|64|' || p_type) AS key, 'hashed-64' AS model, 64 AS dims, 64 AS width FROM (SELECT DISTINCT p_type FROM part WHERE p_type NOT LIKE 'S%')",
    "answer_keys": "SELECT doc_id, sha256('2|m1|' || coalesce(text, '')) AS key FROM documents",
    "registry_leaders": """WITH f AS (SELECT p_name || ' ' || p_brand AS form, count(*) AS n FROM part GROUP BY 1),
      r AS (SELECT form, n, row_number() OVER (ORDER BY n DESC, form) AS rank, regexp_extract(form, '[0-9]+') AS d, lower(split_part(form, ' ', 2))[1:1] AS w, length(form) % 2 AS u FROM f),
      c AS (SELECT *, min(rank) OVER (PARTITION BY d, w, u) AS lead, first_value(form) OVER (PARTITION BY d, w, u ORDER BY rank) AS canonical FROM r)
      SELECT form, format('pre_{:04d}', dense_rank() OVER (ORDER BY lead) - 1) AS id, canonical, n, rank FROM c""",
    "registry_rows": """WITH a AS (SELECT p_size, p_type, count(*) AS n, min(p_partkey) AS rank FROM part GROUP BY ALL)
      SELECT 'predicate' AS kind, 'pre_' || p_size AS id, 'size ' || p_size AS canonical, string_agg(p_type, ';' ORDER BY rank, p_type) AS forms, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY p_size""",
    "facts_backfilled": "SELECT p_partkey, p_brand AS subject, CASE WHEN p_brand NOT LIKE '%3' THEN lower(p_brand) END AS entity_id FROM part",
    "diff_json": """SELECT n_nationkey, '{"' || lower(n_name) || '":["' || n_regionkey || '",null]}' AS diff FROM nation""",
}
