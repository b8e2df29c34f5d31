"""A view of the driver's tables as facts, so that the engine has a corpus whose answers are known.

Three documents report on the revenue of each entity, year, quarter and return flag: ``A`` in million,
``B`` in crore with odd wordings and missing qualifiers, ``C`` first quarters only, net, in lakh.
Values come from integer arithmetic, so that every engine gets the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pair(key: str, value: Column, when: Column | None = None) -> Column:
    pair = F.struct(F.lit(key).alias("key"), value.alias("value"))
    return pair if when is None else F.when(when, pair)


def facts(spark: SparkSession, sf_dir: str, entity: str = "p_brand") -> DataFrame:
    """The facts; ``entity`` is the column of ``part`` that they are about."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    base = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col(entity).cast("string").alias("e"), F.substring_index("p_brand", "#", -1).cast("int").alias("bn"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), F.lower("l_returnflag").alias("flag"))
        .agg((F.sum(price) * 100).cast("long").alias("cents"), (F.sum(price * (1 - F.col("l_discount").cast("decimal(4,2)"))) * 10000).cast("long").alias("netu"))
    )
    fiscal, calendar = F.format_string("Q%d FY%d", "q", "y"), F.format_string("%dQ%d", "y", "q")
    basis = F.col("flag")
    none = F.array().cast("array<string>")
    of_a = F.struct(F.lit("A").alias("doc"), F.expr("((cents + 500000) div 1000000) / 100.0D").alias("value"), F.lit("₹ million").alias("unit"), F.lit("revenue").alias("predicate"), F.array(_pair("Reporting period", fiscal), _pair("basis", basis)).alias("qualifiers"), none.alias("issues"))
    of_b = F.struct(
        F.lit("B").alias("doc"),
        F.expr("((cents + 5000000) div 10000000) / 100.0D").alias("value"),
        F.lit("Cr").alias("unit"),
        F.when(F.col("bn") % 5 == 0, "sales").otherwise("Revenue ").alias("predicate"),
        F.array_compact(F.array(_pair("period", F.when(F.col("bn") % 7 == 0, calendar).otherwise(fiscal)), _pair("Basis", F.upper(basis), ~((basis == "n") & (F.col("bn") % 3 == 0))))).alias("qualifiers"),
        none.alias("issues"),
    )
    of_c = F.struct(
        F.lit("C").alias("doc"),
        F.expr("((netu + 50000000) div 100000000) / 10.0D").alias("value"),
        F.lit("₹ lakh").alias("unit"),
        F.lit("revenue").alias("predicate"),
        F.array(_pair("fiscal year", fiscal), _pair("basis", basis)).alias("qualifiers"),
        F.when(F.col("bn") % 4 == 0, F.array(F.lit("value not in cited blocks"))).otherwise(none).alias("issues"),
    )
    each = F.explode(F.array_compact(F.array(of_a, of_b, F.when(F.col("q") == 1, of_c))))
    rows = base.select("e", "y", "q", "flag", each.alias("f"))
    return rows.select(
        F.concat_ws("|", "f.doc", "e", "y", "q", "flag").alias("fact_id"),
        F.col("f.doc").alias("doc_id"),
        (F.col("q") - 1).alias("page_index"),
        F.concat_ws(" ", "e", "f.predicate", "y", "q", "flag").alias("claim_text"),
        F.col("e").alias("subject"),
        F.col("f.predicate").alias("predicate"),
        F.col("f.value").alias("value"),
        F.col("f.unit").alias("unit"),
        F.col("f.qualifiers").alias("qualifiers"),
        F.col("f.issues").alias("grounding_issues"),
        F.concat_ws(" ", F.col("f.value").cast("string"), "f.unit").alias("object_text"),
        F.col("e").alias("entity_id"),
        F.lit("pre_0000").alias("predicate_id"),
    )


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "Annual report"), ("B", "Investor letter"), ("C", "Filing")], "doc_id string, title string")


def registry(of: DataFrame) -> DataFrame:
    """The registry that the view's ids belong to."""
    entity = of.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "id", F.col("id").alias("canonical"), "n")
    predicate = of.groupBy(F.col("predicate_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("predicate").alias("kind"), "id", F.lit("revenue").alias("canonical"), "n")
    return entity.unionByName(predicate)


#: The same view in DuckDB SQL, qualifiers already normalised.
FACTS_SQL = """
base AS (
  SELECT p_brand AS e, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS bn, year(l_shipdate) AS y, quarter(l_shipdate) AS q, lower(l_returnflag) AS flag,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) * 100 AS BIGINT) AS cents,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) * 10000 AS BIGINT) AS netu
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), raw AS (
  SELECT 'A' AS doc, e, y, q, flag, ((cents + 500000) // 1000000) / 100.0 AS value, '₹ million' AS unit, 1e6::DOUBLE AS magnitude, 'INR' AS currency, 'revenue' AS predicate,
         y || 'Q' || q || 'F' AS period, flag AS basis, 0 AS issues FROM base
  UNION ALL
  SELECT 'B', e, y, q, flag, ((cents + 5000000) // 10000000) / 100.0, 'Cr', 1e7::DOUBLE, NULL, CASE WHEN bn % 5 = 0 THEN 'sales' ELSE 'Revenue ' END,
         y || 'Q' || q || CASE WHEN bn % 7 = 0 THEN 'C' ELSE 'F' END, CASE WHEN flag = 'n' AND bn % 3 = 0 THEN NULL ELSE flag END, 0 FROM base
  UNION ALL
  SELECT 'C', e, y, q, flag, ((netu + 50000000) // 100000000) / 10.0, '₹ lakh', 1e5::DOUBLE, 'INR', 'revenue', y || 'Q' || q || 'F', flag, CASE WHEN bn % 4 = 0 THEN 1 ELSE 0 END
  FROM base WHERE q = 1
), printed AS (
  SELECT *, format('{:.10g}', abs(value)) AS t FROM raw
), facts AS (
  SELECT doc || '|' || e || '|' || y || '|' || q || '|' || flag AS fact_id, doc AS doc_id, q - 1 AS page_index, e || ' ' || predicate || ' ' || y || ' ' || q || ' ' || flag AS claim_text,
         e AS entity_id, 'pre_0000' AS predicate_id, predicate, value, unit, period, basis, issues, currency, value * magnitude AS base_value,
         CASE WHEN value = 0 THEN magnitude * 0.5
              WHEN contains(t, '.') THEN 0.5::DOUBLE * CAST('1e-' || length(split_part(t, '.', 2)) AS DOUBLE) * magnitude
              ELSE 0.5::DOUBLE * CAST('1e' || (length(t) - length(rtrim(t, '0'))) AS DOUBLE) * magnitude END AS tolerance
  FROM printed
)"""

#: Verdicts over that view; both qualifiers discriminate in every cell (a test holds this).
VERDICTS_SQL = FACTS_SQL + """, pairs AS (
  SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, a.entity_id, a.predicate_id, abs(a.base_value - b.base_value) AS delta, a.tolerance + b.tolerance AS tolerance,
         a.doc_id <> b.doc_id AS cross_document, a.issues + b.issues AS issues, a.period AS pa, b.period AS pb, a.basis AS ba, b.basis AS bb,
         a.claim_text AS claim_a, b.claim_text AS claim_b, lower(trim(a.predicate)) <> lower(trim(b.predicate)) AS wording,
         CASE WHEN a.period <> b.period THEN 1 ELSE 0 END AS cp, CASE WHEN a.basis <> b.basis THEN 1 ELSE 0 END AS cb,
         a.basis IS NULL OR b.basis IS NULL AS gap, abs(a.base_value - b.base_value) <= a.tolerance + b.tolerance AS agree
  FROM facts a JOIN facts b ON a.entity_id = b.entity_id AND a.predicate_id = b.predicate_id AND a.fact_id < b.fact_id
), decided AS (
  SELECT *, CASE
      WHEN cp + cb = 1 AND NOT agree THEN 'QUALIFIER_DIFF:' || CASE WHEN cp = 1 THEN 'period' ELSE 'basis' END
      WHEN cp + cb > 0 THEN NULL
      WHEN gap AND agree THEN 'AGREE_ON_SHARED_QUALIFIERS'
      WHEN gap THEN 'MISSING_QUALIFIER:basis'
      WHEN agree THEN 'SAME_CELL_AGREE'
      WHEN issues > 0 THEN 'INHERITED_QUALIFIER'
      WHEN wording THEN 'PREDICATE_UNCERTAIN'
      ELSE 'SAME_CELL_DISAGREE' END AS reason_code
  FROM pairs
), hashed AS (
  SELECT *, sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(fact_a || '|' || fact_b || '|cmp')) AS h FROM decided WHERE reason_code IS NOT NULL
), verdicts AS (
  SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(to_hex((CAST('0x' || h[17:17] AS INTEGER) & 3) | 8)) || h[18:20] || '-' || h[21:32] AS verdict_id,
         CASE WHEN reason_code LIKE 'QUALIFIER_DIFF%' THEN 'VARIANT_EXPLAINED_BY' WHEN reason_code IN ('AGREE_ON_SHARED_QUALIFIERS', 'SAME_CELL_AGREE') THEN 'CORROBORATED'
              WHEN reason_code = 'SAME_CELL_DISAGREE' THEN 'CONTRADICTION' ELSE 'INSUFFICIENT_CONTEXT' END AS verdict,
         reason_code, fact_a, fact_b, entity_id, predicate_id, delta, tolerance, cross_document, CASE WHEN issues > 0 THEN 'low' ELSE 'high' END AS trust, claim_a, claim_b
  FROM hashed
)"""
