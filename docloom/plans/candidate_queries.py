"""Queries over extracted candidates: what holds, what is rejected and why, and how each batch ends.

Candidates are made from documents, so that every rule is met by some of them;
a document's source is its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import candidates as C
from docloom.plans.catalogue import query
from docloom.sources.tables import table

MADE = """s AS (SELECT source AS batch_id, 's' || doc_id AS source_id, coalesce(text, '') AS text, doc_id AS k FROM documents),
e0 AS (SELECT batch_id, CASE WHEN k % 19 = 0 THEN 'e' ELSE 'e' || k END AS id, CASE WHEN k % 41 = 0 THEN 's?' ELSE source_id END AS source_id, CASE WHEN k % 53 = 0 THEN '' WHEN k % 59 = 0 THEN repeat('n', 121) ELSE 'name ' || k END AS name, CASE WHEN k % 61 = 0 THEN 1.5 ELSE 0.5 END AS confidence, k FROM s),
r0 AS (SELECT batch_id, CASE WHEN k % 27 = 0 THEN 'r' ELSE 'r' || k END AS id, 'e' || k AS source_entity, CASE WHEN k % 23 = 0 THEN 'e?' ELSE 'e' || k END AS target_entity, CASE WHEN k % 31 = 0 THEN repeat('d', 501) ELSE '' END AS description,
 CASE WHEN k % 5 = 0 THEN 'STRUCTURED_ROW' ELSE 'TEXT' END AS support_mode, CASE WHEN k % 35 = 1 THEN CAST(1 AS INT) WHEN k % 5 = 0 THEN CAST(2 AS INT) END AS table_id, CASE WHEN k % 5 = 0 THEN CAST(k % 7 AS INT) END AS row_no,
 CASE WHEN k % 5 = 0 THEN CAST(1 AS INT) END AS source_column, CASE WHEN k % 5 = 0 THEN CAST(1 + k % 4 AS INT) END AS target_column, CASE WHEN k % 47 = 0 THEN [] WHEN k % 17 = 0 THEN ['v?'] ELSE ['v' || k] END AS evidence_ids, k FROM s),
v0 AS (SELECT batch_id, CASE WHEN k % 25 = 0 THEN 'v' ELSE 'v' || k END AS id, CASE WHEN k % 43 = 0 THEN 's?' ELSE source_id END AS source_id, CASE WHEN k % 3 = 0 OR k % 37 = 0 THEN 'e' || k ELSE '' END AS entity_id,
 CASE WHEN k % 3 <> 0 AND k % 71 <> 0 THEN 'r' || k ELSE '' END AS relation_id, CASE WHEN k % 29 = 0 THEN 'no such quote' WHEN k % 67 = 0 THEN '  ' WHEN k % 73 = 0 THEN repeat('q', 501) ELSE substr(text, 1, 12) END AS quote, CASE WHEN k % 79 = 0 THEN -0.5 ELSE 0.5 END AS confidence FROM s)"""
CHECKED = f"""WITH {MADE},
e1 AS (SELECT *, CASE WHEN length(name) = 0 OR confidence > 1 THEN 'SCHEMA_INVALID' END AS bad FROM e0),
r1 AS (SELECT *, CASE WHEN len(evidence_ids) = 0 OR coalesce(row_no <= 0, false) OR (support_mode = 'STRUCTURED_ROW' AND (table_id IS NULL OR row_no IS NULL OR source_column = target_column)) OR (support_mode <> 'STRUCTURED_ROW' AND table_id IS NOT NULL) THEN 'SCHEMA_INVALID' END AS bad FROM r0),
v1 AS (SELECT *, CASE WHEN confidence < 0 THEN 'SCHEMA_INVALID' WHEN entity_id = '' AND relation_id = '' THEN 'EVIDENCE_OWNER_MISSING' WHEN entity_id <> '' AND relation_id <> '' THEN 'EVIDENCE_OWNER_MULTIPLE' END AS bad FROM v0),
e2 AS (SELECT e1.*, CASE WHEN count(*) OVER (PARTITION BY e1.batch_id, id) > 1 THEN 'DUPLICATE_CANDIDATE_ID' WHEN length(name) > 120 THEN 'ENTITY_NAME_RESOURCE_LIMIT' WHEN s.source_id IS NULL THEN 'UNKNOWN_MODEL_SOURCE' END AS reason FROM e1 LEFT JOIN s USING (batch_id, source_id) WHERE bad IS NULL),
ee AS (SELECT DISTINCT batch_id, id FROM e2 WHERE reason IS NULL),
r2 AS (SELECT r1.*, CASE WHEN count(*) OVER (PARTITION BY r1.batch_id, r1.id) > 1 THEN 'DUPLICATE_CANDIDATE_ID' WHEN length(description) > 500 THEN 'RELATION_REASON_RESOURCE_LIMIT' WHEN a.id IS NULL OR b.id IS NULL THEN 'RELATION_ENDPOINT_UNKNOWN' END AS reason
 FROM r1 LEFT JOIN ee a ON a.batch_id = r1.batch_id AND a.id = source_entity LEFT JOIN ee b ON b.batch_id = r1.batch_id AND b.id = target_entity WHERE bad IS NULL),
v2 AS (SELECT v1.*, CASE WHEN count(*) OVER (PARTITION BY v1.batch_id, v1.id) > 1 THEN 'DUPLICATE_CANDIDATE_ID' WHEN s.source_id IS NULL THEN 'UNKNOWN_MODEL_SOURCE' WHEN length(quote) > 500 THEN 'QUOTE_RESOURCE_LIMIT' WHEN trim(quote) = '' OR NOT contains(s.text, quote) THEN 'QUOTE_NOT_IN_SOURCE'
  WHEN entity_id <> '' AND a.id IS NULL THEN 'EVIDENCE_OWNER_UNKNOWN' WHEN entity_id = '' AND r.id IS NULL THEN 'EVIDENCE_OWNER_UNKNOWN' WHEN entity_id = '' AND NOT list_contains(r.evidence_ids, v1.id) THEN 'EVIDENCE_REFERENCE_UNBOUND' END AS reason
 FROM v1 LEFT JOIN s USING (batch_id, source_id) LEFT JOIN ee a ON a.batch_id = v1.batch_id AND a.id = entity_id LEFT JOIN (SELECT batch_id, id, evidence_ids FROM r2 WHERE reason IS NULL) r ON r.batch_id = v1.batch_id AND r.id = relation_id WHERE bad IS NULL),
vv AS (SELECT DISTINCT batch_id, relation_id FROM v2 WHERE reason IS NULL AND relation_id <> ''),
r3 AS (SELECT r2.batch_id, r2.id, coalesce(reason, CASE WHEN vv.relation_id IS NULL THEN 'RELATION_EVIDENCE_CONTRACT_INVALID' END) AS reason FROM r2 LEFT JOIN vv ON vv.batch_id = r2.batch_id AND vv.relation_id = r2.id),
x AS (SELECT batch_id, 'entity' AS kind, id, bad AS reason FROM e1 WHERE bad IS NOT NULL UNION ALL SELECT batch_id, 'relation', id, bad FROM r1 WHERE bad IS NOT NULL UNION ALL SELECT batch_id, 'evidence', id, bad FROM v1 WHERE bad IS NOT NULL
 UNION ALL SELECT batch_id, 'entity', id, reason FROM e2 UNION ALL SELECT batch_id, 'relation', id, reason FROM r3 UNION ALL SELECT batch_id, 'evidence', id, reason FROM v2)"""


def made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k, text = F.col("k"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), text("s", F.col("doc_id").cast("string")).alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("k"))
    entity = text("e", k.cast("string"))
    name = F.when(k % 53 == 0, "").when(k % 59 == 0, F.repeat(F.lit("n"), F.lit(121))).otherwise(text("name ", k.cast("string")))
    entities = s.select(
        "batch_id", F.when(k % 19 == 0, "e").otherwise(entity).alias("id"), F.when(k % 41 == 0, "s?").otherwise(F.col("source_id")).alias("source_id"), name.alias("name"), F.lit("THING").alias("type"), F.when(k % 61 == 0, 1.5).otherwise(0.5).alias("confidence")
    )
    row = k % 5 == 0
    relations = s.select(
        "batch_id", F.when(k % 27 == 0, "r").otherwise(text("r", k.cast("string"))).alias("id"), entity.alias("source_entity"), F.when(k % 23 == 0, "e?").otherwise(entity).alias("target_entity"),
        F.when(row, "STRUCTURED_ROW").otherwise("TEXT").alias("support_mode"), F.lit("").alias("predicate_quote"),
        F.when(k % 47 == 0, F.expr("cast(array() as array<string>)")).when(k % 17 == 0, F.array(F.lit("v?"))).otherwise(F.array(text("v", k.cast("string")))).alias("evidence_ids"),
        F.when(k % 31 == 0, F.repeat(F.lit("d"), F.lit(501))).otherwise("").alias("description"), F.lit(0.5).alias("confidence"),
        F.when(k % 35 == 1, 1).when(row, 2).alias("table_id"), F.when(row, (k % 7).cast("int")).alias("row_no"), F.when(row, 1).alias("source_column"), F.when(row, (1 + k % 4).cast("int")).alias("target_column"),
    )
    quote = F.when(k % 29 == 0, "no such quote").when(k % 67 == 0, "  ").when(k % 73 == 0, F.repeat(F.lit("q"), F.lit(501))).otherwise(F.substring("text", 1, 12))
    evidences = s.select(
        "batch_id", F.when(k % 25 == 0, "v").otherwise(text("v", k.cast("string"))).alias("id"), F.when(k % 43 == 0, "s?").otherwise(F.col("source_id")).alias("source_id"),
        F.when((k % 3 == 0) | (k % 37 == 0), entity).otherwise("").alias("entity_id"), F.when((k % 3 != 0) & (k % 71 != 0), text("r", k.cast("string"))).otherwise("").alias("relation_id"),
        quote.alias("quote"), F.when(k % 79 == 0, -0.5).otherwise(0.5).alias("confidence"),
    )
    return entities, relations, evidences, s.drop("k")


@query(f"{CHECKED} SELECT batch_id, kind, id, reason FROM x WHERE reason IS NOT NULL")
def candidate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected entity, relation and evidence with its reason, schema ones included."""
    return C.isolated(*made(spark, sf_dir))[3]


@query(
    f"""{CHECKED}, n AS (SELECT batch_id, CAST(count_if(reason IS NULL) AS BIGINT) AS n_kept, CAST(count_if(reason IS NOT NULL) AS BIGINT) AS n_rejected FROM x WHERE batch_id <> 'src1' GROUP BY ALL),
b AS (SELECT DISTINCT source AS batch_id FROM documents) SELECT batch_id, coalesce(n_kept, 0) AS n_kept, coalesce(n_rejected, 0) AS n_rejected,
 CASE WHEN batch_id = 'src2' THEN 'STRUCTURALLY_INELIGIBLE_SOURCES' WHEN coalesce(n_kept, 0) > 0 THEN 'CANDIDATES_ACCEPTED' WHEN coalesce(n_rejected, 0) > 0 THEN 'ALL_CANDIDATES_REJECTED' ELSE 'MODEL_EMPTY_CANDIDATES' END AS outcome FROM b LEFT JOIN n USING (batch_id)"""
)
def extraction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each batch ends; one got nothing from the model, one had nothing to ask about."""
    entities, relations, evidences, sources = made(spark, sf_dir)
    answered = [df.where("batch_id <> 'src1'") for df in (entities, relations, evidences)]
    *kept, rejected = C.isolated(*answered, sources)
    batches = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id")).distinct()
    batches = batches.withColumn("eligible_sources", F.when(F.col("batch_id") == "src2", 0).otherwise(1))
    return C.outcomes(batches, kept, rejected)
