"""Candidates that a model extracts: schema, isolation and outcome of every batch, each row with its reason.

Rows of all batches are checked at once; ids hold within their batch. A row that
fails takes no other one with it, except through what refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and the reasons shown for rejected rows.
NAME_CHARS, REASON_CHARS, QUOTE_CHARS = 120, 500, 500


def _filled(*names: str) -> Column:
    """Whether texts that a row must have are there and not empty."""
    out = F.lit(True)
    for n in names:
        out = out & (F.coalesce(F.length(n), F.lit(0)) > 0)
    return out


def _share(name: str) -> Column:
    return F.coalesce(F.col(name).between(0.0, 1.0), F.lit(False))


def coordinates_fit(mode: Column, table: Column, row: Column, source_column: Column, target_column: Column) -> Column:
    """Whether a relation has all of its table coordinates, of two columns, exactly if a table row supports it; numbers start at 1."""
    parts = (table, row, source_column, target_column)
    every, some = F.lit(True), F.lit(False)
    for p in parts:
        every, some = every & p.isNotNull(), some | p.isNotNull()
    positive = F.coalesce((row > 0) & (source_column > 0) & (target_column > 0), F.lit(True))
    return positive & F.when(mode == "STRUCTURED_ROW", every & (source_column != target_column)).otherwise(~some)


def schema_reasons(entities: DataFrame, relations: DataFrame, evidences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each table with ``reason``: why a row does not fit the schema, null where it does.

    entities (batch_id, id, source_id, name, type, confidence), relations
    (batch_id, id, source_entity, target_entity, support_mode, predicate_quote,
    evidence_ids, description, confidence, table_id, row_no, source_column,
    target_column), evidences (batch_id, id, source_id, entity_id, relation_id,
    quote, confidence).
    """
    e = entities.withColumn("reason", F.when(~(_filled("id", "name") & F.col("source_id").isNotNull() & F.col("type").isNotNull() & _share("confidence")), "SCHEMA_INVALID"))
    fits = coordinates_fit(F.col("support_mode"), *[F.col(c) for c in ("table_id", "row_no", "source_column", "target_column")])
    given = F.col("source_entity").isNotNull() & F.col("target_entity").isNotNull() & F.col("support_mode").isNotNull() & F.col("predicate_quote").isNotNull()
    r = relations.withColumn("reason", F.when(~(_filled("id") & given & (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0) & _share("confidence") & fits), "SCHEMA_INVALID"))
    owners = F.lit(0)
    for c in ("entity_id", "relation_id"):
        owners = owners + (F.coalesce(F.length(c), F.lit(0)) > 0).cast("int")
    v = evidences.withColumn(
        "reason",
        F.when(~(_filled("id") & F.col("source_id").isNotNull() & F.col("quote").isNotNull() & _share("confidence")), "SCHEMA_INVALID")
        .when(owners == 0, "EVIDENCE_OWNER_MISSING")
        .when(owners == 2, "EVIDENCE_OWNER_MULTIPLE"),
    )
    return e, r, v


def _with_copies(df: DataFrame) -> DataFrame:
    fit = df.where("reason is null").drop("reason")
    return fit.join(fit.groupBy("batch_id", "id").agg(F.count("*").alias("copies")), ["batch_id", "id"])


def isolated(entities: DataFrame, relations: DataFrame, evidences: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, evidences) that hold, and rejected (batch_id, kind, id, reason), one row for each rejected row.

    sources (batch_id, source_id, text) are the texts that a batch was asked
    about. All copies of an id are rejected; a quote must stand in its source;
    an evidence's owner must hold, and name it back where it is a relation; a
    relation without such an evidence is rejected last.
    """
    e, r, v = schema_reasons(entities, relations, evidences)
    rejected = [df.where("reason is not null").select("batch_id", F.lit(kind).alias("kind"), "id", "reason") for kind, df in (("entity", e), ("relation", r), ("evidence", v))]
    texts = sources.select("batch_id", "source_id", F.col("text").alias("source_text"), F.lit(True).alias("known"))

    e = _with_copies(e).join(texts.drop("source_text"), ["batch_id", "source_id"], "left").withColumn(
        "reason",
        F.when(F.col("copies") > 1, "DUPLICATE_CANDIDATE_ID").when(F.length("name") > NAME_CHARS, "ENTITY_NAME_RESOURCE_LIMIT").when(F.col("known").isNull(), "UNKNOWN_MODEL_SOURCE"),
    )
    held = e.where("reason is null")
    end = lambda name: held.select("batch_id", F.col("id").alias(name), F.lit(True).alias(f"{name}_holds"))
    r = _with_copies(r).join(end("source_entity"), ["batch_id", "source_entity"], "left").join(end("target_entity"), ["batch_id", "target_entity"], "left")
    r = r.withColumn(
        "reason",
        F.when(F.col("copies") > 1, "DUPLICATE_CANDIDATE_ID")
        .when(F.coalesce(F.length("description"), F.lit(0)) > REASON_CHARS, "RELATION_REASON_RESOURCE_LIMIT")
        .when(F.col("source_entity_holds").isNull() | F.col("target_entity_holds").isNull(), "RELATION_ENDPOINT_UNKNOWN"),
    )
    open_relations = r.where("reason is null").select("batch_id", F.col("id").alias("relation_id"), F.col("evidence_ids").alias("named"))

    v = _with_copies(v).join(texts, ["batch_id", "source_id"], "left").join(end("entity_id"), ["batch_id", "entity_id"], "left").join(open_relations, ["batch_id", "relation_id"], "left")
    by_entity = F.coalesce(F.length("entity_id"), F.lit(0)) > 0
    v = v.withColumn(
        "reason",
        F.when(F.col("copies") > 1, "DUPLICATE_CANDIDATE_ID")
        .when(F.col("known").isNull(), "UNKNOWN_MODEL_SOURCE")
        .when(F.length("quote") > QUOTE_CHARS, "QUOTE_RESOURCE_LIMIT")
        .when((F.trim("quote") == "") | ~F.coalesce(F.col("source_text").contains(F.col("quote")), F.lit(False)), "QUOTE_NOT_IN_SOURCE")
        .when(by_entity & F.col("entity_id_holds").isNull(), "EVIDENCE_OWNER_UNKNOWN")
        .when(~by_entity & F.col("named").isNull(), "EVIDENCE_OWNER_UNKNOWN")
        .when(~by_entity & ~F.array_contains("named", F.col("id")), "EVIDENCE_REFERENCE_UNBOUND"),
    ).drop("source_text")
    proofs = v.where("reason is null")

    bound = proofs.where("coalesce(relation_id, '') <> ''").groupBy("batch_id", F.col("relation_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("id"))).alias("bound"))
    r = r.join(bound, ["batch_id", "id"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("bound").isNull(), "RELATION_EVIDENCE_CONTRACT_INVALID")))
    rejected += [df.where("reason is not null").select("batch_id", F.lit(kind).alias("kind"), "id", "reason") for kind, df in (("entity", e), ("relation", r), ("evidence", v))]
    every = rejected[0]
    for more in rejected[1:]:
        every = every.unionByName(more)
    kept_relations = r.where("reason is null").withColumn("evidence_ids", F.col("bound"))
    columns = lambda df, like: df.select(*like.columns)
    return columns(held, entities), columns(kept_relations, relations), columns(proofs, evidences), every


def outcomes(batches: DataFrame, kept: list[DataFrame], rejected: DataFrame) -> DataFrame:
    """(batch_id, n_kept, n_rejected, outcome) of batches (batch_id, eligible_sources)."""
    some = kept[0].select("batch_id")
    for more in kept[1:]:
        some = some.unionByName(more.select("batch_id"))
    out = batches.join(some.groupBy("batch_id").agg(F.count("*").alias("n_kept")), "batch_id", "left")
    out = out.join(rejected.groupBy("batch_id").agg(F.count("*").alias("n_rejected")), "batch_id", "left").na.fill(0, ["n_kept", "n_rejected"])
    outcome = (
        F.when(F.col("eligible_sources") == 0, "STRUCTURALLY_INELIGIBLE_SOURCES")
        .when(F.col("n_kept") > 0, "CANDIDATES_ACCEPTED")
        .when(F.col("n_rejected") > 0, "ALL_CANDIDATES_REJECTED")
        .otherwise("MODEL_EMPTY_CANDIDATES")
    )
    return out.select("batch_id", "n_kept", "n_rejected", outcome.alias("outcome"))
