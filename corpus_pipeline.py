"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, secrets, packing.

Each stage is one operator of ``docloom.llm``; its decisions take effect on the
documents that the next stage gets. The first four return the columns of their
input, the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, langid, near_dup, packing, secrets
from docloom.llm.shared import written

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is identified go; the model learns from the labelled ones among ``docs``.

    These are null and letterless texts, and texts of some length that fit no
    learned language better than letters in random order do. A missing ``lang``
    becomes the predicted one. Repeated rows fare alike; an empty table gives an empty one.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more.

    The row with the smallest id stays, a missing id sorts last; of exactly repeated
    rows one stays. Wordless texts all stay; an empty table gives an empty one.
    """
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go: one word in twenty or more lies in an occurring window of 13 words.

    Null texts stay; repeated rows fare alike; an empty table, or an empty
    benchmark, removes nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are blanked out; the character count follows. Every row stays; null texts stay null."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces dealt to sequences; a null or empty text is the end id alone, repeated rows are documents of their own."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Near-duplicate sketches, tokens and trained models are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the tables between them are in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
