"""A training corpus out of raw documents: five stages, each written and read back before the next.

Every function takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``.

1. quality: documents that the positive-unlabelled classifier rejects go; those it can't judge stay.
2. near_dedup: one document of each group of near-duplicates stays, the one with the smallest id.
3. substring_dedup: later occurrences of passages that repeat across documents are cut out of the texts.
4. decontaminate: documents that hold a benchmark item, verbatim or with other slots, go.
5. mix: sources are mixed to their target weights; the shards are written beside the stages' tables, as
   ``mixed-`` and a number of its own in the shared folder; a row per document with the words the mix takes is returned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm import decontaminate as leaks
from logfathom.llm import mixing, near_dedup, quality, substring
from logfathom.llm.common import durable, shared_dir, table
from logfathom.llm.queries import quality_model


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))  # the table's own score and predicted columns stay
    scored = quality.score(rows, quality_model(spark, sf_dir, docs.select("doc_id", "text")))
    return scored.where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = near_dedup.near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(durable(copies), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorter = substring.remove_repeats(docs, durable(substring.repeated_passages(docs)))
    return shorter.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else shorter


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, durable(leaks.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    mixing.write_shards(mixed["shards"], f"{shared_dir(spark)}/mixed-{uuid.uuid4().hex}")
    return mixed["taken"].select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
]

# Trained models and pseudorandom permutations have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = durable(docs)
    return docs
