"""From raw documents to packed token sequences, in four stages.

Each stage takes what its predecessor kept and returns rows with the columns of
``documents``; the last returns the pieces of the packed sequences. Stages are written as
Parquet and read again, so a failed stage is repeated from its input alone.

* language ID: texts without a language (``und``) or with a doubtful one go.
* quality rules: texts whose posterior probability of being good is below one half, or
  that fail the base rule, go.
* SimHash near-dedup: texts whose fingerprints differ in at most three bits are linked (``simhash``).
  Of each group of linked documents the one with the smallest id stays; of rows that repeat an id
  and its text, one. Rows without id are in no group and stay. Looser copies (``near_copies``
  finds those of Jaccard similarity 0.8) mostly differ in more bits and stay.
* packing: all that is left, in windows of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from docweft.llm import language, packing, quality_rules, simhash
from docweft.llm.columns import free_name
from docweft.session import new_path, stored

#: Least posterior of the predicted language.
SURE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    model = language.fit(docs)
    into = free_name(docs, "language")
    found = language.identify(docs, model, into=into)
    return found.filter((F.col(into)["lang"] != language.UND) & (F.col(into)["score"] >= SURE)).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    facts, into = free_name(docs, "facts"), free_name(docs, "quality")
    seen = stored(quality_rules.quality_facts(docs, into=facts), "facts")
    return quality_rules.score_quality(seen, facts, into).filter(F.col(into)["kept"]).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )


def dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    # texts and fingerprints are named by hashes: a repeated id may have several texts
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = simhash.fingerprints(rows, key="text_hash").distinct().withColumnRenamed("doc_id", "text_hash")
    prints = stored(prints, "prints")
    near = simhash.near_duplicates(stored(prints.select(F.col("print").alias("doc_id"), "print").distinct(), "named"))
    named = prints.join(near.select("print", "component_id"), "print").select("text_hash", "component_id")
    found = stored(rows.select("doc_id", "text_hash").join(named, "text_hash"), "found")
    kept = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = found.join(kept, "component_id").filter("doc_id <> first.doc_id or text_hash <> first.text_hash").select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")
    ).distinct()
    nth, of = free_name(docs, "nth"), free_name(docs, "text_hash")
    hashed = docs.withColumn(of, F.xxhash64("text"))
    left = hashed.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col(of) == F.col("gone_hash")), "left_anti")
    # only rows that repeat an id and its text are told apart
    order = W.partitionBy("doc_id", of).orderBy(F.col("text"))
    return left.withColumn(nth, F.row_number().over(order)).filter(
        (F.col(nth) == 1) | F.col("doc_id").isNull()
    ).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs).select(
        "sequence_id", "offset", "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "doc_tokens",
        F.crc32("ids").alias("ids_crc32"), "ids",
    )


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("packing", packing_stage),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{number}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
