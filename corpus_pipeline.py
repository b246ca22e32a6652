"""Five stages that make a training corpus of ``documents``; each is written as Parquet and read again.

Language identification drops texts without a known language; line deduplication drops lines that many
documents share; near-deduplication keeps one document of each group; decontamination drops documents
with benchmark passages; byte-pair encoding gives the tokens of what is left. Every stage takes all rows
its predecessor kept, learns and counts over these alone, and has the defined results of its operator for
nulls, empty and repeated rows. Decisions are per row, but for near-duplicates, where rows that share a
doc_id are one document and rows without doc_id stay if a group has no other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import bpe, decontaminate, language, line_dedup, simhash
from planloom.llm.common import fresh, table
from planloom.llm.queries import bpe_digests, vocabulary
from planloom.session import ensure_checkpoint_dir

#: Texts whose most probable language has a lower mean probability are rejected. With a few languages there is no
#: score under which predictions are wrong more often than right: of 10,000 documents the 13 under 0.6 (short, or with
#: a licence line in another language) were all right. So it is below them, and what goes is text without a language.
LEAST_LANGUAGE_SCORE = 0.3

#: SQL has no conditional random fields, XXH64 or pair merges.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, as they are."""
    return language.accept(docs, language.learn(docs.select("doc_id", "text", "lang")), LEAST_LANGUAGE_SCORE)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines they share with others; ``n_chars`` counts what is left."""
    kept = line_dedup.drop_shared_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked fingerprints: four-word shingles, four bits at most."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"), shingle=4, radius=4)
    key = fresh(docs, "kept_id")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[key]), "left_semi")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; equal texts are judged alike, so the text is the key."""
    key = fresh(docs, "text_key")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    judged = decontaminate.decontaminate(texts, table(spark, sf_dir, "benchmark"))
    gone = judged.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.xxhash64(docs["text"]) == gone[key], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and decoded texts."""
    return bpe_digests(bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", shared_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("bpe_encode_decode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages are kept in the shared folder of the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
