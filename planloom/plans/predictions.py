"""Embedding vectors as the scores of next-action predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions.scores import doubles

# Positions per example, examples per batch, last position that counts.
POSITIONS = 16
BATCH = 4
LAST_POSITION = 12
EPOCHS = 3


def _div(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by).cast("long")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, context, position, logits, label``: one vector per position of an example."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id",
        _div("vec_id", POSITIONS).alias("context"),
        F.pmod("vec_id", F.lit(POSITIONS)).cast("int").alias("position"),
        doubles(F.col("embedding")).alias("logits"),
        "label",
    )


def with_references(scored: DataFrame) -> DataFrame:
    """Add what the loss needs: ``reference`` (null: pad), ``actions_idx``, ``batch``, ``epoch``."""
    batch = _div("context", BATCH)
    return scored.select(
        "*",
        F.when(F.col("position") <= LAST_POSITION, F.col("label")).alias("reference"),
        F.pmod("context", F.lit(5)).cast("int").alias("actions_idx"),
        batch.alias("batch"),
        F.pmod(batch, F.lit(EPOCHS)).cast("int").alias("epoch"),
    )
