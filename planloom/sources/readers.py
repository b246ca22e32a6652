"""Readers for plan records, generated plans, plan logs and problem files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.schemas import GENERATED_PLAN, PLAN_RECORD
from planloom.sources.lines import read_lines
from planloom.sources.texts import log_rows, parse_problems, problem_sections, raw_plans


def _file_name():
    return F.element_at(F.split("_metadata.file_path", "/"), -1)


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Plan records of a file or folder of JSON arrays (or JSON lines, which split)."""
    return spark.read.schema(PLAN_RECORD).option("multiLine", not lines).json(path)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder with the split their file name tells (train, test, validation)."""
    records = spark.read.schema(PLAN_RECORD).option("multiLine", True).json(folder)
    found = F.regexp_extract(_file_name(), r"(train|test|validation)", 1)
    return records.select("*", found.alias("split"))


def read_generated(
    spark: SparkSession, folder: str, prefix: str = "to_validate_", lines: bool = False
) -> DataFrame:
    """All batches of generated plans under ``<folder>/<n>_actions/``."""
    pattern = f"{folder}/*[0-9]_actions/{prefix}*.json"
    return spark.read.schema(GENERATED_PLAN).option("multiLine", not lines).json(pattern)


def read_problems(spark: SparkSession, path: str, prefixes=("at",)) -> DataFrame:
    """One row of numbers per problem file; facts and objects come from the same sections."""
    return parse_problems(problem_sections(read_lines(spark, path)), prefixes)


def read_log_rows(spark: SparkSession, path: str) -> DataFrame:
    """The metadata lines of plan logs of any length, one row each."""
    return log_rows(read_lines(spark, path))


def read_plan_logs(spark: SparkSession, path: str) -> DataFrame:
    """Plan logs as one nested record each, for logs that fit a row."""
    return raw_plans(read_log_rows(spark, path))
