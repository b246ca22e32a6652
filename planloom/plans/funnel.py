"""Event streams as plans: one plan per user and week, one step per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators.bounded import long_groups, number_rows
from planloom.plans.corpus import Corpus

# The facts a week starts with, and its goal.
START_FACTS = ["registered", "viewing", "clicked"]
GOAL_FACT = "bought"


def plan_id() -> Column:
    return F.concat(F.lit("u"), F.col("user_id"), F.lit("_"), F.date_format("week", "yyyyMMdd"))


def user_name() -> Column:
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


def actions_seen(plan_id: str = "plan_id") -> Column:
    """The bucket of a plan, from the user number in its id."""
    user = F.regexp_extract(F.col(plan_id), r"^u(\d+)_", 1).cast("long")
    return F.pmod(user, F.lit(6)).cast("int")


def as_chunks(events: DataFrame, *keep: str) -> DataFrame:
    """Numbered events as chunks of one step; the first one carries facts and goal."""
    user = user_name()
    first = F.col("seq") == 1
    none = F.array().cast("array<string>")
    initial = F.array(*[F.concat(F.lit(f), user) for f in START_FACTS])
    step = F.struct(F.upper("event_type").alias("op"), F.array(user).alias("args"))
    return events.select(
        "plan_id",
        "seq",
        F.when(first, initial).otherwise(none).alias("initial"),
        F.when(first, F.array(F.concat(F.lit(GOAL_FACT), user))).otherwise(none).alias("goals"),
        F.array(step).alias("steps"),
        *keep,
    )


class FunnelPlans:
    """The plan corpus of one events table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        events = events.withColumn("week", F.date_trunc("week", "ts"))
        self.events = events.select(
            plan_id().alias("plan_id"),
            "user_id",
            "week",
            F.date_trunc("second", "ts").alias("second"),
            "ts",
            "event_id",
            "event_type",
        )

    def numbered(self) -> tuple[DataFrame, DataFrame | None]:
        long = long_groups(self.events, ["plan_id"])
        order = ["second", "ts", "event_id"]
        return number_rows(self.events, ["plan_id"], order, ["second"], long)

    def corpus(self, *keep: str) -> Corpus:
        ordinary, rest = self.numbered()
        return Corpus(
            as_chunks(ordinary, *keep),
            None if rest is None else as_chunks(rest, *keep),
            as_chunks(self.events.withColumn("seq", F.lit(None).cast("long")), *keep),
        )

    def objects(self) -> DataFrame:
        users = self.events.select("user_id").distinct()
        return users.select(user_name().alias("name"), F.lit("user").alias("type"))
