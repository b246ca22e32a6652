"""Static facts of a problem appended to the initial state of its plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.operators.bounded import long_groups, number_rows
from planloom.plans.corpus import union


def numbered_facts(facts: DataFrame) -> DataFrame:
    """Distinct facts per problem with their places: ``problem_id, fact, rank`` from 0 on.

    A problem of any size is numbered in ranges of its facts' hashes.
    """
    distinct = facts.select("problem_id", "fact").distinct()
    distinct = distinct.withColumn("range", F.substring(F.md5("fact"), 1, 3))
    long = long_groups(distinct, ["problem_id"])
    frames = number_rows(distinct, ["problem_id"], ["range", "fact"], ["range"], long)
    numbered = union([f for f in frames if f is not None])
    return numbered.select("problem_id", "fact", (F.col("seq") - 1).alias("rank"))


def enrich_static_facts(initial: DataFrame, plans: DataFrame, facts: DataFrame) -> DataFrame:
    """Initial states as ``plan_id, place, fact``, the static facts of the problem behind the plan's own.

    ``initial`` has ``plan_id, place, fact``; ``plans`` one row ``plan_id, problem_id, n_initial_state``
    per plan; ``facts`` any rows ``problem_id, fact``. One problem may have any number of plans and of
    facts: both sides of the join are plain shuffles that adaptive execution splits.
    """
    static = plans.join(numbered_facts(facts), "problem_id")
    place = (F.col("n_initial_state") + F.col("rank")).alias("place")
    return initial.select("plan_id", "place", "fact").unionByName(static.select("plan_id", place, "fact"))
