"""Sizes of plans and the description of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["initial_state", "goals", "actions"]


def plan_sizes(chunks: DataFrame, *keys: str) -> DataFrame:
    """Facts, goals and actions per plan; counts combine before the shuffle."""
    keys = keys or ("plan_id",)
    sizes = {"initial_state": "initial", "goals": "goals", "actions": "steps"}
    return chunks.groupBy(*keys).agg(
        *[F.sum(F.size(source)).alias(f"n_{name}") for name, source in sizes.items()]
    )


def corpus_stats(sizes: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, minimum, maximum and median of each size."""

    def described(name: str) -> Column:
        value = F.col(f"n_{name}")
        return F.struct(
            F.lit(name).alias("measure"),
            F.count(value).alias("n_plans"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.percentile(value, 0.5).alias("median"),
        )

    return sizes.agg(F.array(*[described(m) for m in MEASURES]).alias("rows")).select(F.inline("rows"))


def plans_per_problem(names: DataFrame, problem: Column, example: Column) -> DataFrame:
    """How many plans solve each problem, with the first and last example id."""
    return (
        names.select(problem.alias("problem_id"), example.alias("example_id"))
        .groupBy("problem_id")
        .agg(
            F.count(F.lit(1)).alias("n_plans"),
            F.min("example_id").alias("first_example"),
            F.max("example_id").alias("last_example"),
        )
    )
