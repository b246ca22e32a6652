"""Properties of shuffles, shards and leakage-free splits."""

import random

import pytest
from pyspark.sql import functions as F

from planloom.operators import splits


@pytest.fixture(scope="module")
def plans(spark):
    rng = random.Random(2)
    rows = []
    for problem in range(60):
        for _ in range(rng.randint(1, 9) if problem else 150):  # one problem holds a third
            rows.append((f"plan{len(rows)}", f"p{problem}", rng.randint(1, 30)))
    return spark.createDataFrame(rows, "plan_id string, problem_id string, length long").cache()


def split_of(plans, **options):
    rows = splits.group_split(plans, None, **options).collect()
    return {r["plan_id"]: (r["problem_id"], r["split"]) for r in rows}


@pytest.mark.parametrize("size", [0.05, 0.3, 17, 0])
def test_groups_stay_together_and_sizes_hold(plans, size):
    found = split_of(plans, test_size=size, validation_size=20, validation_lengths=(6, 14))
    total = plans.count()
    assert len(found) == total
    sides = {}
    for problem, split in found.values():
        sides.setdefault(problem, set()).add(split)
    assert all(len(s) == 1 for s in sides.values())
    groups = {p: sum(1 for q, _ in found.values() if q == p) for p in sides}
    target = int(size * total) if isinstance(size, float) else size
    taken = [p for p, s in sides.items() if s == {"test"}]
    test = sum(groups[p] for p in taken)
    assert test >= target
    # Without its last group a split would have been too small.
    assert target == 0 or any(test - groups[p] < target for p in taken)
    fitting = {r["problem_id"] for r in plans.filter("length between 6 and 14").collect()}
    assert {p for p, s in sides.items() if s == {"validation"}} <= fitting


@pytest.mark.parametrize("size", [0.05, 0.3, 17, 0, 10**6])
def test_threshold_split_is_the_group_split(spark, plans, size):
    options = {"test_size": size, "validation_size": 20, "validation_lengths": (6, 14)}
    hot = spark.createDataFrame([("p0",)], "problem_id string")
    want = sorted(splits.group_split(plans, None, **options).select("plan_id", "split").collect())
    for partitions, keys in ((1, None), (7, hot)):
        found = splits.threshold_split(plans.repartition(partitions), keys, **options)
        assert sorted(found.select("plan_id", "split").collect()) == want


@pytest.mark.parametrize("accuracy", [20, 100, 1000])
def test_threshold_split_keeps_its_error(spark, accuracy):
    plans = spark.range(20_000).selectExpr("cast(id as string) plan_id", "concat('p', id div 3) problem_id", "10L length")
    found = splits.threshold_split(plans, None, test_size=0.2, validation_size=0, accuracy=accuracy)
    sizes = {r["split"]: r["n"] for r in found.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(sizes["test"] - 4_000) <= 20_000 / accuracy + 3
    assert splits.split_leakage(found).first()["n_leaking"] == 0


def test_threshold_split_of_nothing_and_of_unnamed_problems(spark):
    schema = "plan_id string, problem_id string, length long"
    assert splits.threshold_split(spark.createDataFrame([], schema), None, test_size=0.1).count() == 0
    unnamed = spark.createDataFrame([("a", None, 8), ("b", "p", 8)], schema)
    found = splits.threshold_split(unnamed, None, test_size=5, validation_size=0)
    assert {(r["plan_id"], r["split"]) for r in found.collect()} == {("a", "train"), ("b", "test")}


def test_same_seed_same_split_whatever_the_partitions(plans):
    once = split_of(plans.repartition(1), test_size=0.2, seed=3)
    assert once == split_of(plans.repartition(11), test_size=0.2, seed=3)
    assert once != split_of(plans, test_size=0.2, seed=4)


def test_too_few_eligible_plans_end_the_split(plans):
    found = split_of(plans, test_size=0.1, validation_size=10**6, validation_lengths=(6, 6))
    assert {s for _, s in found.values()} <= {"train", "test", "validation"}


def test_weighted_draw_prefers_large_groups(spark):
    small = [(f"s{i}", 1) for i in range(99)]
    groups = spark.createDataFrame([("big", 99), *small], "problem_id string, n_plans long")
    first = [
        splits._taken_before(groups, "n_plans", "n_plans", seed).filter("taken_before = 0").collect()[0]["problem_id"]
        for seed in range(30)
    ]
    assert 6 <= first.count("big") <= 24  # expected: half of the draws


def test_prefix_sums_cover_all_plans(plans):
    groups = plans.groupBy("problem_id").agg(F.count("*").alias("n_plans"))
    rows = splits._taken_before(groups, "n_plans", "n_plans", 7).join(groups, "problem_id").collect()
    total = 0
    for row in sorted(rows, key=lambda r: r["taken_before"]):
        assert row["taken_before"] == total
        total += row["n_plans"]
    assert total == plans.count()


def test_shards(plans):
    rows = splits.shards(plans, F.col("plan_id"), 3).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert all(r["shard"] == r["position"] % 3 for r in rows)
    again = splits.shards(plans.repartition(9), F.col("plan_id"), 3).collect()
    assert {(r["plan_id"], r["position"]) for r in rows} == {(r["plan_id"], r["position"]) for r in again}
    assert splits.hash_shards(plans, F.col("plan_id"), 3).select("shard").distinct().count() == 3


def test_sample(plans):
    sample = splits.sample_n(plans, F.col("plan_id"), 3)
    assert sample.count() == 3
    assert sorted(sample.collect()) == sorted(splits.sample_n(plans.repartition(5), F.col("plan_id"), 3).collect())


def test_leakage(plans):
    labelled = splits.group_split(plans, None, test_size=0.3)
    assert splits.split_leakage(labelled).collect()[0]["n_leaking"] == 0
    by_row = splits.hash_shards(plans, F.col("plan_id"), 2).withColumnRenamed("shard", "split")
    assert splits.split_leakage(by_row).collect()[0]["n_leaking"] > 0


def test_hot_problem_is_joined_apart(spark, plans):
    hot = spark.createDataFrame([("p0",)], "problem_id string")
    plain = splits.group_split(plans, None, test_size=0.2).select("plan_id", "split")
    apart = splits.group_split(plans, hot, test_size=0.2).select("plan_id", "split")
    assert sorted(plain.collect()) == sorted(apart.collect())
