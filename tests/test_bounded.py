"""Ordered work on long groups and joins on hot keys give the plain result."""

import random

from pyspark.sql import functions as F

from planloom.operators.bounded import hot_keys, key_counts, long_groups, lookup, number_rows
from planloom.plans.corpus import union


def rows(spark, n=400):
    rng = random.Random(3)
    data = [("big" if i % 2 else f"k{rng.randrange(30)}", rng.randrange(9), i, 1 + i % 3) for i in range(n)]
    data += [("big", None, n + i, 1) for i in range(3)]
    return spark.createDataFrame(data, "key string, block int, tie int, weight int")


def test_number_rows_of_long_groups(spark):
    df = rows(spark)
    order, weight = ["block", "tie"], F.col("weight")
    assert long_groups(df, ["key"], limit=10_000) is None
    long = long_groups(df, ["key"], weight, limit=60)
    assert [r["key"] for r in long.collect()] == ["big"]
    plain, none = number_rows(df, ["key"], order, ["block"], None, weight)
    ordinary, rest = number_rows(df, ["key"], order, ["block"], long, weight)
    assert none is None and rest.count() > ordinary.filter("key = 'big'").count() == 0
    assert sorted(map(str, plain.collect())) == sorted(map(str, union([ordinary, rest]).collect()))


def test_number_rows_is_independent_of_partitions(spark):
    df = rows(spark)
    long = long_groups(df, ["key"], limit=60)
    once = union(list(number_rows(df.repartition(1), ["key"], ["block", "tie"], ["block"], long)))
    again = union(list(number_rows(df.repartition(13), ["key"], ["block", "tie"], ["block"], long)))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_lookup_with_hot_keys(spark):
    left = rows(spark)
    right = spark.createDataFrame([("big", 1), ("k3", 2), ("k4", 3)], "key string, value int")
    assert hot_keys([key_counts(left, "key")]) is None
    hot = hot_keys([key_counts(left, "key")], rows=100)
    assert [r["key"] for r in hot.collect()] == ["big"]
    plain = lookup(left, right, "key", None)
    split = lookup(left, right, "key", hot)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(*plain.columns).collect()))


def test_hot_keys_have_a_share_of_all_rows(spark):
    left = spark.range(1000).select((F.col("id") % 100).alias("key"))
    assert hot_keys([key_counts(left, "key")], rows=1, most=7) is None
    assert hot_keys([key_counts(left, "key")], rows=1, most=200).count() == 100
