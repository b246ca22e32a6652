"""Shuffles, shards, samples and leakage-free splits.

Randomness is md5 of a seed and a key, so every result is the same whatever the
partitioning, and a recomputed task repeats its choice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.operators.bounded import lookup, number_rows

# Validation size and the length bounds of its plans, shuffle seed.
VALIDATION_SIZE = 20
VALIDATION_LENGTHS = (6, 14)
SEED = 7

_BUCKET_DIGITS = 4  # 16**4 = 65,536 ranges of an md5 order
_BINS_PER_UNIT = 256  # bins of a logarithmic order

# A quantile sketch is right to within this part of the rows; it holds a few numbers for each.
SKETCH_ACCURACY = 200_000


def order_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def unit_interval(seed: int, key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the order key."""
    bits = F.conv(F.substring(order_key(seed, key), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def sample_n(df: DataFrame, key: Column, n: int, seed: int = SEED) -> DataFrame:
    """The first ``n`` rows of a seeded shuffle (a bounded top-n per task)."""
    return df.orderBy(order_key(seed, key), key).limit(n)


def shuffled_positions(df: DataFrame, key: Column, seed: int = SEED, out: str = "position") -> DataFrame:
    """The 0-based position of every row in a seeded shuffle of the whole frame.

    Rows are counted per md5 range; at most 65,536 counts are added up in one task,
    and positions inside a range are found in parallel.
    """
    keyed = df.withColumns({"_order": order_key(seed, key), "_tie": key})
    keyed = keyed.withColumn("_range", F.substring("_order", 1, _BUCKET_DIGITS))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_order", "_tie"))
    return (
        keyed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col("_before") + F.col("_inside") - 1)
        .select(*df.columns, out)
    )


def shuffled_rows(rows: DataFrame, key: str, long: DataFrame | None) -> DataFrame:
    """Rows with a ``tag`` and a ``place`` in the order of their tags inside each ``key``: a new ``place``.

    ``long`` holds the keys with more rows than a task should order; those are ordered in ranges of tags.
    """
    ranged = rows.withColumn("range", F.substring("tag", 1, 3))
    frames = number_rows(ranged, [key], ["range", "tag", "place"], ["range"], long)
    numbered = [f.withColumn("place", F.col("seq") - 1).select(*rows.columns) for f in frames if f is not None]
    return numbered[0] if len(numbered) == 1 else numbered[0].unionByName(numbered[1])


def shards(df: DataFrame, key: Column, n: int, seed: int = SEED) -> DataFrame:
    """Add ``position`` in a seeded shuffle and ``shard`` = position modulo ``n``."""
    placed = shuffled_positions(df, key, seed)
    return placed.withColumn("shard", F.pmod("position", F.lit(n)).cast("int"))


def hash_shards(df: DataFrame, key: Column, n: int, seed: int = SEED) -> DataFrame:
    """Shards of about equal size without any shuffle."""
    bits = F.conv(F.substring(order_key(seed, key), 1, 13), 16, 10).cast("long")
    return df.withColumn("shard", F.pmod(bits, F.lit(n)).cast("int"))


def _draw_key(weight: str, seed: int) -> Column:
    """The place of a group in a weighted random order, as a number."""
    return -F.log(unit_interval(seed, F.col("problem_id"))) / F.col(weight)


def _taken_before(groups: DataFrame, weight: str, size: str, seed: int) -> DataFrame:
    """Groups in a weighted random order, with the plans taken before each one.

    Drawing plans at random and taking their whole group is sampling groups without
    replacement in proportion to their plans, i.e. in the order of -ln(u) / weight.
    The running total is formed in two levels: over at most about 20,000 bins of the
    logarithm of that key, then inside each bin.
    """
    eligible = groups.filter(F.col(weight) > 0)
    drawn = eligible.withColumn("_key", _draw_key(weight, seed)).withColumn(
        "_bin", F.floor(F.log("_key") * _BINS_PER_UNIT)
    )
    totals = drawn.groupBy("_bin").agg(F.sum(size).alias("_total"))
    earlier_bins = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bin", F.coalesce(F.sum("_total").over(earlier_bins), F.lit(0)).alias("_before"))
    earlier = (
        Window.partitionBy("_bin")
        .orderBy("_key", "problem_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum(size).over(earlier), F.lit(0))
    return (
        drawn.withColumn("_inside", inside)
        .join(F.broadcast(totals), "_bin")
        .select("problem_id", (F.col("_before") + F.col("_inside")).alias("taken_before"))
    )


def _target(size: float | int, plans_left: Column) -> Column:
    """A fraction of the plans left, rounded down, or an absolute number."""
    if isinstance(size, float):
        return F.floor(F.lit(size) * plans_left)
    return F.lit(size)


def split_groups(
    plans: DataFrame,
    test_size: float | int,
    validation_size: float | int = VALIDATION_SIZE,
    validation_lengths: tuple[int, int] = VALIDATION_LENGTHS,
    seed: int = SEED,
) -> DataFrame:
    """A split per problem: ``problem_id, n_plans, split``.

    ``plans`` has the columns ``problem_id`` and ``length``. Test is drawn first,
    then validation from plans of bounded length, the rest is train. A group is
    taken whole, so a split may exceed its size by the rest of its last group.
    """
    low, high = validation_lengths
    fits = F.col("length").between(low, high)
    # One row per problem, read several times below from one exchange.
    groups = plans.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("n_plans"), F.count_if(fits).alias("n_fitting")
    )

    def take(from_groups: DataFrame, weight: str, size: float | int, draw: int) -> DataFrame:
        left = from_groups.agg(F.coalesce(F.sum("n_plans"), F.lit(0))).scalar()
        order = _taken_before(from_groups, weight, "n_plans", draw)
        return order.filter(F.col("taken_before") < _target(size, left)).select("problem_id")

    test = take(groups, "n_plans", test_size, seed)
    rest = groups.join(test, "problem_id", "left_anti")
    validation = take(rest, "n_fitting", validation_size, seed + 1)
    drawn = test.withColumn("split", F.lit("test")).unionByName(
        validation.withColumn("split", F.lit("validation"))
    )
    labelled = groups.join(drawn, "problem_id", "left")
    return labelled.select("problem_id", "n_plans", F.coalesce("split", F.lit("train")).alias("split"))


def group_split(plans: DataFrame, hot_problems: DataFrame | None, **sizes) -> DataFrame:
    """Every plan with the split of its problem."""
    labels = split_groups(plans, **sizes).select("problem_id", "split")
    return lookup(plans, labels, "problem_id", hot_problems)


def threshold_split(
    plans: DataFrame,
    hot_problems: DataFrame | None,
    test_size: float | int,
    validation_size: float | int = VALIDATION_SIZE,
    validation_lengths: tuple[int, int] = VALIDATION_LENGTHS,
    seed: int = SEED,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """:func:`group_split` by thresholds: a split is all groups whose draw is at most a quantile of the plans' draws.

    The quantile comes from a mergeable sketch over all plans, so nothing is ordered, summed up in bins or joined but
    the draws themselves. Groups stay whole. A split reaches its size to within ``plans / accuracy`` plans, and exceeds
    it by the rest of its last group at most; up to ``accuracy / 2`` plans it is the split of :func:`group_split`.
    """
    low, high = validation_lengths
    fits = F.count_if(F.col("length").between(low, high))
    groups = plans.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n_plans"), fits.alias("n_fitting"))
    draws = groups.select(
        "problem_id",
        _draw_key("n_plans", seed).alias("_test"),
        F.when(F.col("n_fitting") > 0, _draw_key("n_fitting", seed + 1)).alias("_validation"),
    )
    drawn = lookup(plans, draws, "problem_id", hot_problems)

    def taken(left: DataFrame, draw: str, size: float | int) -> Column:
        total, able = left.agg(F.count(F.lit(1)), F.count(draw)).first()
        target = math.floor(size * total) if isinstance(size, float) else size
        if target <= 0 or not able:
            return F.lit(False)
        if target >= able:
            return F.col(draw).isNotNull()
        # Half a plan less than the target, so that rounding never asks for one more.
        cut = left.agg(F.percentile_approx(draw, (target - 0.5) / able, accuracy)).first()[0]
        return F.coalesce(F.col(draw) <= cut, F.lit(False))

    test = taken(drawn, "_test", test_size)
    validation = taken(drawn.filter(~test), "_validation", validation_size)
    split = F.when(test, "test").when(validation, "validation").otherwise("train")
    return drawn.withColumn("split", split).drop("_test", "_validation")


def split_leakage(labelled: DataFrame) -> DataFrame:
    """Problems, and those whose plans fall into more than one split."""
    # Hashes of the labels: their minimum and maximum are kept in a hash aggregate.
    side = F.xxhash64("split")
    sides = labelled.groupBy("problem_id").agg(F.min(side).alias("low"), F.max(side).alias("high"))
    return sides.agg(
        F.count(F.lit(1)).alias("n_problems"),
        F.count_if(F.col("low") != F.col("high")).alias("n_leaking"),
    )

