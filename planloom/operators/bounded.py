"""Ordered work on groups of any size.

A plain ``Window.partitionBy(key)`` hands a whole group to one task, which fails
when one key holds a large share of the rows. Everything ordered here first
separates the few long groups, cuts them into blocks along their own order, and
carries a small per-block summary from one block to the next. Blocks are made
from values only, so a lost executor recomputes exactly the same ones.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.schemas import LONG_PLAN_STEPS

if TYPE_CHECKING:
    from planloom.plans.corpus import Part

# A key is hot when it has more rows than this, and more than its share of this many keys: so there
# cannot be more hot keys than that, and none with a larger share is left out.
HOT_ROWS = 1_000_000
HOT_KEYS = 2_000


def long_groups(
    df: DataFrame, keys: list[str], weight: Column | None = None, limit: int = LONG_PLAN_STEPS
) -> DataFrame | None:
    """Keys of the groups whose weight exceeds ``limit``; None if there are none.

    Sizes are counted now (one column-pruned, map-side combined job), so that a
    query over ordinary groups only is planned without the work for long ones.
    """
    size = F.sum(weight) if weight is not None else F.count(F.lit(1))
    sizes = df.groupBy(*keys).agg(size.alias("_size"))
    long = sizes.filter(F.col("_size") > limit).select(*keys)
    return None if long.isEmpty() else long


def unpruned(df: DataFrame) -> DataFrame:
    """The same rows, with all columns in use.

    Readers that need different columns of the same rows then share the exchange below, which would else be made once for
    each set of columns. The condition always holds; it is not deterministic, so it stays above the exchange.
    """
    return df.filter(F.xxhash64(*df.columns).bitwiseAND(F.lit(0)) + F.monotonically_increasing_id() >= 0)


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: list[str],
    long: DataFrame | None,
    weight: Column | None = None,
    out: str = "seq",
    long_rows: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Add the 1-based running position of each row inside its group.

    ``weight`` is the number of positions a row takes, ``block`` a leading part of
    ``order``. Returns the ordinary groups and the long groups as two frames: the
    ordinary ones keep the hash partitioning of ``keys`` for later grouping.
    ``long_rows`` are the rows of the long groups, where there is a better way to
    them than filtering ``df``.
    """
    step = (weight if weight is not None else F.lit(1)).cast("long")

    def start(partition: list[str]) -> Column:
        w = Window.partitionBy(*partition).orderBy(*order)
        return F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)) - step + 1

    if long is None:
        return df.withColumn(out, start(keys)), None
    ordinary = df.join(long, keys, "left_anti").withColumn(out, start(keys))

    rest = df.join(long, keys, "left_semi") if long_rows is None else long_rows
    totals = rest.groupBy(*keys, *block).agg(F.sum(step).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"_{c}") for c in keys + block],
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys + block])
    numbered = (
        rest.repartition(*keys, *block)
        .withColumn(out, start(keys + block))
        .join(totals, same)
        .withColumn(out, F.col(out) + F.col("_before"))
        .select(*df.columns, out)
    )
    return ordinary, numbered


def key_counts(
    df: DataFrame, by: str, key: Column | None = None, name: str = "key", rows: str | None = None
) -> DataFrame:
    """Rows per value of ``by`` as ``name, _rows``; ``key`` makes the key from the value.

    ``rows`` names a column of counts where ``df`` is aggregated already.
    """
    size = F.count(F.lit(1)) if rows is None else F.sum(rows)
    counts = df.groupBy(by).agg(size.alias("_rows"))
    return counts.select((F.col(by) if key is None else key).alias(name), "_rows")


def hot_keys(
    counts: list[DataFrame], rows: int = HOT_ROWS, most: int = HOT_KEYS
) -> DataFrame | None:
    """All keys with more than ``rows`` rows each and 1 / ``most`` of all rows; None if there are none.

    ``counts`` come from :func:`key_counts` and share no key.
    """
    key = counts[0].columns[0]
    sizes = reduce(DataFrame.unionByName, counts)
    share = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)) / most).scalar()
    hot = sizes.filter((F.col("_rows") > rows) & (F.col("_rows") > share)).select(key)
    return None if hot.isEmpty() else hot


def lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Left join to a table with one row per key; rows of hot keys are not shuffled.

    ``hot`` comes from :func:`hot_keys`, so what is broadcast has at most
    ``HOT_KEYS`` rows; all other keys take the ordinary join.
    """
    if hot is None:
        return left.join(right, key, "left")
    hot = F.broadcast(hot)
    cold_rows = left.join(hot, key, "left_anti").join(right, key, "left")
    hot_right = F.broadcast(right.join(hot, key, "left_semi"))
    hot_rows = left.join(hot, key, "left_semi").join(hot_right, key, "left")
    return cold_rows.unionByName(hot_rows)


def carry_last(
    rows: DataFrame, keys: list[str], block: str, value: str, order: str, flag: Column | None = None
) -> DataFrame:
    """For each block of a long group, the last non-null ``value`` of earlier blocks.

    With ``flag``, the column ``flag`` tells whether it is true in any block.
    """
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    flag = F.lit(False) if flag is None else flag
    summary = rows.groupBy(*keys, block).agg(last.alias(value), F.bool_or(flag).alias("flag"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        *keys,
        block,
        F.last(value, ignorenulls=True).over(earlier).alias(value),
        F.max("flag").over(group).alias("flag"),
    )


def running(part: Part, rows: DataFrame, totals: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Running totals along the steps, one row per plan, step and value of ``by``.

    ``totals`` names an aggregate (``sum`` or ``bit_xor``) per column. For long
    plans each block of steps receives the total of its earlier blocks as one row
    that sorts first; steps below 0 count to the first block.
    """
    combine = {c: getattr(F, how) for c, how in totals.items()}

    def total() -> list[Column]:
        return [f(c).alias(c) for c, f in combine.items()]

    def so_far(w) -> list[Column]:
        return [f(c).over(w).alias(c) for c, f in combine.items()]

    def ordered(keys: list[str], order: str, last: int):
        window = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(order))
        return window.rowsBetween(Window.unboundedPreceding, last)

    keys = ["plan_id", *by]
    inside = ordered(part.group(*by), "step", 0)
    if not part.blocked:
        points = rows.groupBy(*keys, "step").agg(*total())
        return points.select(*keys, "step", *so_far(inside))

    block = F.floor(F.greatest(F.col("step"), F.lit(0)) / part.block_steps).cast("long")
    points = rows.withColumn("block", block).groupBy(*keys, "block", "step").agg(*total())
    carried = points.groupBy(*keys, "block").agg(*total())
    carried = carried.select(
        *keys,
        "block",
        F.lit(None).cast("long").alias("step"),
        *so_far(ordered(keys, "block", -1)),
    ).filter(reduce(Column.__or__, [F.col(c).isNotNull() for c in combine]))
    return (
        points.unionByName(carried)
        .repartition(*keys, "block")
        .select(*keys, "step", *so_far(inside))
        .filter(F.col("step").isNotNull())
    )
