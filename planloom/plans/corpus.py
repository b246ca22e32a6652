"""The long form every plan operator reads.

A *chunk* is a row ``(plan_id, seq, initial, goals, steps)``: some initial facts,
some goals and some consecutive steps of one plan, ``seq`` being the 1-based
position of its first step. A plan may be spread over any number of chunks, so a
nested record, a source line and a single step all fit the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.tokens import action_objects, action_operator
from planloom.operators.bounded import long_groups
from planloom.plans.domains import Domain
from planloom.schemas import LONG_PLAN_STEPS

@dataclass(frozen=True)
class Part:
    """Chunks of plans that are scanned alike: whole, or cut into blocks of steps.

    ``dealt`` are columns beside the plan that chunks of whole plans are dealt by; a plan has one value of each.
    """

    chunks: DataFrame
    blocked: bool
    block_steps: int
    dealt: tuple[str, ...] = ()

    def group(self, *keys: str) -> list[str]:
        """Grouping columns of an ordered scan; blocks only where plans are long."""
        return ["plan_id", "block", *keys] if self.blocked else [*self.dealt, "plan_id", *keys]

    def with_block(self, frame: DataFrame) -> DataFrame:
        """Add the block of each step (null for what has no step)."""
        if not self.blocked:
            return frame
        return frame.withColumn("block", F.floor(F.col("step") / self.block_steps).cast("long"))

    def items(self) -> DataFrame:
        """One row per plan start, initial fact, goal and step."""
        none = F.lit(None)

        def item(kind, step, op=none, args=none, fact=none) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"),
                step.cast("long").alias("step"),
                op.cast("string").alias("op"),
                args.cast("array<string>").alias("args"),
                fact.cast("string").alias("fact"),
            )

        start = F.array(item("start", F.lit(0)))
        no_start = F.array().cast(_ITEMS)
        return self.chunks.select(
            "plan_id",
            F.inline(
                F.concat(
                    F.when(F.col("seq") == 1, start).otherwise(no_start),
                    F.transform("initial", lambda f: item("init", F.lit(0), fact=f)),
                    F.transform(
                        "steps",
                        lambda s, i: item("step", F.col("seq") + i, op=s["op"], args=s["args"]),
                    ),
                    F.transform("goals", lambda f: item("goal", none, fact=f)),
                )
            ),
        )


_ITEMS = "array<struct<kind:string,step:long,op:string,args:array<string>,fact:string>>"


@dataclass(frozen=True)
class Corpus:
    """Chunks of ordinary plans, and of the plans longer than ``block_steps``.

    ``unordered`` may hold the same chunks in a form that is cheaper for work that
    does not depend on the order of the steps, as before their steps were numbered.
    """

    ordinary: DataFrame
    long: DataFrame | None = None
    unordered: DataFrame | None = None
    block_steps: int = LONG_PLAN_STEPS

    def parts(self) -> list[Part]:
        ordinary = Part(self.ordinary, False, self.block_steps)
        if self.long is None:
            return [ordinary]
        return [ordinary, Part(self.long, True, self.block_steps)]

    def over_parts(self, make: Callable[[Part], DataFrame]) -> DataFrame:
        """The results for ordinary and for long plans, which never share a plan."""
        return union([make(part) for part in self.parts()])

    def with_initial(self, facts: Column) -> Corpus:
        """The same plans with more initial facts, made of the columns that their chunks keep."""

        def more(chunks: DataFrame | None) -> DataFrame | None:
            return None if chunks is None else chunks.withColumn("initial", F.concat("initial", facts))

        return replace(self, ordinary=more(self.ordinary), long=more(self.long), unordered=more(self.unordered))

    def chunks(self) -> DataFrame:
        return self.over_parts(lambda part: part.chunks)

    def any_order(self) -> DataFrame:
        return self.chunks() if self.unordered is None else self.unordered


def union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def from_chunks(chunks: DataFrame, block_steps: int = LONG_PLAN_STEPS) -> Corpus:
    """Set the long plans of numbered chunks apart."""
    return set_apart(chunks, long_groups(chunks, ["plan_id"], F.size("steps"), block_steps), block_steps)


def set_apart(chunks: DataFrame, long: DataFrame | None, block_steps: int = LONG_PLAN_STEPS) -> Corpus:
    """The corpus of numbered chunks, of whose plans ``long`` are the long ones."""
    if long is None:
        return Corpus(chunks, block_steps=block_steps)
    return Corpus(
        chunks.join(long, "plan_id", "left_anti"),
        chunks.join(long, "plan_id", "left_semi"),
        chunks,
        block_steps,
    )


def record_chunks(records: DataFrame, domain: Domain, keep: Sequence[str] = ()) -> DataFrame:
    """Flat plan records (texts of blank-separated tokens) as chunks, with some of their columns."""

    def words(text: str) -> Column:
        return F.filter(F.split(F.col(text), " "), lambda w: w != "")

    def step(token: Column) -> Column:
        token = F.lower(token)
        return F.struct(
            F.coalesce(action_operator(token, domain), F.upper(token)).alias("op"),
            action_objects(token, domain).alias("args"),
        )

    return records.select(
        F.col("name").alias("plan_id"),
        F.lit(1).cast("long").alias("seq"),
        words("initial_state").alias("initial"),
        words("goals").alias("goals"),
        F.transform(words("actions"), step).alias("steps"),
        *keep,
    )
