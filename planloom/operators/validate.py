"""Classification of plans by their first and most serious error."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.operators.bounded import lookup
from planloom.operators.replay import observe, timeline
from planloom.plans.corpus import Corpus, Part
from planloom.plans.domains import Domain
from planloom.schemas import (
    ACTIONS_SEEN_BUCKETS,
    BAD_OPERATOR,
    MISSING_PROBLEM,
    PLAN_CLASSES,
    PRECONDITION,
    TYPE_CHECKING,
    UNKNOWN_TYPE,
    UNSATISFIED_GOAL,
    VALID,
)


# Room for the step below the rank of a finding.
_STEP_BITS = 48
_STEPS = 2**_STEP_BITS


def rank_of(plan_class: str) -> Column:
    return F.lit(PLAN_CLASSES.index(plan_class))


def name_findings(
    slots: DataFrame,
    known: DataFrame,
    fits: Column,
    hot: DataFrame | None = None,
    shared: bool = False,
    judged: Callable[[DataFrame], DataFrame] = lambda looked_up: looked_up,
) -> DataFrame:
    """What the steps of plans and the names in their slots break: ``plan_id, rank, step``.

    ``slots`` has ``plan_id, shape``, the keys of ``known`` (``name``, and ``problem_id`` where problems list their own
    objects) and what the slot wants; ``shape`` is the rank of what the step itself breaks. ``known`` has a row per key,
    with a flag ``is_known`` and whatever ``fits`` compares; ``judged`` may add to both once they have met. A slot meets
    the names of its problem once. Names that all problems share (or with ``shared`` may), and those of the problems
    ``hot``, are in many slots: there distinct uses, combined on the map side, are looked up, and only those that fail meet the slots again.
    """
    keys = [c for c in ("problem_id", "name") if c in known.columns]
    uses = [c for c in slots.columns if c not in ("plan_id", "shape")]
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in uses])
    rank = F.when(F.col("is_known").isNull(), rank_of(UNKNOWN_TYPE)).when(~fits, rank_of(TYPE_CHECKING))
    no_step = F.lit(None).cast("long").alias("step")

    def at_once(some: DataFrame) -> DataFrame:
        # Of a plan that is in one task already, equal slots are one row before they are moved to the names.
        looked_up = judged(some.distinct().join(known, keys, "left"))
        return looked_up.select("plan_id", F.least("shape", F.when(complete, rank)).alias("rank"), no_step)

    def combined(some: DataFrame) -> DataFrame:
        looked_up = judged(some.filter(complete).select(*uses).distinct().join(known, keys, "left"))
        failing = looked_up.select(*uses, rank.alias("rank")).filter(F.col("rank").isNotNull())
        found = some.join(failing, uses).select("plan_id", "rank", no_step)
        return found.unionByName(some.select("plan_id", F.col("shape").alias("rank"), no_step))

    if "problem_id" not in keys or (shared and hot is None):
        found = combined(slots)
    elif hot is None:
        found = at_once(slots)
    else:
        hot = F.broadcast(hot)
        cold, rest = slots.join(hot, "problem_id", "left_anti"), slots.join(hot, "problem_id", "left_semi")
        found = at_once(cold).unionByName(combined(rest))
    return found.filter(F.col("rank").isNotNull())


# Types in one number: a bit for each.
_TYPE_BITS = 62


def argument_findings(corpus: Corpus, domain: Domain, objects: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """What the operators and arguments of a plan's steps break: ``plan_id, rank, step``.

    ``objects`` has ``name, type``, and ``problem_id`` where each problem lists its own objects; the
    chunks then keep ``problem_id`` too, and ``hot`` are the problems with a large share of all steps, if any.
    A name with several types may be any of them: the types of a name are bits, and those that its slot accepts.
    """
    keys = [c for c in ("problem_id", "name") if c in objects.columns]
    steps = corpus.any_order().select("plan_id", *keys[:-1], F.inline("steps"))
    arity = domain.by_operator(F.col("op"), lambda a: F.lit(len(a.params)))
    shape = F.when(~domain.is_known(F.col("op")), rank_of(BAD_OPERATOR))
    shape = shape.when(F.size("args") != arity, rank_of(TYPE_CHECKING))

    types = sorted({t for a in domain.actions for _, wanted in a.params for t in domain.accepted_types(wanted)})
    groups = [types[i : i + _TYPE_BITS] for i in range(0, len(types), _TYPE_BITS)]

    def accepted(group: list[str]) -> Column:
        bits = F.when(F.lit(False), F.lit(0).cast("long"))
        for action in domain.actions:
            for i, (_, wanted) in enumerate(action.params):
                mask = sum(1 << n for n, t in enumerate(group) if t in domain.accepted_types(wanted))
                bits = bits.when((F.col("op") == action.name) & (F.col("slot") == i), F.lit(mask).cast("long"))
        return bits.otherwise(F.lit(0).cast("long"))

    def own(group: list[str]) -> Column:
        bits = F.when(F.lit(False), F.lit(0).cast("long"))
        for n, t in enumerate(group):
            bits = bits.when(F.col("type") == t, F.lit(1 << n).cast("long"))
        return F.bit_or(bits.otherwise(F.lit(0).cast("long")))

    slots = steps.select("plan_id", *keys[:-1], "op", shape.alias("shape"), F.posexplode_outer("args").alias("slot", "name"))
    slots = slots.select("plan_id", *keys, "shape", *(accepted(g).alias(f"wanted{i}") for i, g in enumerate(groups)))
    known = objects.groupBy(*keys).agg(F.lit(True).alias("is_known"), *(own(g).alias(f"types{i}") for i, g in enumerate(groups)))
    fits = [F.col(f"wanted{i}").bitwiseAND(F.col(f"types{i}")) != 0 for i in range(len(groups))]
    return name_findings(slots, known, reduce(Column.__or__, fits, F.lit(False)), hot, corpus.long is not None)


def condition_ranks(seen: DataFrame) -> DataFrame:
    """What preconditions and goals of an observed timeline speak for."""
    # The start of a plan asks nothing: it stands for a plan without errors.
    return seen.filter(F.col("is_add").isNull()).select(
        "plan_id",
        F.when(F.col("held") | (F.col("fact") == ""), rank_of(VALID))
        .when(F.col("step").isNull(), rank_of(UNSATISFIED_GOAL))
        .otherwise(rank_of(PRECONDITION))
        .alias("rank"),
        F.when(~F.col("held"), F.col("step")).alias("step"),
    )


def findings(corpus: Corpus, domain: Domain, objects: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Everything that speaks for a class of a plan: ``plan_id, rank, step``.

    Only preconditions need the order of the steps; the other checks read the chunks as they come.
    """

    def conditions(part: Part) -> DataFrame:
        return condition_ranks(observe(part, timeline(part, domain)))

    return corpus.over_parts(conditions).unionByName(argument_findings(corpus, domain, objects, hot))


def classify(corpus: Corpus, domain: Domain, objects: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per plan: ``plan_id, class, step`` (the first failing step of a precondition).

    ``hot`` are the problems with a large share of all steps, see :func:`argument_findings`.
    """
    return worst_class(findings(corpus, domain, objects, hot))


def worst_class(found: DataFrame) -> DataFrame:
    """The most serious finding of each plan."""
    # Rank and step in one number: its minimum is kept in a hash aggregate.
    code = F.col("rank").cast("long") * _STEPS + F.coalesce("step", F.lit(0))
    worst = found.groupBy("plan_id").agg(F.min(code).alias("worst"))
    names = F.array(*[F.lit(c) for c in PLAN_CLASSES])
    rank = F.floor(F.shiftright("worst", _STEP_BITS)).cast("int")
    step = F.col("worst").bitwiseAND(F.lit(_STEPS - 1))
    return worst.select(
        "plan_id",
        F.get(names, rank).alias("class"),
        F.when(rank == rank_of(PRECONDITION), step).alias("step"),
    )


def with_problems(
    classified: DataFrame, problems: DataFrame, hot_problems: DataFrame | None
) -> DataFrame:
    """Plans whose ``problem_id`` is not among ``problems`` get a class of their own."""
    known = problems.select("problem_id", F.lit(True).alias("is_known"))
    joined = lookup(classified, known, "problem_id", hot_problems)
    missing = F.col("is_known").isNull()
    return joined.select(
        "plan_id",
        "problem_id",
        F.when(missing, F.lit(MISSING_PROBLEM)).otherwise(F.col("class")).alias("class"),
        F.when(~missing, F.col("step")).alias("step"),
    )


def precondition_failures(classified: DataFrame) -> DataFrame:
    """Plans that fail on a precondition, with the step: ``plan_id, actions_seen, step``."""
    failed = classified.filter(F.col("class") == PRECONDITION)
    return failed.select("plan_id", "actions_seen", "step")


def score_table(classified: DataFrame, buckets: list[int] = ACTIONS_SEEN_BUCKETS) -> DataFrame:
    """Counts per class and ``actions_seen``; neither requested buckets nor others that occur are missing.

    Plans without a problem count as ``missing_problem``. Plans flagged in a column ``unreadable`` are
    classed like any others and counted as ``skipped`` besides.
    """
    spark = classified.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in buckets])).alias("actions_seen"))
    names = (VALID, PRECONDITION, TYPE_CHECKING, UNKNOWN_TYPE, BAD_OPERATOR, UNSATISFIED_GOAL, MISSING_PROBLEM)
    unreadable = F.col("unreadable") if "unreadable" in classified.columns else F.lit(False)
    counters = {"total": F.count("class")} | {c: F.count_if(F.col("class") == c) for c in names}
    counters["skipped"] = F.count_if(unreadable)
    counted = classified.groupBy("actions_seen").agg(*[n.alias(c) for c, n in counters.items()])
    filled = wanted.join(counted, "actions_seen", "full")
    return filled.select("actions_seen", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])
