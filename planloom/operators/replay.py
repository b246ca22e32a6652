"""Replay of whole plan corpora against action pre- and post-conditions.

Every fact of a plan has a timeline of effects; a precondition holds when the
last effect before its step made the fact true. Inside one step the order is
preconditions, deletions, additions. Windows per (plan, fact) answer all
preconditions and goals of all plans; no state is ever materialised.

Numbered chunks of ordinary plans are already partitioned by plan, so nothing
below shuffles them again. Long plans are scanned in blocks of steps, and what
is known at the end of a block is carried into the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.operators.bounded import carry_last, long_groups, running
from planloom.plans.corpus import Corpus, Part
from planloom.plans.domains import Action, Domain
from planloom.schemas import LONG_PLAN_STEPS

# Order numbers on a timeline: three per step, and one after the last step.
_PROBE, _DELETE, _ADD = 0, 1, 2
_AT_END = 2**62
_LAST_BLOCK = 2**61

# For domains that are tables: the place of each kind of condition within a step, additions last.
AT_END = _AT_END
PLACES = {"pre": _PROBE, "delete": _DELETE, "add": _ADD}


def _event(fact: Column, order: Column, is_add: Column, step: Column) -> Column:
    return F.struct(
        fact.alias("fact"),
        order.cast("long").alias("ord"),
        is_add.cast("boolean").alias("is_add"),
        step.cast("long").alias("step"),
    )


def timeline(part: Part, domain: Domain, marks: bool = False) -> DataFrame:
    """One row per initial fact, precondition, effect and goal.

    ``is_add`` is null for what only asks (preconditions and, at the end, goals).
    The start of a plan, and with ``marks`` every step, leaves an empty fact.
    """
    op, args, step, fact, kind = (F.col(c) for c in ("op", "args", "step", "fact", "kind"))
    none = F.lit(None)

    def of_action(action: Action) -> Column:
        def events(atoms, place, is_add):
            return [
                _event(action.ground(a, args), step * 3 + place, is_add, step) for a in atoms
            ]

        return F.array(
            *events(action.pre, _PROBE, none),
            *events(action.delete, _DELETE, F.lit(False)),
            *events(action.add, _ADD, F.lit(True)),
        )

    mark = F.array(_event(F.lit(""), step * 3, none, step))
    effects = domain.by_operator(op, of_action)
    if marks:
        effects = F.coalesce(F.concat(mark, effects), mark)
    events = (
        F.when(kind == "init", F.array(_event(fact, F.lit(_ADD), F.lit(True), F.lit(0))))
        .when(kind == "goal", F.array(_event(fact, F.lit(_AT_END), none, none)))
        .when(kind == "start", mark)
        .otherwise(effects)
    )
    rows = part.items().select("plan_id", F.inline(events)).filter(F.col("fact").isNotNull())
    if not part.blocked:
        return rows
    return spread(part, rows)


def spread(part: Part, rows: DataFrame) -> DataFrame:
    """The events of long plans by block of steps; goals wait in a block after all others.

    A long plan may arrive in one partition (joined by plan), which would satisfy every window below.
    """
    placed = part.with_block(rows).withColumn("block", F.coalesce("block", F.lit(_LAST_BLOCK)))
    # All initial facts share a block, and all goals: each of them counts once.
    fixed = (F.col("ord") == _AT_END) | ((F.col("step") == 0) & (F.col("fact") != ""))
    fixed = F.coalesce(fixed, F.lit(False))
    placed = placed.filter(~fixed).unionByName(placed.filter(fixed).distinct())
    return placed.repartition("plan_id", "block", "fact")


# What a replay reads of the actions of a log.
LOG_FIELDS = ("precondition", "negative_effects", "positive_effects")


def log_timeline(rows: DataFrame) -> DataFrame:
    """The timeline of the rows of plan logs, from the preconditions and effects each action states itself.

    It needs no domain. A row is a line of a log, however long that is.
    """
    none, step = F.lit(None), F.col("step")

    def events(facts: Column, order: Column, is_add: Column, at: Column) -> Column:
        found = F.transform(facts, lambda f: _event(f, order, is_add, at))
        return F.coalesce(found, F.array().cast("array<struct<fact:string,ord:bigint,is_add:boolean,step:bigint>>"))

    facts = F.concat(
        events(F.col("initial"), F.lit(_ADD), F.lit(True), F.lit(0)),
        events(F.col("action.precondition"), step * 3 + _PROBE, none, step),
        events(F.col("action.negative_effects"), step * 3 + _DELETE, F.lit(False), step),
        events(F.col("action.positive_effects"), step * 3 + _ADD, F.lit(True), step),
        events(F.col("goals"), F.lit(_AT_END), none, none),
    )
    return rows.select(*(c for c in rows.columns if c == "key"), F.col("plan_name").alias("plan_id"), F.inline(facts))


def replay_logs(rows: DataFrame, block_steps: int = LONG_PLAN_STEPS, sizes: DataFrame | None = None) -> DataFrame:
    """Whether each precondition, and at the end each distinct goal (without a step), of plan logs holds.

    ``rows`` are those of :func:`planloom.sources.texts.log_rows`; where they have the ``key`` they are dealt by, events of
    whole logs are not moved. Logs with more steps than ``block_steps`` are
    replayed in blocks, like all long plans. ``sizes`` (``plan_name, n_actions``, a log may have several rows) tells how
    many steps the logs have where that is known, so that the logs need not be parsed to count them.
    """
    if sizes is None:
        long = long_groups(rows, ["plan_name"], F.col("action").isNotNull().cast("long"), block_steps)
    else:
        long = long_groups(sizes, ["plan_name"], F.col("n_actions"), block_steps)

    def of(part: Part) -> DataFrame:
        events = log_timeline(part.chunks)
        seen = observe(part, spread(part, events) if part.blocked else events)
        order = Window.partitionBy(*part.group("fact")).orderBy("ord")
        again = F.coalesce((F.lag("ord").over(order) == _AT_END) & (F.col("ord") == _AT_END), F.lit(False))
        asked = seen.withColumn("again", again).filter(F.col("is_add").isNull() & ~F.col("again"))
        return asked.select("plan_id", "step", "fact", F.col("held").alias("holds"))

    dealt = tuple(c for c in rows.columns if c == "key")
    if long is None:
        return of(Part(rows, False, block_steps, dealt))
    rows = rows.drop("key")
    ordinary, rest = rows.join(long, "plan_name", "left_anti"), rows.join(long, "plan_name", "left_semi")
    return of(Part(ordinary, False, block_steps)).unionByName(of(Part(rest, True, block_steps)))


def observe(part: Part, events: DataFrame) -> DataFrame:
    """Add ``held`` (the fact was true just before) and ``wanted`` (it is a goal)."""
    is_goal = F.col("ord") == _AT_END
    rows = events.withColumn("flag", is_goal)
    if part.blocked:
        carried = carry_last(events, ["plan_id", "fact"], "block", "is_add", "ord", is_goal)
        none = F.lit(None).cast("long")
        carried = carried.withColumns({"ord": F.lit(-1).cast("long"), "step": none})
        rows = rows.unionByName(carried, allowMissingColumns=True)
        rows = rows.repartition(*part.group("fact"))
    timeline_of = Window.partitionBy(*part.group("fact"))
    before = timeline_of.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last("is_add", ignorenulls=True).over(before), F.lit(False))
    return rows.withColumns({"held": held, "wanted": F.max("flag").over(timeline_of)}).filter(
        F.col("ord") >= 0
    )


def replay_facts(corpus: Corpus, domain: Domain) -> DataFrame:
    """Whether each precondition of each step holds: ``plan_id, step, fact, holds``."""
    is_probe = F.col("is_add").isNull() & F.col("step").isNotNull() & (F.col("fact") != "")

    def of(part: Part) -> DataFrame:
        asked = observe(part, timeline(part, domain)).filter(is_probe)
        return asked.select("plan_id", "step", "fact", F.col("held").alias("holds"))

    return corpus.over_parts(of)


def _last_truth(part: Part, domain: Domain, goals: bool = True) -> DataFrame:
    """Per plan and fact: whether it is true at the end, and whether it is a goal.

    Without ``goals``, facts that are goals only are left out.

    The final truth of a fact is an aggregate, combined before any shuffle, so no
    block is needed however long a plan is.
    """
    is_goal = F.col("ord") == _AT_END
    is_effect = F.col("is_add").isNotNull()
    ends = timeline(part, domain).filter(is_effect | is_goal if goals else is_effect).groupBy("plan_id", "fact")
    return ends.agg(
        F.max_by("is_add", F.when(is_effect, F.col("ord"))).alias("is_true"),
        F.bool_or(is_goal).alias("is_goal"),
    )


def unsatisfied_goals(corpus: Corpus, domain: Domain) -> DataFrame:
    """Goals that are not true after the last step: ``plan_id, fact``."""
    missing = F.col("is_goal") & ~F.coalesce(F.col("is_true"), F.lit(False))
    ends = corpus.over_parts(lambda part: _last_truth(part, domain))
    return ends.filter(missing).select("plan_id", "fact")


def final_facts(corpus: Corpus, domain: Domain) -> DataFrame:
    """The facts that are true after the last step: ``plan_id, fact``."""
    ends = corpus.over_parts(lambda part: _last_truth(part, domain, goals=False))
    return ends.filter("is_true").select("plan_id", "fact")


def goal_reached_step(corpus: Corpus, domain: Domain) -> DataFrame:
    """The first step after which all goals hold at once (0: at the start).

    Each goal fact counts -1 before the plan starts and then +1 or -1 whenever its
    truth changes; all goals hold when the running total is 0.
    """
    is_goal = F.col("ord") == _AT_END
    is_start = (F.col("fact") == "") & (F.col("step") == 0)
    flip = F.col("is_add").cast("int") - F.col("held").cast("int")

    def of(part: Part) -> DataFrame:
        ordered = Window.partitionBy(*part.group("fact")).orderBy("ord")
        repeats = F.coalesce(F.lag("ord").over(ordered) == _AT_END, F.lit(False))
        seen = observe(part, timeline(part, domain)).withColumn("repeats", repeats)
        change = F.when(is_goal, F.col("repeats").cast("int") - 1).otherwise(F.coalesce(flip, F.lit(0)))
        # The start always counts: a plan without goals has them all from there.
        points = seen.filter(F.col("wanted") | is_start).select(
            "plan_id",
            F.coalesce(F.col("step"), F.lit(-1)).cast("long").alias("step"),
            change.cast("long").alias("open"),
        )
        totals = running(part, points, {"open": "sum"})
        reached = totals.filter((F.col("open") == 0) & (F.col("step") >= 0))
        return reached.groupBy("plan_id").agg(F.min("step").alias("step"))

    return corpus.over_parts(of)


def state_fingerprints(part: Part, domain: Domain) -> DataFrame:
    """A 128-bit fingerprint of the state after each step (0: the initial state).

    The fingerprint is the exclusive or of the hashes of all true facts, so it only
    changes where the truth of a fact changes and is a running total.
    """
    is_mark = F.col("fact") == ""
    flips = F.col("is_add") != F.col("held")
    asks = F.col("is_add").isNull() & ~is_mark
    hash_of = {"fp1": F.xxhash64("fact"), "fp2": F.xxhash64(F.lit(1), F.col("fact"))}
    points = (
        observe(part, timeline(part, domain, marks=True).filter(~asks))
        .filter(is_mark | flips)
        .select(
            "plan_id", "step", *[F.when(is_mark, F.lit(0)).otherwise(h).alias(c) for c, h in hash_of.items()]
        )
    )
    return running(part, points, {"fp1": "bit_xor", "fp2": "bit_xor"})
