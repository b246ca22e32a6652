"""Replay and classification of plans by domains that are tables, not code.

Steps meet the conditions of their operator in a join, which grounds them; arguments meet the types that their
slot accepts. The tables are broadcast while they are small, and joined by operator beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.operators.replay import AT_END, PLACES, observe, spread
from planloom.operators.validate import condition_ranks, name_findings, rank_of, worst_class
from planloom.plans.corpus import Corpus, Part
from planloom.schemas import BAD_OPERATOR, TYPE_CHECKING
from planloom.sources.domain_texts import PRE, DomainTables, ancestors

# Rows of a domain's table that are sent to all tasks.
SENT_ROWS = 20_000


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


class TableDomain:
    """One domain's tables, ready to be joined."""

    def __init__(self, tables: DomainTables):
        arity = tables.params.groupBy("op").agg((F.max("slot") + 1).alias("arity"))
        self.arity = small(arity)
        self.conds = small(tables.conds)
        accepted = ancestors(tables.types)
        wanted = tables.params.filter("slot >= 0").select("op", "slot", F.col("type").alias("wanted"))
        # Types below the wanted one, and that type itself where the tree does not list it.
        below = wanted.join(accepted, wanted["wanted"] == accepted["ancestor"]).select("op", "slot", accepted["type"])
        accepts = below.unionByName(wanted.withColumnRenamed("wanted", "type"))
        accepts = accepts.groupBy("op", "slot").agg(F.sort_array(F.collect_set("type")).alias("accepted"))
        # Slots that accept the same types are of one kind, named by the first of them.
        kinds = accepts.groupBy("accepted").agg(F.min(F.struct("op", "slot")).alias("kind"))
        self.accepted = small(kinds)
        self.kinds = small(accepts.join(kinds, "accepted").select("op", "slot", "kind"))


def _token(args: Column) -> Column:
    """The arguments of a condition put together; null when one is missing."""
    values = F.transform(F.col("cond_args"), lambda a: F.coalesce(a["constant"], F.get(args, a["slot"])))
    joined = F.concat(F.col("predicate"), F.array_join(values, ""))
    return F.when(~F.exists(values, lambda v: v.isNull()), joined)


def timeline(part: Part, domain: TableDomain) -> DataFrame:
    """The timeline of :func:`planloom.operators.replay.timeline`, grounded by a join."""
    kind, step = F.col("kind"), F.col("step")
    is_step = kind == "step"
    conds = domain.conds.select(F.col("op").alias("cond_op"), F.col("kind").alias("how"), "predicate", F.col("args").alias("cond_args"))
    # Facts, goals and starts pass the join, so that nothing has to be put together behind it, where chunks of plans would have
    # to be moved again. They have no operator; where the join moves rows, each is under a key of its own.
    key = F.when(is_step, F.col("op")).otherwise(F.concat(F.lit("("), F.xxhash64("plan_id", "fact").cast("string")))
    grounded = part.items().withColumn("cond_op", key).join(conds, "cond_op", "left")
    place = F.element_at(F.create_map(*(x for k, v in PLACES.items() for x in (F.lit(k), F.lit(v)))), F.col("how"))
    last = max(PLACES.values())
    rows = grounded.select(
        "plan_id",
        F.when(is_step, _token(F.col("args"))).when(kind == "start", "").otherwise(F.col("fact")).alias("fact"),
        F.when(is_step, step * 3 + place).when(kind == "goal", AT_END).when(kind == "init", last).otherwise(0).cast("long").alias("ord"),
        F.when(is_step, F.when(F.col("how") != PRE, place == last)).when(kind == "init", True).alias("is_add"),
        F.when(is_step, step).when(kind != "goal", 0).cast("long").alias("step"),
    )
    # A step of an unknown operator has no condition.
    rows = rows.filter(F.col("fact").isNotNull())
    return spread(part, rows) if part.blocked else rows


def argument_findings(corpus: Corpus, domain: TableDomain, objects: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """What the operators and arguments of a plan's steps break: ``plan_id, rank, step``."""
    keys = [c for c in ("problem_id", "name") if c in objects.columns]
    steps = corpus.any_order().select("plan_id", *keys[:-1], F.inline("steps")).join(domain.arity, "op", "left")
    shape = F.when(F.col("arity").isNull(), rank_of(BAD_OPERATOR)).when(F.size("args") != F.col("arity"), rank_of(TYPE_CHECKING))
    slots = steps.select("plan_id", *keys[:-1], "op", shape.alias("shape"), F.posexplode_outer("args").alias("slot", "name"))
    # A step without arguments has no slot.
    slots = slots.withColumn("slot", F.coalesce("slot", F.lit(-1)))
    # Slots of one kind are equal to the names of a problem.
    slots = slots.join(domain.kinds, ["op", "slot"], "left").drop("op", "slot")
    slots = slots.withColumn("kind", F.coalesce("kind", F.struct(F.lit("").alias("op"), F.lit(-1).alias("slot"))))
    known = objects.groupBy(*keys).agg(F.lit(True).alias("is_known"), F.collect_set("type").alias("types"))
    fits = F.coalesce(F.arrays_overlap("types", "accepted"), F.lit(False))

    def judged(looked_up: DataFrame) -> DataFrame:
        return looked_up.join(domain.accepted, "kind", "left")

    return name_findings(slots, known, fits, hot, corpus.long is not None, judged)


def classify(corpus: Corpus, domain: TableDomain, objects: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per plan: ``plan_id, class, step``, as :func:`planloom.operators.validate.classify` gives it."""
    conditions = corpus.over_parts(lambda part: condition_ranks(observe(part, timeline(part, domain))))
    return worst_class(conditions.unionByName(argument_findings(corpus, domain, objects, hot)))
