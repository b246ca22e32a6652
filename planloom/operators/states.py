"""States compared without ever being materialised: exact numbers of states, and the states that actions lead to.

Exact numbers are the facts of a plan as bits of a number. Where a plan has more facts than a number has bits, a tree
stands above the numbers: a node has up to ``FAN`` children, and two of its versions are equal when all its children's
versions are. So the root's versions are equal exactly when the states are, and each change of a fact costs one row per
level instead of one per fact of the state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.operators.bounded import number_rows, running
from planloom.operators.replay import PLACES, observe, spread, state_fingerprints, timeline
from planloom.plans.corpus import Corpus, Part
from planloom.plans.domains import Action, Domain
from planloom.session import ensure_checkpoint_dir

# Facts in one number, and children of a node above (a power of two).
BITS = 62
FAN_BITS = 3
FAN = 1 << FAN_BITS
_SLOTS = [f"c{i}" for i in range(FAN)]


def _stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _levels(facts: int) -> int:
    """Levels above the numbers, so that one node is left."""
    nodes, levels = facts // BITS + 1, 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def _most_facts(part: Part, domain: Domain) -> int:
    """No plan of the part has more different facts than this (one column-pruned count)."""
    effects = max(len(a.add) + len(a.delete) for a in domain.actions)

    def size(column: str) -> Column:
        return F.coalesce(F.size(column), F.lit(0)).cast("long")

    own = part.chunks.groupBy("plan_id").agg(F.sum(size("initial") + size("steps") * effects).alias("n"))
    return int(own.agg(F.max("n")).first()[0] or 0) + 1


def _changes(part: Part, domain: Domain) -> DataFrame:
    """``plan_id, step, fact``: every change of a fact, and one empty fact per state."""
    is_mark = F.col("fact") == ""
    asks = F.col("is_add").isNull() & ~is_mark
    seen = observe(part, timeline(part, domain, marks=True).filter(~asks))
    return seen.filter(is_mark | (F.col("is_add") != F.col("held"))).select("plan_id", "step", "fact")


def _numbered(part: Part, domain: Domain) -> tuple[DataFrame, int]:
    """The changes with the number of their fact in its plan as ``child``, and the levels of the tree."""
    changes = _changes(part, domain)
    if not part.blocked:
        rank = F.dense_rank().over(Window.partitionBy("plan_id").orderBy("fact"))
        return changes.withColumn("child", (rank - 1).cast("long")), _levels(_most_facts(part, domain))
    changes = _stored(changes)
    facts = changes.select("plan_id", "fact").distinct().withColumn("bucket", F.pmod(F.xxhash64("fact"), F.lit(4096)))
    _, numbered = number_rows(
        facts, ["plan_id"], ["bucket", "fact"], ["bucket"], changes.select("plan_id").distinct(), out="child"
    )
    numbered = _stored(numbered.select("plan_id", "fact", "child"))
    most = numbered.agg(F.max("child")).first()[0] or 0
    return changes.join(numbered, ["plan_id", "fact"]), _levels(int(most))


def _parents(part: Part, rows: DataFrame) -> DataFrame:
    """One level up: where a version of a node starts, the first step of the node with equal children.

    Rows are ``plan_id, step, child, version``. Version 0 is that of a node without a true fact, so a node that
    has not changed yet equals one that is empty again.
    """
    side = F.col("child").bitwiseAND(FAN - 1)
    placed = part.with_block(rows.withColumn("node", F.shiftright("child", FAN_BITS)))
    children = [F.max(F.when(side == i, F.col("version"))).alias(c) for i, c in enumerate(_SLOTS)]
    points = placed.groupBy(*part.group("node"), "step").agg(*children)
    if part.blocked:
        points = _stored(points)
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step"))).alias(c) for c in _SLOTS]
        earlier = Window.partitionBy("plan_id", "node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = points.groupBy("plan_id", "node", "block").agg(*last).select(
            "plan_id",
            "node",
            "block",
            F.lit(None).cast("long").alias("step"),
            *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in _SLOTS],
        )
        points = points.unionByName(carried).repartition(*part.group("node"))
    so_far = Window.partitionBy(*part.group("node")).orderBy(F.asc_nulls_first("step"))
    so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
    now = [F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0)).alias(c) for c in _SLOTS]
    filled = points.select("plan_id", "node", "step", *now).filter(F.col("step").isNotNull())
    same = ["plan_id", "node", *_SLOTS]
    if part.blocked:
        # One version may fill most of a plan: a join of stored tables is split, a window is not.
        filled = _stored(filled)
        firsts = _stored(filled.groupBy(*same).agg(F.min("step").alias("first")))
        filled = filled.join(firsts, same)
    else:
        filled = filled.withColumn("first", F.min("step").over(Window.partitionBy(*same)))
    is_empty = reduce(Column.__and__, [F.col(c) == 0 for c in _SLOTS])
    version = F.when(is_empty, F.lit(0)).otherwise(F.col("first") + 1).cast("long")
    return filled.select("plan_id", "step", F.col("node").alias("child"), version.alias("version"))


def state_numbers(part: Part, domain: Domain) -> DataFrame:
    """``plan_id, step, state``: states of a plan are equal exactly when their numbers are; no hash is compared."""
    changes, levels = _numbered(part, domain)
    # Two changes of a fact in one step cancel out.
    bit = F.when(F.col("fact") == "", F.lit(0)).otherwise(F.expr(f"shiftleft(1L, int(child % {BITS}))"))
    flips = changes.select("plan_id", "step", F.expr(f"child div {BITS}").alias("node"), bit.cast("long").alias("version"))
    rows = running(part, flips, {"version": "bit_xor"}, by=("node",)).withColumnRenamed("node", "child")
    for _ in range(levels):
        rows = _parents(part, rows)
    return rows.select("plan_id", "step", F.col("version").alias("state"))


def repeated_states(corpus: Corpus, domain: Domain) -> DataFrame:
    """Per plan, the number of states, of distinct states and of revisits, by exact comparison."""

    def of(part: Part) -> DataFrame:
        visits = state_numbers(part, domain).groupBy("plan_id", "state").agg(F.count(F.lit(1)).alias("visits"))
        states = visits.groupBy("plan_id").agg(
            F.sum("visits").alias("n_states"), F.count(F.lit(1)).alias("n_distinct")
        )
        return states.withColumn("n_revisits", F.col("n_states") - F.col("n_distinct"))

    return corpus.over_parts(of)


def met_states(corpus: Corpus, domain: Domain) -> DataFrame:
    """``plan_id, fp1, fp2, since``: the first step after which a plan is in a state (0: the initial one)."""
    prints = corpus.over_parts(lambda part: state_fingerprints(part, domain))
    return prints.groupBy("plan_id", "fp1", "fp2").agg(F.min("step").alias("since"))


def _asked(candidates: DataFrame, domain: Domain) -> DataFrame:
    """What each candidate asks of its state: its preconditions (no target), and its effects with the truth they set."""
    args = F.col("args")

    def of_action(action: Action) -> Column:
        def ask(fact: Column, target: Column) -> Column:
            return F.struct(fact.alias("fact"), target.cast("boolean").alias("target"))

        # Additions come last, so what is deleted and added is true.
        added = set(action.add)
        asks = [ask(action.ground(a, args), F.lit(None)) for a in dict.fromkeys(action.pre)]
        asks += [ask(action.ground(a, args), F.lit(True)) for a in dict.fromkeys(action.add)]
        asks += [ask(action.ground(a, args), F.lit(False)) for a in dict.fromkeys(action.delete) if a not in added]
        whole = F.array(ask(F.lit(""), F.lit(None)), *asks)
        return F.when((F.size(args) == len(action.params)) & ~F.exists(whole, lambda a: a["fact"].isNull()), whole)

    return candidates.select(
        "plan_id",
        F.col("step").alias("at"),
        "token_id",
        "op",
        "args",
        F.inline(domain.by_operator(F.col("op"), of_action)),
    )


def successors(corpus: Corpus, domain: Domain, candidates: DataFrame) -> DataFrame:
    """The state that each candidate leads to, where it is allowed.

    ``candidates``: ``plan_id, step, token_id, op, args``, an action that may follow the first ``step`` steps of a plan;
    repeated rows count once. Rows ``plan_id, step, token_id, fp1, fp2``: the fingerprint of the successor is that of
    the state, exclusive or the hashes of the facts the action changes. Steps beyond a plan's end, unknown operators,
    wrong numbers of arguments and unmet preconditions give no row.
    """
    asked = _asked(candidates.select("plan_id", "step", "token_id", "op", "args").distinct(), domain)
    # Two atoms may ground to one fact: an addition wins over a deletion.
    action = ["plan_id", "at", "token_id", "op", "args"]
    is_effect = F.col("target").isNotNull()
    asked = asked.groupBy(*action, "fact", is_effect.alias("is_effect")).agg(F.bool_or("target").alias("target"))

    def of(part: Part) -> DataFrame:
        own = asked
        if corpus.long is not None:
            own = asked.join(corpus.long.select("plan_id").distinct(), "plan_id", "left_semi" if part.blocked else "left_anti")
        probes = own.select(
            *action,
            "target",
            "fact",
            ((F.col("at") + 1) * 3 + PLACES["pre"]).cast("long").alias("ord"),
            F.lit(None).cast("boolean").alias("is_add"),
            (F.col("at") + 1).cast("long").alias("step"),
        )
        is_effect_event = F.col("is_add").isNotNull()
        events = timeline(part, domain).filter(is_effect_event).unionByName(
            spread(part, probes) if part.blocked else probes, allowMissingColumns=True
        )
        if part.blocked:
            events = events.repartition("plan_id", "block", "fact")
        held = observe(part, events).filter(F.col("at").isNotNull())
        flips = F.col("target").isNotNull() & (F.col("target") != F.col("held"))
        met = F.col("target").isNotNull() | F.col("held") | (F.col("fact") == "")
        hashes = {"d1": F.xxhash64("fact"), "d2": F.xxhash64(F.lit(1), F.col("fact"))}
        moves = held.groupBy(*action).agg(
            F.bool_and(met).alias("allowed"),
            *[F.coalesce(F.bit_xor(F.when(flips, h)), F.lit(0)).alias(c) for c, h in hashes.items()],
        )
        moves = moves.filter("allowed").withColumnRenamed("at", "step")
        prints = state_fingerprints(part, domain)
        return prints.join(moves, ["plan_id", "step"]).select(
            "plan_id",
            "step",
            "token_id",
            F.col("fp1").bitwiseXOR(F.col("d1")).alias("fp1"),
            F.col("fp2").bitwiseXOR(F.col("d2")).alias("fp2"),
        )

    return corpus.over_parts(of)
