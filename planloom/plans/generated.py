"""Generated plans with the problems they are meant to solve, as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.tokens import action_objects, action_operator, words
from planloom.operators.bounded import long_groups, unpruned
from planloom.plans.corpus import Corpus, set_apart
from planloom.plans.domains import Domain
from planloom.schemas import LONG_PLAN_STEPS
from planloom.sources.texts import INIT

# Facts in one chunk of a problem.
CHUNK_FACTS = 1_000


def _named() -> Column:
    return F.concat_ws("_", "example_id", "actions_seen").alias("plan_id")


def generated_plans(generated: DataFrame, problems: DataFrame, domain: Domain) -> DataFrame:
    """What is known of each generated plan: ``plan_id, problem_id, actions_seen, is_known, unreadable``.

    ``generated`` has ``plan, actions_seen, problem_id, example_id`` as readers give them, ``problems`` one row
    with ``problem_id`` per problem. A plan is named by its example and the actions seen; it may have any
    number of rows. ``is_known`` tells whether its problem was found, ``unreadable`` whether an action has no
    operator of the domain.
    """
    readable = F.forall(words(F.coalesce("plan", F.lit(""))), lambda t: action_operator(F.lower(t), domain).isNotNull())
    plans = generated.groupBy(_named(), "problem_id", "actions_seen").agg(
        F.bool_or(~readable).alias("unreadable")
    )
    known = problems.select("problem_id", F.lit(True).alias("is_known")).distinct()
    return plans.join(known, "problem_id", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def generated_corpus(
    generated: DataFrame,
    facts: DataFrame,
    plans: DataFrame,
    domain: Domain,
    block_steps: int = LONG_PLAN_STEPS,
    sizes: DataFrame | None = None,
    tasks: int | None = None,
) -> Corpus:
    """The corpus of generated plans, ready to be classified with objects per problem.

    Steps come from ``generated``, in pieces where a column ``seq`` numbers the first step of each row, facts from
    the rows ``problem_id, section, fact`` of the problems. Each of them is a chunk of its own; where facts have a
    ``place``, up to ``CHUNK_FACTS`` neighbours are one. So neither plans nor states are put together in a row.
    ``sizes`` (``example_id, actions_seen, n_actions``, a plan may have several rows) tells how many steps plans have
    where that is known, at least. Chunks are dealt by plan, into ``tasks`` partitions if their number is given.
    """

    def step(token):
        token = F.lower(token)
        op = F.coalesce(action_operator(token, domain), F.upper(token))
        return F.struct(op.alias("op"), action_objects(token, domain).alias("args"))

    no_fact = F.array().cast("array<string>")
    seq = F.col("seq") if "seq" in generated.columns else F.lit(1)
    steps = generated.select(
        _named(),
        seq.cast("long").alias("seq"),
        F.coalesce("plan", F.lit("")).alias("plan"),
        no_fact.alias("stated"),
        F.lit(False).alias("is_init"),
        "problem_id",
    )
    if "place" in facts.columns:
        dealt = [c for c in facts.columns if c == "key"]
        piece = F.floor(F.col("place") / CHUNK_FACTS).cast("long").alias("piece")
        facts = facts.groupBy(*dealt, "problem_id", "section", piece).agg(F.collect_list("fact").alias("stated"))
    else:
        facts = facts.withColumn("stated", F.array("fact"))
    stated = facts.join(plans.select("plan_id", "problem_id"), "problem_id").select(
        "plan_id",
        F.lit(0).cast("long").alias("seq"),
        F.lit("").alias("plan"),
        "stated",
        (F.col("section") == INIT).alias("is_init"),
        "problem_id",
    )

    def chunks(rows: DataFrame) -> DataFrame:
        is_init = F.col("is_init")
        return rows.select(
            "plan_id",
            "seq",
            F.when(is_init, F.col("stated")).otherwise(no_fact).alias("initial"),
            F.when(~is_init, F.col("stated")).otherwise(no_fact).alias("goals"),
            F.transform(words(F.col("plan")), step).alias("steps"),
            "problem_id",
        )

    # Facts are no steps, so they need not be made to count those.
    if sizes is None:
        long = long_groups(steps, ["plan_id"], F.size(words(F.col("plan"))), block_steps)
    else:
        long = long_groups(sizes.select(_named(), "n_actions"), ["plan_id"], F.col("n_actions"), block_steps)
    rows = steps.unionByName(stated)
    if long is not None:
        return set_apart(chunks(rows), long, block_steps)
    # What is asked in order and what in any order is read from one exchange of texts and facts, narrower than that of their events.
    rows = rows.repartition("plan_id") if tasks is None else rows.repartition(tasks, "plan_id")
    return set_apart(chunks(unpruned(rows)), None, block_steps)


def with_plans(classified: DataFrame, plans: DataFrame, missing: str) -> DataFrame:
    """Classes with what is known of each plan; plans without a problem get the class ``missing``."""
    joined = classified.join(plans, "plan_id")
    return joined.withColumns(
        {
            "class": F.when(F.col("is_known"), F.col("class")).otherwise(F.lit(missing)),
            "step": F.when(F.col("is_known"), F.col("step")),
        }
    )
