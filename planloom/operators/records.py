"""Plan records: whole-plan numbers, and tokens with their places in the whole plan.

A plan of any length has one row of numbers and one row per token; nothing holds a plan in one value
but the records that a reader gives as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.sequences import actions_index, end_index
from planloom.functions.tokens import problem_id
from planloom.plans.corpus import Corpus, Part
from planloom.schemas import ACTIONS, END, GOALS, START

# The sections of a record, in the order of a full sequence.
SECTIONS = ["initial_state", "goals", "actions"]

# What a token's place in its chunk is found from.
CHUNK_PLACES = ("seq", "initial_from", "goals_from")


def action_token(step: Column) -> Column:
    """A step as the upper-case token plan records hold."""
    return F.upper(F.concat(F.translate(step["op"], " -", ""), F.array_join(step["args"], "")))


def with_offsets(part: Part) -> DataFrame:
    """Chunks with ``initial_from, goals_from``: the plan's facts and goals before each chunk.

    Long plans add up blocks of steps first, so no task sees more than a block of chunks.
    """
    counts = {"initial_from": F.size("initial").cast("long"), "goals_from": F.size("goals").cast("long")}

    def before(window) -> dict[str, Column]:
        whole = window.rowsBetween(Window.unboundedPreceding, 0)
        return {c: F.sum(n).over(whole) - n for c, n in counts.items()}

    if not part.blocked:
        return part.chunks.withColumns(before(Window.partitionBy("plan_id").orderBy("seq")))
    block = F.floor((F.col("seq") - 1) / part.block_steps).cast("long")
    chunks = part.chunks.withColumn("block", block)
    totals = chunks.groupBy("plan_id", "block").agg(*[F.sum(n).alias(c) for c, n in counts.items()])
    earlier = Window.partitionBy("plan_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("plan_id").alias("_plan"),
        F.col("block").alias("_block"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in counts],
    )
    inside = chunks.repartition("plan_id", "block").withColumns(
        before(Window.partitionBy("plan_id", "block").orderBy("seq"))
    )
    placed = inside.join(totals, (F.col("plan_id") == F.col("_plan")) & (F.col("block") == F.col("_block")))
    placed = placed.withColumns({c: F.col(c) + F.col(f"_{c}") for c in counts})
    return placed.select(*part.chunks.columns, *counts)


def placed_tokens(corpus: Corpus, *keep: str) -> DataFrame:
    """Every token with its 0-based place in its section: ``plan_id, section, place, token``."""

    def section(name: str, tokens: Column, start: Column) -> Column:
        return F.transform(
            tokens,
            lambda t, i: F.struct(F.lit(name).alias("section"), (start + i).alias("place"), t.alias("token")),
        )

    def of(part: Part) -> DataFrame:
        tokens = F.concat(
            section("initial_state", F.col("initial"), F.col("initial_from")),
            section("goals", F.col("goals"), F.col("goals_from")),
            section("actions", F.transform("steps", action_token), F.col("seq") - 1),
        )
        return with_offsets(part).select("plan_id", *keep, F.inline(tokens))

    return corpus.over_parts(of)


def plan_actions(corpus: Corpus, *keep: str) -> DataFrame:
    """The action tokens with their steps from 1 on: ``plan_id, step, token``."""
    steps = F.posexplode(F.transform("steps", action_token)).alias("i", "token")
    found = corpus.over_parts(lambda part: part.chunks.select("plan_id", *keep, "seq", steps))
    return found.select("plan_id", *keep, (F.col("seq") + F.col("i")).alias("step"), "token")


def record_numbers(sizes: DataFrame, name: Column) -> DataFrame:
    """Names, lengths and indices of plans from their sizes, one row per plan."""
    n_init, n_goals, n_plan = (F.col(f"n_{s}") for s in SECTIONS)
    return sizes.select(
        "plan_id",
        name.alias("name"),
        F.concat(problem_id(name), F.lit(".pddl")).alias("pddl_problem_file"),
        n_init.alias("len_initial_state"),
        n_goals.alias("len_goals"),
        n_plan.alias("len_plan"),
        actions_index(n_init, n_goals).alias("actions_idx"),
        end_index(n_init, n_goals, n_plan).alias("eop_idx"),
    )


def dictionary_places(tokens: DataFrame) -> DataFrame:
    """``section, pos`` of :func:`planloom.operators.vocab.chunk_tokens` for placed tokens that kept ``CHUNK_PLACES``."""
    section, place, seq = F.col("section"), F.col("place"), F.col("seq")
    number = F.when(section == "actions", 0).when(section == "initial_state", 1).otherwise(2)
    at = F.when(section == "initial_state", place - F.col("initial_from")).otherwise(place - F.col("goals_from"))
    pos = F.when(section == "actions", place + 1).otherwise(seq + at)
    return tokens.withColumns({"section": number, "pos": pos}).drop(*CHUNK_PLACES)


def _positions(tokens: DataFrame, sizes: DataFrame, first: int) -> DataFrame:
    """Tokens with their ``position`` in a sequence whose first fact is at ``first``."""
    n_init, n_goals = F.col("n_initial_state"), F.col("n_goals")
    position = (
        F.when(F.col("section") == "initial_state", F.col("place") + first)
        .when(F.col("section") == "goals", n_init + F.col("place") + first + 1)
        .otherwise(n_init + n_goals + F.col("place") + first + 2)
    )
    return tokens.join(sizes, "plan_id").select(*tokens.columns, position.alias("position"))


def _marks(sizes: DataFrame, marks: list[tuple[Column, str]]) -> DataFrame:
    rows = F.array(*[F.struct(at.cast("long").alias("position"), F.lit(m).alias("token")) for at, m in marks])
    return sizes.select("plan_id", F.inline(rows))


def _marked(tokens: DataFrame, sizes: DataFrame, marks: list[tuple[Column, str]], first: int) -> DataFrame:
    """Tokens at their positions in a sequence whose first fact is at ``first``, with marks between."""
    own = _positions(tokens, sizes, first).select("plan_id", "position", "token")
    return own.unionByName(_marks(sizes, marks))


def sequence_marks(sizes: DataFrame) -> DataFrame:
    """The marks of full sequences: ``plan_id, position, token``."""
    n_init, n_goals, n_plan = (F.col(f"n_{s}") for s in SECTIONS)
    marks = [
        (F.lit(0), START),
        (n_init + 1, GOALS),
        (actions_index(n_init, n_goals), ACTIONS),
        (end_index(n_init, n_goals, n_plan), END),
    ]
    return _marks(sizes, marks)


def sequence_positions(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """The tokens of full sequences with their ``position``, without the marks."""
    return _positions(tokens, sizes, 1)


def sequence_tokens(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """Full sequences as ``plan_id, position, token``: start, state, goals, actions, end."""
    own = sequence_positions(tokens, sizes).select("plan_id", "position", "token")
    return own.unionByName(sequence_marks(sizes))


def state_tokens(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """The state text of each plan as rows ``plan_id, position, token``: facts, a mark, goals."""
    stated = tokens.filter(F.col("section") != "actions")
    return _marked(stated, sizes, [(F.col("n_initial_state"), GOALS)], 0)


def split_state(rows: DataFrame) -> DataFrame:
    """The rows of state texts split at their first mark: ``plan_id, section, place, token``.

    Without a mark all tokens are facts.
    """
    marks = rows.filter(F.col("token") == GOALS).groupBy("plan_id").agg(F.min("position").alias("mark"))
    joined = rows.join(marks, "plan_id", "left").filter(F.col("mark").isNull() | (F.col("position") != F.col("mark")))
    is_goal = F.coalesce(F.col("position") > F.col("mark"), F.lit(False))
    return joined.select(
        "plan_id",
        F.when(is_goal, "goals").otherwise("initial_state").alias("section"),
        F.when(is_goal, F.col("position") - F.col("mark") - 1).otherwise(F.col("position")).alias("place"),
        "token",
    )


def prompt_tokens(tokens: DataFrame, sizes: DataFrame, n: Column) -> DataFrame:
    """What a generator is asked to continue: state, goals and the first ``n`` actions of each plan."""
    n_init, n_goals = F.col("n_initial_state"), F.col("n_goals")
    given = tokens.filter((F.col("section") != "actions") | (F.col("place") < n))
    return _marked(given, sizes, [(n_init, GOALS), (n_init + n_goals + 1, ACTIONS)], 0)


def plan_records(nested: DataFrame) -> DataFrame:
    """The flat ten-column plan record of records that were read as one row each."""
    n_init, n_goals, n_plan = (F.size(c).cast("long") for c in ("initial", "goals", "actions"))
    return nested.select(
        "name",
        F.concat(problem_id(F.col("name")), F.lit(".pddl")).alias("pddl_problem_file"),
        F.array_join("initial", " ").alias("initial_state"),
        F.array_join("goals", " ").alias("goals"),
        F.array_join("actions", " ").alias("actions"),
        n_init.alias("len_initial_state"),
        n_goals.alias("len_goals"),
        n_plan.alias("len_plan"),
        actions_index(n_init, n_goals).alias("actions_idx"),
        end_index(n_init, n_goals, n_plan).alias("eop_idx"),
    )


def normalize_raw(raw: DataFrame) -> DataFrame:
    """Parsed plan logs as one nested record each: blanks and dashes removed."""
    clean = lambda items: F.transform(items, lambda t: F.translate(t, " -", ""))
    return raw.select(
        F.col("plan_name").alias("name"),
        clean("initial_state").alias("initial"),
        clean("goals").alias("goals"),
        clean(F.col("actions.name")).alias("actions"),
    )
