"""Predictions against references: accuracy, loss, top-k, masking, step tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.scores import argmax, cross_entropy, log_sum_exp, top_k
from planloom.schemas import END


def topk_predictions(predictions: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` most probable tokens of each score vector, one row per rank.

    Ranks follow the scores; only the ``k`` best are turned into probabilities.
    """
    scored = predictions.select(
        *keys,
        F.posexplode(top_k(F.col("logits"), k)).alias("rank", "best"),
        log_sum_exp(F.col("logits")).alias("norm"),
    )
    return scored.select(
        *keys,
        (F.col("rank") + 1).alias("rank"),
        F.col("best.token_id").alias("token_id"),
        F.exp(F.col("best.value") - F.col("norm")).alias("probability"),
    )


def next_action_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of right next actions per number of actions seen (``position``)."""
    right = (argmax(F.col("logits")) == F.col("reference")).cast("int")
    return predictions.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right"), F.avg(right).alias("accuracy")
    )


def masked_losses(predictions: DataFrame) -> DataFrame:
    """Token losses of the actions only: from ``actions_idx`` on, references that are pads left out."""
    scored = predictions.filter(
        (F.col("position") >= F.col("actions_idx")) & F.col("reference").isNotNull()
    )
    return scored.withColumn("loss", cross_entropy(F.col("logits"), F.col("reference")))


def masked_loss(predictions: DataFrame, group: str, batch: str) -> DataFrame:
    """Per ``group``: the token mean of the loss, and the mean of its batch means."""
    batches = (
        masked_losses(predictions)
        .groupBy(group, batch)
        .agg(F.sum("loss").alias("total"), F.count(F.lit(1)).alias("n"))
    )
    return batches.groupBy(group).agg(
        F.sum("n").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_batches"),
        (F.sum("total") / F.sum("n")).alias("token_loss"),
        F.avg(F.col("total") / F.col("n")).alias("batch_loss"),
    )


def masked_argmax(scores: DataFrame, allowed: DataFrame, seen: DataFrame, end_id: int) -> DataFrame:
    """The best allowed token of each step, and the best one that leads to a new state.

    ``scores``: ``context, position, token_id, score``; ``allowed``: one row
    ``context, token_id, fingerprint`` per allowed token with the state it leads to, and its ``position``
    where that depends on the steps before;
    ``seen``: ``context, fingerprint, since`` for states met at position ``since``.
    The end token is always allowed and never leads to a seen state.
    """
    actions = allowed.filter(F.col("token_id") != end_id)
    moves = scores.join(actions, [c for c in ("context", "position", "token_id") if c in actions.columns])
    ends = scores.filter(F.col("token_id") == end_id)
    visited = moves.join(seen, ["context", "fingerprint"], "left").withColumn(
        "is_new", ~F.coalesce(F.col("since") < F.col("position"), F.lit(False))
    )
    columns = ["context", "position", "token_id", "score", "is_new"]
    candidates = visited.select(*columns).unionByName(ends.withColumn("is_new", F.lit(True)).select(*columns))
    rank = F.struct(F.col("score"), (-F.col("token_id")).alias("minus_id"))
    best = candidates.groupBy("context", "position").agg(
        F.max(rank).alias("greedy"), F.max(F.when(F.col("is_new"), rank)).alias("fresh")
    )
    return best.select(
        "context",
        "position",
        (-F.col("greedy.minus_id")).alias("greedy_id"),
        (-F.col("fresh.minus_id")).alias("token_id"),
    )


def explode_scores(predictions: DataFrame) -> DataFrame:
    """Score vectors as rows ``context, position, token_id, score``."""
    return predictions.select("context", "position", F.posexplode("logits").alias("token_id", "score"))


def step_match(predicted: DataFrame, real: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted against real actions by position; a missing real action is empty.

    ``predicted`` has ``keys, position, pred_action``, ``real`` has ``keys, position, real_action``;
    positions count from 1, so the number of actions seen before one is the position less one.
    """
    on = [*keys, "position"]
    actual = F.coalesce("real_action", F.lit(""))
    return predicted.join(real, on, "left").select(
        *on,
        (F.col("position") - 1).alias("seen_actions"),
        "pred_action",
        actual.alias("real_action"),
        (F.col("pred_action") == actual).alias("is_match"),
    )


# Predictions in a nested record.
PREDICTIONS_PER_RECORD = 1_000


def vector_length(predictions: DataFrame) -> int:
    """The number of scores of a prediction."""
    return predictions.agg(F.max(F.size("logits"))).first()[0] or 0


def error_analysis(
    examples: DataFrame, real: DataFrame, predictions: DataFrame, token_texts: DataFrame, k: int
) -> DataFrame:
    """One row per prediction with the real action it stands against.

    ``examples``: one row ``example, given, plan_length`` and any describing columns; ``real``:
    ``example, step, action`` (readable actions, steps from 0 on); ``predictions``: ``example, position,
    logits``; ``token_texts``: ``token_id, text``, at most as many as a vector has scores. The first
    ``given`` actions open a prediction, so position ``p`` has seen ``given + p`` actions and stands
    against the real action of that step; after the last action the end token is right, and later none.
    Predictions without an example stay, with ``has_example`` false: nothing was given, and no action is real.
    """
    given = F.coalesce("given", F.lit(0))
    ranked = predictions.join(examples.select("example", "given"), "example", "left").select(
        "example",
        "position",
        (given + F.col("position")).cast("long").alias("step"),
        F.posexplode(top_k(F.col("logits"), k)).alias("rank", "best"),
        log_sum_exp(F.col("logits")).alias("norm"),
    )
    probability = F.exp(F.col("best.value") - F.col("norm")).alias("probability")
    named = ranked.join(F.broadcast(token_texts), F.col("best.token_id") == F.col("token_id"), "left")
    entry = F.struct("rank", F.col("text").alias("action"), probability)
    top = named.groupBy("example", "position", "step").agg(F.sort_array(F.collect_list(entry)).alias("top"))
    top = top.withColumn("generated_action", F.get("top", F.lit(0))["action"])
    lengths = top.groupBy("example").agg(
        F.count_if(~F.col("generated_action").eqNullSafe(F.lit(END))).alias("generated_plan_length")
    )
    known = examples.drop("given").withColumn("has_example", F.lit(True))
    found = top.join(real, ["example", "step"], "left").join(known, "example", "left").join(lengths, "example")
    at_end = F.when(F.col("step") == F.col("plan_length"), F.lit(END))
    about = [c for c in examples.columns if c not in ("example", "given", "plan_length")]
    return found.select(
        "example",
        "position",
        F.coalesce("has_example", F.lit(False)).alias("has_example"),
        *about,
        F.col("plan_length").alias("real_plan_length"),
        "generated_plan_length",
        F.col("step").alias("actions_seen"),
        F.coalesce("action", at_end, F.lit("")).alias("real_action"),
        "generated_action",
        F.transform(
            "top", lambda t: F.struct(t["action"].alias("action"), t["probability"].alias("probability"))
        ).alias("top_k"),
    )


def example_records(analysed: DataFrame, per_record: int = PREDICTIONS_PER_RECORD) -> DataFrame:
    """The rows of :func:`error_analysis` as nested records of at most ``per_record`` predictions each.

    An example has as many records as it needs, numbered by ``part`` from 0 on; ``parts`` is their number. Each one
    repeats what describes the example, and holds its predictions in order.
    """
    own = ("position", "actions_seen", "real_action", "generated_action", "top_k")
    about = [c for c in analysed.columns if c not in own]
    part = F.floor(F.col("position") / per_record).cast("long")
    parts = analysed.groupBy("example").agg((F.max(part) + 1).alias("parts"))
    predictions = F.sort_array(F.collect_list(F.struct(*own)))
    chunks = analysed.withColumn("part", part).groupBy(*about, "part").agg(predictions.alias("predictions"))
    return chunks.join(parts, "example").select("example", "part", "parts", *about[1:], "predictions")
