"""Score vectors (one value per token id) as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(scores: Column) -> Column:
    return scores.cast("array<double>")


def log_sum_exp(scores: Column) -> Column:
    """One pass over the vector; the maximum is found once and kept in the state."""
    start = F.struct(F.array_max(scores).alias("top"), F.lit(0.0).alias("total"))

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + F.exp(x - state["top"])
        return F.struct(state["top"].alias("top"), total.alias("total"))

    return F.aggregate(scores, start, add, lambda state: state["top"] + F.log(state["total"]))


def softmax(scores: Column) -> Column:
    """Probabilities of a vector; the inner array of one binds the normaliser once."""
    scaled = F.transform(
        F.array(log_sum_exp(scores)), lambda norm: F.transform(scores, lambda x: F.exp(x - norm))
    )
    return F.get(scaled, F.lit(0))


def cross_entropy(scores: Column, reference: Column) -> Column:
    """The loss of one prediction; null when the reference is not a token id."""
    return log_sum_exp(scores) - F.get(scores, reference)


def argmax(scores: Column) -> Column:
    """The token id with the highest score, the lowest id on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """The ``k`` best ``(token_id, value)`` of a vector, the lowest id first on ties."""
    tagged = F.transform(scores, lambda x, i: F.struct((-x).alias("rank"), i.alias("token_id")))
    best = F.slice(F.array_sort(tagged), 1, k)
    return F.transform(
        best, lambda t: F.struct(t["token_id"].alias("token_id"), (-t["rank"]).alias("value"))
    )
