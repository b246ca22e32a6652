"""Masked choices, losses, step tables and error documents against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planloom.operators import evaluation
from planloom.schemas import END


def test_masked_argmax(spark):
    rng = random.Random(8)
    scores, allowed, seen, expected = [], [], [], {}
    for context in range(40):
        options = {t: rng.randrange(5) for t in rng.sample(range(10), rng.randint(0, 6))}
        met = {f: rng.randrange(4) for f in rng.sample(range(5), rng.randint(0, 5))}
        allowed += [(context, t, f) for t, f in options.items()]
        seen += [(context, f, s) for f, s in met.items()]
        for position in range(4):
            vector = [rng.randrange(6) / 2 for _ in range(10)]
            scores += [(context, position, t, s) for t, s in enumerate(vector)]
            order = sorted(set(options) - {3} | {3}, key=lambda t: (-vector[t], t))
            fresh = [
                t for t in order
                if t == 3 or met.get(options[t]) is None or met[options[t]] >= position
            ]
            expected[context, position] = (order[0], fresh[0])
    got = evaluation.masked_argmax(
        spark.createDataFrame(scores, "context long, position int, token_id int, score double"),
        spark.createDataFrame(allowed, "context long, token_id int, fingerprint int"),
        spark.createDataFrame(seen, "context long, fingerprint int, since int"),
        3,
    )
    assert {(r["context"], r["position"]): (r["greedy_id"], r["token_id"]) for r in got.collect()} == expected


def test_masked_loss_means(spark):
    rows = [
        (0, 0, 0, 1, [0.0, 0.0], 0),  # before the actions: masked
        (0, 0, 1, 1, [0.0, 0.0], 0),
        (0, 0, 2, 1, [1.0, 3.0], 1),
        (0, 0, 3, 1, [1.0, 3.0], None),  # a pad
        (0, 1, 1, 1, [2.0, 0.0], 1),
    ]
    schema = "epoch int, batch long, position int, actions_idx int, logits array<double>, reference int"
    row = evaluation.masked_loss(spark.createDataFrame(rows, schema), "epoch", "batch").collect()[0]
    a, b, c = math.log(2), math.log(1 + math.exp(-2)), 2 + math.log(1 + math.exp(-2))
    assert (row["n_tokens"], row["n_batches"]) == (3, 2)
    assert row["token_loss"] == pytest.approx((a + b + c) / 3)
    assert row["batch_loss"] == pytest.approx(((a + b) / 2 + c) / 2)


def test_step_match(spark):
    predicted = [("p", 1, "A"), ("p", 2, "X"), ("p", 3, "C"), ("q", 1, "A")]
    predicted = spark.createDataFrame(predicted, "plan string, position long, pred_action string")
    real = spark.createDataFrame([("p", 1, "A"), ("p", 2, "B")], "plan string, position long, real_action string")
    rows = evaluation.step_match(predicted, real, ["plan"]).orderBy("plan", "position").collect()
    assert [tuple(r) for r in rows] == [
        ("p", 1, 0, "A", "A", True),
        ("p", 2, 1, "X", "B", False),
        ("p", 3, 2, "C", "", False),
        ("q", 1, 0, "A", "", False),
    ]


@pytest.mark.parametrize("given", [0, 1])
def test_error_analysis_rows(spark, given):
    texts = spark.createDataFrame([(0, "zero"), (1, "one"), (2, END)], "token_id int, text string")
    vectors = [[0.0, 2.0, 1.0], [3.0, 0.0, 1.0], [0.0, 0.0, 5.0]]
    scored = spark.createDataFrame(
        [("e", i, v) for i, v in enumerate(vectors)], "example string, position int, logits array<double>"
    )
    real = spark.createDataFrame([("e", 0, "one"), ("e", 1, "two")], "example string, step long, action string")
    examples = spark.createDataFrame([("e", given, 2, "name")], "example string, given int, plan_length long, example_name string")
    rows = evaluation.error_analysis(examples, real, scored, texts, 2).orderBy("position").collect()
    assert evaluation.vector_length(scored) == 3
    assert [r["generated_action"] for r in rows] == ["one", "zero", END]
    assert [r["real_action"] for r in rows] == (["one", "two", END], ["two", END, ""])[given]
    assert [r["actions_seen"] for r in rows] == [given, given + 1, given + 2]
    assert [t["action"] for t in rows[0]["top_k"]] == ["one", END]
    total = sum(math.exp(x) for x in vectors[0])
    assert rows[0]["top_k"][0]["probability"] == pytest.approx(math.exp(2) / total)
    assert {(r["real_plan_length"], r["generated_plan_length"], r["example_name"]) for r in rows} == {(2, 2, "name")}


def test_predictions_without_an_example_and_nested_records(spark):
    texts = spark.createDataFrame([(0, "zero"), (1, "one")], "token_id int, text string")
    scored = [(e, i, [float(i % 2), 0.5]) for e, n in (("known", 7), ("unknown", 3)) for i in range(n)]
    scored = spark.createDataFrame(scored, "example string, position int, logits array<double>")
    real = spark.createDataFrame([("known", 1, "one")], "example string, step long, action string")
    examples = spark.createDataFrame([("known", 1, 2, "name")], "example string, given int, plan_length long, example_name string")
    rows = evaluation.error_analysis(examples, real, scored, texts, 1)
    lost = rows.filter("NOT has_example").collect()
    assert sorted((r["position"], r["actions_seen"], r["real_action"]) for r in lost) == [(0, 0, ""), (1, 1, ""), (2, 2, "")]
    assert {r["real_plan_length"] for r in lost} == {None} and {r["generated_plan_length"] for r in lost} == {3}
    nested = {(r["example"], r["part"]): r for r in evaluation.example_records(rows, 3).collect()}
    assert {k: len(r["predictions"]) for k, r in nested.items()} == {("known", 0): 3, ("known", 1): 3, ("known", 2): 1, ("unknown", 0): 3}
    assert {k[0]: r["parts"] for k, r in nested.items()} == {"known": 3, "unknown": 1}
    told = [p["generated_action"] for n in range(3) for p in nested["known", n]["predictions"]]
    assert told == ["one", "zero", "one", "zero", "one", "zero", "one"]
    assert nested["known", 0]["predictions"][0]["real_action"] == "one" and nested["known", 0]["example_name"] == "name"


def test_accuracy(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 0), (1, [5.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "position int, logits array<double>, reference int")
    got = {r["position"]: r["accuracy"] for r in evaluation.next_action_accuracy(df).collect()}
    assert got == {0: 0.5, 1: 1.0}
    best = evaluation.topk_predictions(df.limit(1).withColumn("id", F.lit(1)), ["id"], 5).collect()
    assert [r["token_id"] for r in best] == [1, 0]
