"""Text, sequence and score expressions on literal cases."""

import math
import random
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from planloom.functions import scores, sequences, tokens
from planloom.plans.domains import LOGISTICS, LOGISTICS_OBJECTS
from planloom.schemas import ACTIONS, END, GOALS, PAD, START


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    return row.select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    "token,decoded",
    [
        ("drivetrucktru2pos55pos33cit3", "DRIVE-TRUCK_tru2_pos55_pos33_cit3"),
        ("UNLOADTRUCKOBJ21TRU5APT4", "UNLOAD-TRUCK_obj21_tru5_apt4"),
        ("LOADAIRPLANEOBJ21APN8APT4", "LOAD-AIRPLANE_obj21_apn8_apt4"),
        ("teleportobj1", None),
        (END, END),
    ],
)
def test_decode_and_encode(spark, token, decoded):
    assert value(spark, tokens.decode_action(F.col("t"), LOGISTICS), t=token) == decoded
    if decoded and decoded != END:
        assert value(spark, tokens.encode_action(F.col("t")), t=decoded) == token.lower()


def test_names_and_normalisation(spark):
    name = "folder/xml-GEN-p12_4.SOL"
    assert value(spark, tokens.problem_id(F.col("n")), n=name) == "p12"
    assert value(spark, tokens.example_id(F.col("n")), n=name) == "p12_4"
    assert value(spark, tokens.normalize(F.col("n")), n="in-city pos1 cit1") == "incitypos1cit1"


def test_bracketed_plan(spark):
    plan = "LOADTRUCKOBJ1TRU1POS1  UNLOADTRUCKOBJ1TRU1POS2 WHAT1"
    lines = value(spark, tokens.bracket_plan(F.col("p"), LOGISTICS), p=plan)
    assert lines == "(LOAD-TRUCK OBJ1 TRU1 POS1)\n(UNLOAD-TRUCK OBJ1 TRU1 POS2)\n(WHAT1)\n"


def test_beautify_and_split(spark):
    pretty = tokens.beautify_facts(F.col("t"), LOGISTICS_OBJECTS)
    assert value(spark, pretty, t="atobj1pos2 incityapt3cit1") == "at_obj1_pos2 in_city_apt3_cit1"
    for text in ("f1 f2 <|goals|> g1", "f1 f2<|goals|>g1"):
        initial, goals = tokens.split_state_goals(F.col("t"))
        assert (value(spark, initial, t=text), value(spark, goals, t=text)) == ("f1 f2", "g1")


@pytest.mark.parametrize(
    "text,nth,expected",
    [("a<T>1<T>b", 2, "a<T>1</T>b"), ("a<T>1", 2, "a<T>1"), ("<T>", 1, "</T>"), ("", 1, ""), ("<T><T><T>", 3, "<T><T></T>")],
)
def test_replace_nth(spark, text, nth, expected):
    assert value(spark, tokens.replace_nth(F.col("t"), "<T>", "</T>", nth), t=text) == expected


def test_clean_words(spark):
    assert value(spark, tokens.clean_words(F.col("t")), t="A b\tC\x00d\n\n E ") == ["a", "b", "cd", "e"]


def test_prompts_and_sequences(spark):
    made = sequences.prompt(*(F.col(c) for c in "iga"), F.col("n"))
    inputs = dict(i="f1 f2", g="g1", a="A B C")
    assert value(spark, made, **inputs, n=2) == f"f1 f2 {GOALS} g1 {ACTIONS} A B"
    assert value(spark, made, **inputs, n=0) == f"f1 f2 {GOALS} g1 {ACTIONS}"
    assert value(spark, made, **inputs, n=9) == f"f1 f2 {GOALS} g1 {ACTIONS} A B C"
    whole = sequences.full_sequence(*(F.split(c, " ") for c in ("i", "g", "a")))
    row = value(spark, whole, **inputs)
    assert row == [START, "f1", "f2", GOALS, "g1", ACTIONS, "A", "B", "C", END]
    assert row.index(ACTIONS) == 2 + 1 + 2 and row.index(END) == 2 + 1 + 3 + 3


@pytest.mark.parametrize(
    "given,expected",
    [
        ([PAD, START, "f", ACTIONS, "A", "B", END, "C"], ["A", "B"]),
        ([START, "f", ACTIONS, "A", PAD, PAD], ["A"]),
        ([START, "f", ACTIONS, "A", "B"], ["A", "B"]),
        ([START, "f", ACTIONS, END], []),
        ([START, "f", ACTIONS], []),
    ],
)
def test_generated_actions(spark, given, expected):
    assert value(spark, sequences.generated_actions(F.col("t")), t=given) == expected
    assert value(spark, sequences.generated_length(F.col("t")), t=expected + [END]) == len(expected)


def test_shuffled_facts(spark):
    facts = [f"f{i}" for i in range(30)] + ["f1"]
    once = value(spark, sequences.shuffled(F.col("f"), 7, F.lit("p")), f=facts)
    assert once == value(spark, sequences.shuffled(F.col("f"), 7, F.lit("p")), f=facts)
    assert sorted(once) == sorted(facts) and once != facts
    assert once != value(spark, sequences.shuffled(F.col("f"), 8, F.lit("p")), f=facts)


def test_scores_against_plain_python(spark):
    rng = random.Random(5)
    for vector in ([rng.uniform(-800, 800) for _ in range(50)], [0.5, 2.0, 2.0, -1.0], [3.0]):
        top = max(vector)
        powers = [math.exp(x - top) for x in vector]
        expected = [p / sum(powers) for p in powers]
        got = value(spark, scores.softmax(F.col("v")), v=vector)
        assert got == pytest.approx(expected)
        assert value(spark, scores.argmax(F.col("v")), v=vector) == vector.index(top)
        best = value(spark, scores.top_k(F.col("v"), 3), v=vector)
        order = sorted(range(len(vector)), key=lambda i: (-vector[i], i))[:3]
        assert [(b["token_id"], b["value"]) for b in best] == [(i, vector[i]) for i in order]
        loss = value(spark, scores.cross_entropy(F.col("v"), F.lit(0)), v=vector)
        assert loss == pytest.approx(top + math.log(sum(powers)) - vector[0])


def test_generated_rows_equal_generated_actions(spark):
    rng, kinds = random.Random(4), [START, GOALS, ACTIONS, END, PAD, "A", "B"]
    sequences_of = [(i, [rng.choice(kinds) for _ in range(rng.randint(1, 9))]) for i in range(80)]
    rows = [(i, at, token) for i, tokens in sequences_of for at, token in enumerate(tokens)]
    found = sequences.generated_rows(spark.createDataFrame(rows, "plan_id long, position long, token string")).collect()
    whole = spark.createDataFrame(sequences_of, "plan_id long, t array<string>")
    want = whole.select("plan_id", F.posexplode(sequences.generated_actions(F.col("t"))).alias("place", "action")).collect()
    assert sorted((r["plan_id"], r["place"], r["action"]) for r in found) == sorted(map(tuple, want))
    n = Counter(r["plan_id"] for r in found)
    assert all(r["plan_length"] == n[r["plan_id"]] for r in found)


@pytest.mark.parametrize("limit", [65_536, 3])
@pytest.mark.parametrize("counted", [False, True])
def test_generated_rows_of_ordinary_and_long_sequences(spark, monkeypatch, limit, counted):
    monkeypatch.setattr(sequences, "long_groups", partial(sequences.long_groups, limit=limit))
    rng, kinds = random.Random(9), [START, GOALS, ACTIONS, END, PAD, "A", "B"]
    sequences_of = [(i, [rng.choice(kinds) for _ in range(rng.randint(1, 7))]) for i in range(60)]
    # Repeated positions, and a plan without a name.
    rows = [(i or None, at, token) for i, tokens in sequences_of for at, token in enumerate(tokens)]
    rows += [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    long = None if limit > 3 else spark.createDataFrame([(i,) for i, t in sequences_of if len(t) > 3], "plan_id long")
    tokens = spark.createDataFrame(rows, "plan_id long, position long, token string")
    found = sequences.generated_rows(tokens, long if counted else None, counted).collect()
    want = []
    for i, own in sequences_of[1:]:
        tail = own[own.index(ACTIONS) + 1 :] if ACTIONS in own else own
        stop = tail.index(END) if END in tail else tail.index(PAD) if PAD in tail else len(tail)
        want += [(i, place, t, stop) for place, t in enumerate(tail[:stop])] * (1 + (i % 10 == 0))
    assert sorted(map(tuple, found)) == sorted(want)


def test_generated_tokens_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, 0, ACTIONS), (1, 1, "A")], "plan_id long, position long, token string").write.parquet(f"{tmp_path}/t")
    plan = sequences.generated_rows(spark.read.parquet(f"{tmp_path}/t"), counted=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
