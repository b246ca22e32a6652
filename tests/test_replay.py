"""Replay and classification against a plain step-by-step replay."""

import pytest
from mini import GOALS, INITIAL, OBJECTS, PLANS, SCHEMA, chunk_rows, mutants, replay
from pyspark.sql import functions as F

from planloom.operators import replay as ops
from planloom.operators import states, validate
from planloom.plans import generated
from planloom.plans.corpus import Corpus, from_chunks, record_chunks
from planloom.plans.domains import LOGISTICS
from planloom.schemas import GENERATED_PLAN, MISSING_PROBLEM

# The whole plan in one block, and blocks so short that every carry is used.
BLOCKS = [65_536, 3, 1]


def objects(spark):
    return spark.createDataFrame(list(OBJECTS.items()), "name string, type string")


def cut(rows, size):
    """Every plan spread over chunks of ``size`` steps."""
    for plan, _, initial, goals, steps in rows:
        yield plan, 1, initial, goals, steps[:size]
        for i in range(size, len(steps), size):
            yield plan, i + 1, [], [], steps[i : i + size]


@pytest.fixture(scope="module", params=BLOCKS)
def mini(request, spark):
    corpus = from_chunks(spark.createDataFrame(chunk_rows(), SCHEMA), request.param)
    assert (corpus.long is None) == (request.param > 100)
    return corpus


def test_classes(mini, spark):
    found = validate.classify(mini, LOGISTICS, objects(spark)).collect()
    got = {r["plan_id"]: (r["class"], r["step"]) for r in found}
    expected = {n: (p[1], p[2]) for n, p in PLANS.items()}
    assert got == expected | {"empty": ("valid", None)}


def test_goal_step(mini):
    got = {r["plan_id"]: r["step"] for r in ops.goal_reached_step(mini, LOGISTICS).collect()}
    wanted = {n: p[3] for n, p in PLANS.items() if p[3] is not None}
    assert {n: s for n, s in got.items() if n in wanted or n == "empty"} == wanted | {"empty": 0}


def test_revisits(mini):
    got = {r["plan_id"]: r["n_revisits"] for r in states.repeated_states(mini, LOGISTICS).collect()}
    for name, plan in PLANS.items():
        if plan[4] is not None:
            assert got[name] == plan[4], name


@pytest.mark.parametrize("block_steps,chunk", [(65_536, 99), (65_536, 1), (4, 99), (2, 1)])
def test_mutants_equal_plain_replay(spark, block_steps, chunk):
    plans = list(mutants(80))
    rows = cut([(n, 1, i, g, s) for n, i, g, s in plans], chunk)
    corpus = from_chunks(spark.createDataFrame(list(rows), SCHEMA), block_steps)
    probes = ops.replay_facts(corpus, LOGISTICS).filter(~F.col("holds"))
    failing = {r["plan_id"]: r["s"] for r in probes.groupBy("plan_id").agg(F.min("step").alias("s")).collect()}
    missing = {(r["plan_id"], r["fact"]) for r in ops.unsatisfied_goals(corpus, LOGISTICS).collect()}
    reached = {r["plan_id"]: r["step"] for r in ops.goal_reached_step(corpus, LOGISTICS).collect()}
    again = {r["plan_id"]: r for r in states.repeated_states(corpus, LOGISTICS).collect()}
    kinds = set()
    for name, initial, goals, steps in plans:
        step, left, goal_step, revisits = replay(initial, goals, steps)
        assert failing.get(name) == step, name
        assert {f for n, f in missing if n == name} == left, name
        assert reached.get(name) == goal_step, name
        assert again[name]["n_revisits"] == revisits, name
        assert again[name]["n_states"] == len(steps) + 1
        kinds.add((step is None, not left))
    assert len(kinds) == 4


def test_plan_without_goals_is_done_at_the_start(spark):
    rows = [("p", 1, INITIAL, [], PLANS["good"][0])]
    corpus = Corpus(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in ops.goal_reached_step(corpus, LOGISTICS).collect()] == [("p", 0)]


def test_records_as_texts(spark):
    tokens = "LOADTRUCKOBJ1TRU1POS1 DRIVETRUCKTRU1POS1POS2CIT1 UNLOADTRUCKOBJ1TRU1POS2"
    rows = [("p", " ".join(INITIAL), " ".join(GOALS), tokens), ("q", " ".join(INITIAL), GOALS[0], "NONSENSE1")]
    records = spark.createDataFrame(rows, "name string, initial_state string, goals string, actions string")
    corpus = from_chunks(record_chunks(records, LOGISTICS))
    found = validate.classify(corpus, LOGISTICS, objects(spark))
    assert {(r["plan_id"], r["class"]) for r in found.collect()} == {("p", "valid"), ("q", "bad_operator_error")}


def test_objects_of_another_problem_are_unknown(spark):
    rows = [(p, 1, INITIAL, GOALS, PLANS["good"][0], q) for p, q in (("a", "here"), ("b", "there"), ("c", "twice"))]
    corpus = from_chunks(spark.createDataFrame(rows, SCHEMA + ", problem_id string"))
    own = [("here", r["name"], r["type"]) for r in objects(spark).collect()]
    own += [("there", n, t) for _, n, t in own if n != "tru1"]
    # A name listed with two types may be either.
    own += [("twice", n, t) for p, n, t in own if p == "here"] + [("twice", "tru1", "city")]
    listed = spark.createDataFrame(own, "problem_id string, name string, type string")
    found = {r["plan_id"]: r["class"] for r in validate.classify(corpus, LOGISTICS, listed).collect()}
    assert found == {"a": "valid", "b": "unknown_type_error", "c": "valid"}


def test_generated_plans_meet_their_problems(spark):
    tokens = "LOADTRUCKOBJ1TRU1POS1 DRIVETRUCKTRU1POS1POS2CIT1 UNLOADTRUCKOBJ1TRU1POS2"
    made = [("", tokens, 0, "p", "e1"), ("", tokens.lower(), 7, "p", "e2"), ("", tokens, 0, "q", "e3"), ("", "NONSENSE1", 1, "p", "e4"), ("", "", 1, "p", "e5")]
    made = spark.createDataFrame(made, GENERATED_PLAN)
    facts = [("p", "init", f) for f in INITIAL] + [("p", "goal", f) for f in GOALS]
    facts = spark.createDataFrame(facts, "problem_id string, section string, fact string")
    listed = objects(spark).withColumn("problem_id", F.lit("p"))
    plans = generated.generated_plans(made, facts, LOGISTICS)
    classes = validate.classify(generated.generated_corpus(made, facts, plans, LOGISTICS), LOGISTICS, listed)
    blocks = validate.classify(generated.generated_corpus(made, facts, plans, LOGISTICS, 2), LOGISTICS, listed)
    assert sorted(blocks.collect()) == sorted(classes.collect())
    classes = generated.with_plans(classes, plans, MISSING_PROBLEM)
    assert {(r["plan_id"], r["class"]) for r in classes.collect()} == {
        ("e1_0", "valid"), ("e2_7", "valid"), ("e3_0", "missing_problem"),
        ("e4_1", "bad_operator_error"), ("e5_1", "unsatisfied_goal_error"),
    }
    table = {r["actions_seen"]: r for r in validate.score_table(classes).collect()}
    assert (table[0]["total"], table[0]["missing_problem"], table[1]["skipped"], table[7]["valid"]) == (2, 1, 1, 1)


def test_missing_problems(spark):
    corpus = from_chunks(spark.createDataFrame(chunk_rows(), SCHEMA))
    plain = validate.classify(corpus, LOGISTICS, objects(spark))
    with_ids = plain.withColumn("problem_id", F.when(F.col("plan_id") == "good", "gone").otherwise("here"))
    known = spark.createDataFrame([("here",)], "problem_id string")
    classes = {r["plan_id"]: r["class"] for r in validate.with_problems(with_ids, known, None).collect()}
    assert classes["good"] == "missing_problem" and classes["detour"] == "valid"


def test_score_table_keeps_all_buckets(spark):
    rows = [("a", 0, "valid"), ("b", 0, "precondition_error"), ("c", 3, "valid"), ("d", 9, "valid")]
    classified = spark.createDataFrame(rows, "plan_id string, actions_seen int, class string")
    table = {r["actions_seen"]: r for r in validate.score_table(classified).collect()}
    assert sorted(table) == [0, 1, 2, 3, 4, 5, 9] and table[9]["valid"] == 1
    assert (table[0]["total"], table[0]["valid"], table[0]["precondition_error"]) == (2, 1, 1)
    assert table[1]["total"] == 0 and table[3]["valid"] == 1


def test_logs_of_known_sizes_are_not_parsed_to_be_counted(spark):
    unread = spark.range(1).select(F.lit("a.SOL").alias("plan_name"), F.raise_error(F.lit("parsed")).alias("action"))
    unread = unread.select("plan_name", F.lit(1).cast("long").alias("step"), *(F.expr(f"cast(null as array<string>) {c}") for c in ("initial", "goals")), F.struct(*(F.array(F.col("action").cast("string")).alias(c) for c in ("precondition", "positive_effects", "negative_effects"))).alias("action"))
    sizes = spark.createDataFrame([("a.SOL", 3), ("b.SOL", 1)], "plan_name string, n_actions long")
    assert ops.replay_logs(unread, 2, sizes).columns == ["plan_id", "step", "fact", "holds"]


@pytest.mark.parametrize("hot", [None, ["p1"]])
def test_names_are_judged_alike_in_hot_problems(spark, hot):
    load = ("LOAD-TRUCK", ["obj1", "tru1", "pos1"])
    steps = {"a": ("p1", [load]), "b": ("p1", [("LOAD-TRUCK", ["obj1", "tru9", "pos1"])]), "c": ("p2", [load]), "d": ("p1", [("LOAD-TRUCK", ["tru1", "obj1", "pos1"])])}
    rows = [(n, 1, ["attru1pos1", "atobj1pos1"], [], s, p) for n, (p, s) in steps.items()] + [("e", 1, [], [], [("WAIT", [])], "p1")]
    corpus = from_chunks(spark.createDataFrame(rows, SCHEMA + ", problem_id string"))
    listed = [("p1", "obj1", "package"), ("p1", "tru1", "truck"), ("p1", "tru1", "city"), ("p1", "pos1", "location"), ("p1", "pos1", "location"), ("p2", "obj1", "package")]
    listed = spark.createDataFrame(listed, "problem_id string, name string, type string")
    hot = None if hot is None else spark.createDataFrame([(h,) for h in hot], "problem_id string")
    found = {r["plan_id"]: r["class"] for r in validate.classify(corpus, LOGISTICS, listed, hot).collect()}
    assert found == {"a": "valid", "b": "unknown_type_error", "c": "unknown_type_error", "d": "type_checking_error", "e": "bad_operator_error"}
