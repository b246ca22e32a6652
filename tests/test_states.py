"""Exact numbers of states and successor states against plain sets of facts."""

import random

import pytest
from mini import SCHEMA, ground, mutants
from pyspark.sql import functions as F

from planloom.operators import replay, states
from planloom.plans.corpus import from_chunks
from planloom.plans.domains import LOGISTICS

CUTS = [(65_536, 99), (4, 99), (2, 1)]


def walk(initial, steps):
    """The states of a plan as sets."""
    state, met = set(initial), [frozenset(initial)]
    for op, args in steps:
        state = after(state, op, args)
        met.append(frozenset(state))
    return met


def after(state, op, args):
    action = next((a for a in LOGISTICS.actions if a.name == op), None)
    if action is None:
        return state
    return (state - ground(action.delete, action.params, args)) | ground(action.add, action.params, args)


def chunks(spark, plans, size):
    rows = [
        (n, i + 1, initial if not i else [], goals if not i else [], steps[i : i + size])
        for n, initial, goals, steps in plans
        for i in range(0, max(len(steps), 1), size)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plans_of_all_kinds():
    """Random walks, a plan whose state becomes empty twice, one without facts or steps, and one with many facts."""
    yield from mutants(25, seed=5)
    load, back = ("LOAD-TRUCK", ["obj1", "tru1", "pos1"]), ("UNLOAD-TRUCK", ["obj1", "tru1", "pos1"])
    yield "swing", ["atobj1pos1", "attru1pos1"], [], [load, back] * 6
    yield "none", [], [], []
    many = [f"atobj{i}pos1" for i in range(150)] + ["attru1pos1"]
    loads = [("LOAD-TRUCK", [f"obj{i}", "tru1", "pos1"]) for i in range(150)]
    unloads = [("UNLOAD-TRUCK", [f"obj{i}", "tru1", "pos1"]) for i in reversed(range(150))]
    yield "many", many, [], loads + unloads + [("TELEPORT", ["obj1"])]


@pytest.mark.parametrize("block_steps,size", CUTS)
def test_numbers_are_equal_exactly_when_states_are(spark, block_steps, size):
    plans = list(plans_of_all_kinds())
    corpus = from_chunks(chunks(spark, plans, size), block_steps)
    found = {}
    for part in corpus.parts():
        for r in states.state_numbers(part, LOGISTICS).collect():
            found[r["plan_id"], r["step"]] = r["state"]
    for name, initial, _, steps in plans:
        met = walk(initial, steps)
        numbers = [found.pop((name, i)) for i in range(len(met))]
        assert [met.index(s) for s in met] == [numbers.index(n) for n in numbers], name
    assert not found


def test_equal_fingerprints_are_no_revisits(spark, monkeypatch):
    """Hashes that all collide change nothing, as no state is compared by its hash."""
    plans = list(mutants(20))
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    for block_steps in (65_536, 3):
        corpus = from_chunks(chunks(spark, plans, 99), block_steps)
        prints = corpus.over_parts(lambda part: replay.state_fingerprints(part, LOGISTICS))
        assert prints.select("fp1", "fp2").distinct().count() == 1
        got = {r["plan_id"]: r["n_distinct"] for r in states.repeated_states(corpus, LOGISTICS).collect()}
        assert got == {n: len(set(walk(i, s))) for n, i, _, s in plans}


@pytest.mark.parametrize("block_steps,size", CUTS)
def test_successors(spark, block_steps, size):
    rng = random.Random(2)
    plans = list(mutants(12, seed=3))
    places = ["pos1", "pos2", "pos3"]
    actions = [("DRIVE-TRUCK", ["tru1", a, b, "cit1"]) for a in places for b in places]
    actions += [(op, [o, "tru1", p]) for op in ("LOAD-TRUCK", "UNLOAD-TRUCK") for o in ("obj1", "obj2") for p in places]
    actions += [("TELEPORT", ["obj1", "pos1"]), ("LOAD-TRUCK", ["obj1", "tru1"]), ("LOAD-TRUCK", ["obj1", None, "pos1"])]
    rows, want = [], {}
    for name, initial, _, steps in plans:
        met = walk(initial, steps)
        for step in range(len(met) + 2):
            for token, (op, args) in enumerate(actions):
                rows += [(name, step, token, op, args)] * rng.randint(1, 2)
                action = next((a for a in LOGISTICS.actions if a.name == op), None)
                if step >= len(met) or action is None or len(args) != len(action.params) or None in args:
                    continue
                if ground(action.pre, action.params, args) <= met[step]:
                    following = frozenset(after(set(met[step]), op, args))
                    want[name, step, token] = met.index(following) if following in met else None
    corpus = from_chunks(chunks(spark, plans, size), block_steps)
    asked = spark.createDataFrame(rows, "plan_id string, step long, token_id int, op string, args array<string>")
    found = states.successors(corpus, LOGISTICS, asked)
    found = found.join(states.met_states(corpus, LOGISTICS), ["plan_id", "fp1", "fp2"], "left").collect()
    assert len(found) == len(want)
    assert {(r["plan_id"], r["step"], r["token_id"]): r["since"] for r in found} == want
    assert None in want.values() and len(set(want.values())) > 3


def test_empty_corpus(spark):
    corpus = from_chunks(spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([], "plan_id string, step long, token_id int, op string, args array<string>")
    assert states.repeated_states(corpus, LOGISTICS).count() == 0
    assert states.successors(corpus, LOGISTICS, asked).count() == 0
