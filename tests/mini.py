"""Small logistics plans and a plain step-by-step replay to compare with."""

from __future__ import annotations

import random

from planloom.plans.domains import LOGISTICS, predicate_token

OBJECTS = {"tru1": "truck", "obj1": "package", "pos1": "location", "pos2": "location", "cit1": "city"}
INITIAL = ["attru1pos1", "atobj1pos1", "incitypos1cit1", "incitypos2cit1"]
GOALS = ["atobj1pos2"]

LOAD = ("LOAD-TRUCK", ["obj1", "tru1", "pos1"])
DRIVE = ("DRIVE-TRUCK", ["tru1", "pos1", "pos2", "cit1"])
BACK = ("DRIVE-TRUCK", ["tru1", "pos2", "pos1", "cit1"])
STAY = ("DRIVE-TRUCK", ["tru1", "pos1", "pos1", "cit1"])
UNLOAD = ("UNLOAD-TRUCK", ["obj1", "tru1", "pos2"])

# name -> (steps, class, failing step, goal step, revisits)
PLANS = {
    "good": ([LOAD, DRIVE, UNLOAD], "valid", None, 3, 0),
    "early": ([DRIVE, LOAD, UNLOAD], "precondition_error", 2, None, None),
    "short": ([LOAD, DRIVE], "unsatisfied_goal_error", None, None, 0),
    "stranger": ([("LOAD-TRUCK", ["obj1", "tru9", "pos1"])], "unknown_type_error", None, None, None),
    "swapped": ([("LOAD-TRUCK", ["tru1", "obj1", "pos1"])], "type_checking_error", None, None, None),
    "arity": ([("LOAD-TRUCK", ["obj1", "tru1"])], "type_checking_error", None, None, None),
    "magic": ([("TELEPORT", ["obj1", "pos2"])], "bad_operator_error", None, None, None),
    "detour": ([DRIVE, BACK, LOAD, DRIVE, UNLOAD], "valid", None, 5, 1),
    "circle": ([STAY], "unsatisfied_goal_error", None, None, 1),
}
# A plan without steps whose goal holds from the start.
EMPTY = ("empty", [], ["atobj1pos2"], ["atobj1pos2"])


def chunk_rows():
    rows = [(n, 1, INITIAL, GOALS, p[0]) for n, p in PLANS.items()]
    name, steps, initial, goals = EMPTY
    return rows + [(name, 1, initial, goals, steps)]


SCHEMA = (
    "plan_id string, seq long, initial array<string>, goals array<string>, "
    "steps array<struct<op:string,args:array<string>>>"
)


def ground(atoms, params, args):
    slots = [v for v, _ in params]
    return {predicate_token(a[0]) + "".join(args[slots.index(v)] for v in a[1:]) for a in atoms}


def replay(initial, goals, steps, domain=LOGISTICS):
    """``(first failing step, goals missing at the end, goal step, revisits)``."""
    state, failing, seen, revisits = set(initial), None, [], 0
    reached = 0 if set(goals) <= state else None
    seen.append(frozenset(state))
    for i, (op, args) in enumerate(steps, 1):
        action = next((a for a in domain.actions if a.name == op), None)
        if action is not None:
            if failing is None and not ground(action.pre, action.params, args) <= state:
                failing = i
            state = (state - ground(action.delete, action.params, args)) | ground(action.add, action.params, args)
        if reached is None and set(goals) <= state:
            reached = i
        revisits += frozenset(state) in seen
        seen.append(frozenset(state))
    return failing, set(goals) - state, reached, revisits


def mutants(n: int, seed: int = 11):
    """Random walks over a small map, mutated by dropping, swapping and cutting steps."""
    rng = random.Random(seed)
    places = ["pos1", "pos2", "pos3"]
    initial = ["attru1pos1", "atobj1pos1", "atobj2pos2"] + [f"incity{p}cit1" for p in places]
    for i in range(n):
        at, steps = "pos1", []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.5:
                to = rng.choice(places)
                steps.append(("DRIVE-TRUCK", ["tru1", at, to, "cit1"]))
                at = to
            else:
                op = rng.choice(["LOAD-TRUCK", "UNLOAD-TRUCK"])
                steps.append((op, [rng.choice(["obj1", "obj2"]), "tru1", at]))
        change = rng.choice(["none", "drop", "swap", "cut"])
        j = rng.randrange(len(steps))
        if change == "drop":
            steps = steps[:j] + steps[j + 1 :]
        elif change == "swap" and j:
            steps[j - 1], steps[j] = steps[j], steps[j - 1]
        elif change == "cut":
            steps = steps[: j + 1]
        goals = rng.sample(["atobj1pos2", "atobj2pos3", "intru1", "attru1pos3", "atobj1pos1"], rng.randint(1, 2))
        goals = [g for g in goals if g != "intru1"] or ["attru1pos2"]
        yield f"m{i}", initial, goals + goals[:1], steps
