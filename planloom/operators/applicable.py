"""Which actions a state allows, as joins of its facts on shared variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.tokens import OBJECT_LETTERS, OBJECT_NAME
from planloom.plans.corpus import union
from planloom.plans.domains import Action, Atom, Domain, predicate_token


def parse_facts(facts: DataFrame, domain: Domain) -> DataFrame:
    """Fact tokens as ``plan_id, predicate, args, letters``; the letters of an argument tell its type."""
    known = sorted(domain.predicates(), key=len, reverse=True)
    pattern = "^(" + "|".join(known) + ")"
    split = facts.select("plan_id", "fact", F.regexp_extract("fact", pattern, 1).alias("predicate"))
    rest = F.substr("fact", F.length("predicate") + 1)
    return split.select(
        "plan_id",
        "predicate",
        F.regexp_extract_all(rest, F.lit(OBJECT_NAME), F.lit(1)).alias("args"),
        F.regexp_extract_all(rest, F.lit(OBJECT_LETTERS), F.lit(1)).alias("letters"),
    )


def _joinable_order(action: Action) -> list[tuple[Atom, list[str]]]:
    """The preconditions of an action, each with the variables earlier ones bind."""
    order, bound, waiting = [], set(), list(action.pre)
    while waiting:
        atom = next((a for a in waiting if not order or bound & set(a[1:])), None)
        if atom is None:
            raise ValueError(f"{action.name}: preconditions share no variable")
        waiting.remove(atom)
        order.append((atom, sorted(bound & set(atom[1:]))))
        bound |= set(atom[1:])
    return order


def _bindings(parsed: DataFrame, domain: Domain) -> DataFrame:
    """What the facts bind in the preconditions of every action.

    Rows ``plan_id, action, place, key, slots``: the values of all parameters, null where the precondition at
    that place does not mention them, and the values it shares with earlier places (at the first place, those
    that the second place shares with it).
    """
    rows = []
    for action in domain.actions:
        order = _joinable_order(action)
        types = dict(action.params)
        for place, (atom, shared) in enumerate(order):
            values = {v: F.get("args", F.lit(i)) for i, v in enumerate(atom[1:])}
            fits = (F.col("predicate") == predicate_token(atom[0])) & (F.size("args") == len(values))
            for i, variable in enumerate(atom[1:]):
                fits = fits & F.get("letters", F.lit(i)).isin(domain.named(types[variable]))
            if place == 0 and len(order) > 1:
                shared = order[1][1]
            none = F.lit(None).cast("string")
            row = F.struct(
                F.lit(action.name).alias("action"),
                F.lit(place).alias("place"),
                F.concat_ws(" ", *[values[v] for v in shared]).alias("key"),
                F.array(*[values.get(v, none) for v, _ in action.params]).alias("slots"),
            )
            rows.append(F.when(fits, row))
    return parsed.select("plan_id", F.inline(F.array(*rows))).filter(F.col("action").isNotNull())


def applicable_actions(facts: DataFrame, domain: Domain) -> DataFrame:
    """Distinct ``plan_id, action`` that the distinct facts of a plan allow.

    All actions take part in one join per place of a precondition, on the values it
    shares with earlier ones. A parameter no precondition mentions may be any object
    of its type; it stays a variable (``?type``) instead of being multiplied out.
    """
    actions = [a for a in domain.actions if a.pre]
    orders = {a.name: _joinable_order(a) for a in actions}
    # One exchange serves both sides of the joins below. The filter is not deterministic, or it would be pushed below
    # that exchange on either side, and the facts be made and parsed for each.
    found = _bindings(parse_facts(facts, domain), domain).repartition("plan_id", "action", "key")

    def at_place(n: int) -> DataFrame:
        return found.filter(F.when(F.monotonically_increasing_id() >= 0, F.col("place") == n)).drop("place")

    def with_places(n: int) -> list[str]:
        return [name for name, order in orders.items() if len(order) == n]

    def longer(n: int) -> list[str]:
        return [name for name, order in orders.items() if len(order) > n]

    bound = at_place(0)
    complete = []
    for place in range(1, max(len(o) for o in orders.values())):
        if with_places(place):
            complete.append(bound.filter(F.col("action").isin(with_places(place))).select("plan_id", "action", "slots"))

        def shared_values(action: Action, place: int = place) -> Column:
            names = [v for v, _ in action.params]
            order = orders.get(action.name, [])
            shared = order[place][1] if len(order) > place else []
            return F.concat_ws(" ", *[F.get("slots", F.lit(names.index(v))) for v in shared])

        left = bound.filter(F.col("action").isin(longer(place)))
        if place > 1:
            left = left.withColumn("key", domain.by_operator(F.col("action"), shared_values))
        right = at_place(place).withColumnRenamed("slots", "more")
        merged = F.zip_with("slots", "more", lambda x, y: F.coalesce(x, y))
        joined = left.join(right, ["plan_id", "action", "key"])
        bound = joined.select("plan_id", "action", merged.alias("slots"))
    bound = bound.select("plan_id", "action", "slots")
    complete.append(bound)

    def text(action: Action) -> Column:
        kinds = F.array(*[F.lit(f"?{kind}") for _, kind in action.params])
        return F.concat_ws("_", F.lit(action.name), F.zip_with("slots", kinds, lambda x, k: F.coalesce(x, k)))

    allowed = union(complete)
    return allowed.select("plan_id", domain.by_operator(F.col("action"), text).alias("action")).distinct()
