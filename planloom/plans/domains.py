"""Typed action schemas, and the column expressions that ground them.

A domain is a handful of actions, so it is turned into expressions instead of a
joined table: grounding a step is then a plain projection inside codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Atom = tuple[str, ...]


@dataclass(frozen=True)
class Action:
    """One action: parameters as ``(variable, type)``, conditions as atoms over them."""

    name: str
    params: tuple[tuple[str, str], ...]
    pre: tuple[Atom, ...] = ()
    add: tuple[Atom, ...] = ()
    delete: tuple[Atom, ...] = ()

    @property
    def token(self) -> str:
        return self.name.replace("-", "").lower()

    def ground(self, atom: Atom, args: Column) -> Column:
        """The fact token of an atom; null when an argument is missing."""
        slots = [name for name, _ in self.params]
        values = [F.get(args, F.lit(slots.index(v))) for v in atom[1:]]
        return F.concat(F.lit(predicate_token(atom[0])), *values)


@dataclass(frozen=True)
class Domain:
    name: str
    actions: tuple[Action, ...]
    parents: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)  # object-name letters -> type

    def action(self, name: str) -> Action:
        return next(a for a in self.actions if a.name == name)

    def accepted_types(self, wanted: str) -> list[str]:
        """The wanted type and every type below it."""
        accepted = [wanted]
        for kind in accepted:
            accepted += [c for c, p in self.parents.items() if p == kind and c not in accepted]
        return accepted

    def by_operator(self, op: Column, make) -> Column:
        """``make(action)`` of the action a row names; null for unknown operators."""
        first, *rest = self.actions
        start = F.when(op == first.name, make(first))
        return reduce(lambda case, a: case.when(op == a.name, make(a)), rest, start)

    def is_known(self, op: Column) -> Column:
        return F.coalesce(op.isin([a.name for a in self.actions]), F.lit(False))

    def accepts(self, op: Column, slot: Column, kind: Column) -> Column:
        """Whether an object of type ``kind`` may fill a slot (0-based) of an action."""
        accepted = F.lit(False)
        for action in self.actions:
            for i, (_, wanted) in enumerate(action.params):
                here = (op == action.name) & (slot == i)
                accepted = accepted | (here & kind.isin(self.accepted_types(wanted)))
        return accepted


    def predicates(self) -> list[str]:
        atoms = {a[0] for action in self.actions for a in action.pre + action.add + action.delete}
        return sorted(predicate_token(p) for p in atoms)

    def named(self, wanted: str) -> list[str]:
        """The letters that names of objects of a type begin with."""
        return [p for p, kind in self.prefixes.items() if kind in self.accepted_types(wanted)]


def predicate_token(predicate: str) -> str:
    return predicate.replace("-", "").lower()


# The logistics domain, its type tree, the prefixes of its object names
# and its six actions.
LOGISTICS = Domain(
    name="logistics",
    parents={
        "truck": "vehicle",
        "airplane": "vehicle",
        "package": "physobj",
        "vehicle": "physobj",
        "airport": "place",
        "location": "place",
        "city": "object",
        "place": "object",
        "physobj": "object",
    },
    prefixes={
        "pos": "location",
        "tru": "truck",
        "obj": "package",
        "apn": "airplane",
        "apt": "airport",
        "cit": "city",
    },
    actions=(
        Action(
            "LOAD-TRUCK",
            (("pkg", "package"), ("truck", "truck"), ("loc", "place")),
            pre=(("at", "truck", "loc"), ("at", "pkg", "loc")),
            delete=(("at", "pkg", "loc"),),
            add=(("in", "pkg", "truck"),),
        ),
        Action(
            "LOAD-AIRPLANE",
            (("pkg", "package"), ("airplane", "airplane"), ("loc", "place")),
            pre=(("at", "pkg", "loc"), ("at", "airplane", "loc")),
            delete=(("at", "pkg", "loc"),),
            add=(("in", "pkg", "airplane"),),
        ),
        Action(
            "UNLOAD-TRUCK",
            (("pkg", "package"), ("truck", "truck"), ("loc", "place")),
            pre=(("at", "truck", "loc"), ("in", "pkg", "truck")),
            delete=(("in", "pkg", "truck"),),
            add=(("at", "pkg", "loc"),),
        ),
        Action(
            "UNLOAD-AIRPLANE",
            (("pkg", "package"), ("airplane", "airplane"), ("loc", "place")),
            pre=(("in", "pkg", "airplane"), ("at", "airplane", "loc")),
            delete=(("in", "pkg", "airplane"),),
            add=(("at", "pkg", "loc"),),
        ),
        Action(
            "DRIVE-TRUCK",
            (("truck", "truck"), ("from", "place"), ("to", "place"), ("city", "city")),
            pre=(("at", "truck", "from"), ("in-city", "from", "city"), ("in-city", "to", "city")),
            delete=(("at", "truck", "from"),),
            add=(("at", "truck", "to"),),
        ),
        Action(
            "FLY-AIRPLANE",
            (("airplane", "airplane"), ("from", "airport"), ("to", "airport")),
            pre=(("at", "airplane", "from"),),
            delete=(("at", "airplane", "from"),),
            add=(("at", "airplane", "to"),),
        ),
    ),
)

LOGISTICS_OBJECTS = tuple(LOGISTICS.prefixes)

_SHIPPING_PREFIXES = {"part": "part", "supp": "supplier", "cust": "customer"}

SHIPPING = Domain(
    name="shipping",
    prefixes=_SHIPPING_PREFIXES,
    actions=(
        Action(
            "SHIP-PART",
            (("p", "part"), ("s", "supplier"), ("c", "customer")),
            pre=(("at", "p", "s"),),
            delete=(("at", "p", "s"),),
            add=(("at", "p", "c"),),
        ),
        Action(
            "RETURN-PART",
            (("p", "part"), ("c", "customer"), ("s", "supplier")),
            pre=(("at", "p", "c"),),
            delete=(("at", "p", "c"),),
            add=(("at", "p", "s"),),
        ),
    ),
)

SHIPPING_OBJECTS = tuple(_SHIPPING_PREFIXES)

# The shipping actions with static preconditions that bind every parameter.
SHIPPING_BOUND = Domain(
    name="shipping-bound",
    prefixes=_SHIPPING_PREFIXES,
    actions=(
        Action(
            "SHIP-PART",
            (("p", "part"), ("s", "supplier"), ("c", "customer")),
            pre=(("at", "p", "s"), ("wants", "c", "p")),
        ),
        Action(
            "RETURN-PART",
            (("p", "part"), ("c", "customer"), ("s", "supplier")),
            pre=(("at", "p", "c"), ("supplies", "s", "p")),
        ),
    ),
)

FUNNEL = Domain(
    name="funnel",
    actions=(
        Action("SIGNUP", (("u", "user"),), add=(("registered", "u"),)),
        Action("VIEW", (("u", "user"),), pre=(("registered", "u"),), add=(("viewing", "u"),)),
        Action(
            "CLICK",
            (("u", "user"),),
            pre=(("viewing", "u"),),
            delete=(("viewing", "u"),),
            add=(("clicked", "u"),),
        ),
        Action(
            "PURCHASE",
            (("u", "user"),),
            pre=(("clicked", "u"),),
            delete=(("clicked", "u"),),
            add=(("bought", "u"),),
        ),
        Action("ERROR", (("u", "user"),), delete=(("viewing", "u"), ("clicked", "u"))),
    ),
)
