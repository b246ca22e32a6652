"""Text of facts, actions and plan names, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from planloom.plans.domains import Domain
from planloom.schemas import END

# The shape of an object name inside an action token, and the letters it begins with.
OBJECT_NAME = r"([a-z]+\d+)"
OBJECT_LETTERS = r"([a-z]+)\d+"


def normalize(text: Column) -> Column:
    """A fact or action as one token: blanks and dashes removed."""
    return F.translate(text, " -", "")


def problem_id(plan_name: Column) -> Column:
    """Between the last ``-`` and the next ``_`` of a plan name."""
    return F.substring_index(F.substring_index(plan_name, "-", -1), "_", 1)


def example_id(plan_name: Column) -> Column:
    """Between the last ``-`` and the next ``.`` of a plan name."""
    return F.substring_index(F.substring_index(plan_name, "-", -1), ".", 1)


def words(text: Column) -> Column:
    """The non-empty blank-separated words of a text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _operator_pattern(domain: Domain) -> str:
    longest_first = sorted((a.token for a in domain.actions), key=len, reverse=True)
    return "^(" + "|".join(longest_first) + ")"


def action_operator(token: Column, domain: Domain) -> Column:
    """The operator a lower-case action token starts with; null if there is none."""
    found = F.regexp_extract(token, _operator_pattern(domain), 1)
    names = [part for a in domain.actions for part in (F.lit(a.token), F.lit(a.name))]
    return F.try_element_at(F.create_map(*names), found)


def action_objects(token: Column, domain: Domain) -> Column:
    """The object names that follow the operator of a lower-case action token."""
    objects = F.regexp_replace(token, _operator_pattern(domain), "")
    return F.regexp_extract_all(objects, F.lit(OBJECT_NAME), F.lit(1))


def decode_action(token: Column, domain: Domain) -> Column:
    """``drivetrucktru2…`` as ``DRIVE-TRUCK_tru2_…``; null for an unknown operator."""
    token = F.lower(token)
    operator = action_operator(token, domain)
    decoded = F.concat(
        operator,
        F.lit("_"),
        F.array_join(action_objects(token, domain), "_"),
    )
    return F.when(token == END, token).otherwise(decoded)


def encode_action(decoded: Column) -> Column:
    """The inverse of :func:`decode_action`, in lower case."""
    return F.translate(F.lower(decoded), "-_", "")


def bracket_action(token: Column, domain: Domain) -> Column:
    """An action token as ``(OPERATOR OBJECT …)``; an unknown one stays a single word."""
    low = F.lower(token)
    operator = action_operator(low, domain)
    line = F.concat_ws(" ", operator, F.upper(F.array_join(action_objects(low, domain), " ")))
    return F.concat(F.lit("("), F.when(operator.isNull(), F.upper(token)).otherwise(line), F.lit(")"))


def bracket_plan(plan: Column, domain: Domain) -> Column:
    """A plan text as one bracketed line per action."""
    lines = F.transform(words(plan), lambda t: F.concat(bracket_action(t, domain), F.lit("\n")))
    return F.array_join(lines, "")


def beautify_facts(text: Column, objects: Iterable[str]) -> Column:
    """Put ``_`` before every object name of a fact or a fact list."""
    return F.regexp_replace(text, "(" + "|".join(objects) + ")", "_$1")


def split_state_goals(text: Column) -> tuple[Column, Column]:
    """The initial facts and the goals of a combined state text."""
    parts = F.split(text, r" *<\|goals\|> *", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def replace_nth(text: Column, sub: str, new: str, nth: int) -> Column:
    """Replace the ``nth`` occurrence of ``sub``; unchanged if there are fewer."""
    head = F.substring_index(text, sub, nth)
    tail = F.substr(text, F.length(head) + len(sub) + 1)
    return F.when(F.length(head) < F.length(text), F.concat(head, F.lit(new), tail)).otherwise(text)


def clean_words(text: Column) -> Column:
    """Lower-case words of a text; white space separates, control characters vanish."""
    spaced = F.regexp_replace(F.lower(text), r"[\t\n\r]", " ")
    return words(F.regexp_replace(spaced, r"[\x00-\x1F\x7F]", ""))
