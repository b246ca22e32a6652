"""Dictionaries and encoded sequences move their tokens once to each other, whatever the tokens are."""

import random
import re

import pytest
from pyspark.sql import functions as F

from planloom.catalog import QUERIES
from planloom.operators import vocab
from planloom.plans.orders import OrderPlans
from planloom.schemas import SPECIAL_TOKENS

@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


SCHEMA = "plan_id long, section int, pos long, position long, token string"


def token_rows(seed):
    """Places that several tokens share, tokens that occur often, special ones and missing ones."""
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(60)] + [f"T{i}" for i in range(9)] + ["A-1", "a1", "x-y", SPECIAL_TOKENS[2], None]
    return [
        (plan * plan - 40, section, rng.randint(1, 6), at, rng.choice(words))
        for plan in range(30) for at, section in enumerate(rng.choices(range(3), k=9))
    ]


def ids(rows):
    """Numbers in first-seen order; a missing token comes before others at its place."""
    found = {}
    for _, _, _, _, token in sorted(((p, s, at, t is not None, t or "") for p, s, at, _, t in rows)):
        found.setdefault(token or None, len(found) + 1)
    return found


@pytest.mark.parametrize("block,ranges", [(65_536, 256), (2, 5)])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_own_tokens_get_the_ids_of_the_dictionary(spark, monkeypatch, seed, block, ranges):
    monkeypatch.setattr(vocab, "_BLOCK", block)
    monkeypatch.setattr(vocab, "_RANGES", ranges)
    rows = token_rows(seed)
    tokens = spark.createDataFrame(rows, SCHEMA).repartition(5)
    numbers = ids(rows)
    dictionary = vocab.token_dictionary(tokens, tokens.select("plan_id"))
    assert {r["token"]: r["token_id"] for r in dictionary.collect()} == numbers
    special = {t: i for i, t in enumerate(SPECIAL_TOKENS)}
    expected = sorted((p, at, special.get(t, numbers[t] + len(SPECIAL_TOKENS) - 1)) for p, _, _, at, t in rows if t is not None)
    found = vocab.encode_own(tokens, tokens.select("plan_id")).select("plan_id", "position", "token_id")
    assert sorted(map(tuple, found.collect())) == expected
    joined = vocab.encode(tokens.select("plan_id", "position", "token"), dictionary).select("plan_id", "position", "token_id")
    assert sorted(map(tuple, joined.collect())) == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_forms_have_the_ids_of_their_tokens(spark, seed):
    rows = token_rows(seed)
    tokens = spark.createDataFrame(rows, SCHEMA).repartition(5)
    numbers = ids(rows)
    form = F.when(~F.startswith("token", F.lit("t5")), F.translate(F.lower("token"), "-", ""))
    forms = {t: t.lower().replace("-", "") for t in numbers if t is not None and not t.startswith("t5")}
    found = vocab.form_ids(tokens, tokens.select("plan_id"), form).collect()
    assert sorted(map(tuple, found)) == sorted((t, f, numbers.get(f, 0)) for t, f in forms.items())
    assert any(r["form_id"] == 0 for r in found) and any(r["form"] != r["token"] and r["form_id"] for r in found)


@pytest.mark.parametrize("name,moves", [("token_dictionary", 7), ("encode_actions", 8), ("sequence_encode", 11)])
def test_texts_are_not_brought_back_to_their_tokens(name, moves, spark, sf_dir, no_broadcast):
    found = QUERIES[name](spark, sf_dir)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    # One exchange brings a token to its equals; in the dictionary another brings it to its place.
    assert len([line for line in made if "hashpartitioning(token#" in line]) == 1
    assert len(made) <= moves, made


def test_a_hot_part_takes_the_joins(spark, sf_dir, monkeypatch):
    rows = sorted(map(tuple, QUERIES["sequence_encode"](spark, sf_dir).collect()))
    monkeypatch.setattr(OrderPlans, "has_hot_parts", lambda self: True)
    assert sorted(map(tuple, QUERIES["sequence_encode"](spark, sf_dir).collect())) == rows
