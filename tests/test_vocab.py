"""Dictionaries, vocabularies and records against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planloom.operators import records, vocab
from planloom.plans.corpus import Corpus
from planloom.schemas import ACTIONS, END, GOALS, SPECIAL_TOKENS, START


def token_rows(n_plans=40, seed=4):
    rng = random.Random(seed)
    for plan in range(n_plans):
        length = 300 if plan == 7 else rng.randint(1, 12)
        for section in range(3):
            for pos in range(1, length + 1):
                yield plan * plan, section, pos, f"t{rng.randrange(600)}"


@pytest.mark.parametrize("block,ranges", [(65_536, 256), (16, 5), (1, 2)])
def test_dictionary_in_first_seen_order(spark, monkeypatch, block, ranges):
    monkeypatch.setattr(vocab, "_BLOCK", block)
    monkeypatch.setattr(vocab, "_RANGES", ranges)
    rows = list(token_rows())
    expected = {}
    for _, _, _, token in sorted(rows):
        expected.setdefault(token, len(expected) + 1)
    tokens = spark.createDataFrame(rows, "plan_id long, section int, pos long, token string").repartition(7)
    got = vocab.token_dictionary(tokens, tokens.select("plan_id")).collect()
    assert {r["token"]: r["token_id"] for r in got} == expected


@pytest.mark.parametrize("n_bounds", [0, 1, 4, 7, 8, 255])
def test_ranges_by_halving(spark, n_bounds):
    bounds = sorted(random.Random(n_bounds).sample(range(-500, 500), n_bounds))
    values = [None, *bounds, *range(-510, 510, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "plan_id long")
    got = rows.select("plan_id", vocab._range_of(F.col("plan_id"), bounds).alias("range")).collect()
    assert [r["range"] for r in got] == [0 if v is None else sum(b <= v for b in bounds) for v in values]


def test_vocabulary_is_capped(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.expovariate(0.1))}" for _ in range(2000)] + ["<|pad|>"]
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    rows = vocab.build_vocabulary(tokens, size=20).orderBy("token_id").collect()
    assert [r["token"] for r in rows[:7]] == SPECIAL_TOKENS
    ranked = sorted(Counter(words[:-1]).items(), key=lambda kv: (-kv[1], kv[0]))[:13]
    assert [(r["token"], r["frequency"]) for r in rows[7:]] == ranked
    assert [r["token_id"] for r in rows] == list(range(20))


def test_encode_and_unknown(spark):
    dictionary = spark.createDataFrame([("a", 1), ("b", 2)], "token string, token_id long")
    rows = [(1, 0, "<|startofplan|>"), (1, 1, "a"), (1, 2, "zz"), (2, 0, "b"), (2, 1, "<|pad|>")]
    tokens = spark.createDataFrame(rows, "plan_id int, position int, token string")
    got = {(r["plan_id"], r["position"]): r["token_id"] for r in vocab.encode(tokens, dictionary).collect()}
    assert got == {(1, 0): 2, (1, 1): 7, (1, 2): 0, (2, 0): 8, (2, 1): 1}


@pytest.mark.parametrize("is_long", [False, True])
def test_tokens_have_the_places_of_the_whole_plan(spark, is_long):
    rows = [("p", i, [f"f{i}"] * (i % 3), [f"g{i}"], [("OP-A", [f"x{i}"])]) for i in range(1, 26)]
    schema = "plan_id string, seq long, initial array<string>, goals array<string>, steps array<struct<op:string,args:array<string>>>"
    chunks = spark.createDataFrame(rows, schema).repartition(5)
    corpus = Corpus(chunks.limit(0), chunks, block_steps=4) if is_long else Corpus(chunks)
    sizes = spark.createDataFrame([("p", 25, 25, 25), ("q", 0, 0, 0)], "plan_id string, n_initial_state long, n_goals long, n_actions long")
    placed = records.placed_tokens(corpus)
    facts = [f"f{i}" for i in range(1, 26) for _ in range(i % 3)]
    goals, actions = [f"g{i}" for i in range(1, 26)], [f"OPAX{i}" for i in range(1, 26)]
    by_section = {(r["section"], r["place"]): r["token"] for r in placed.collect()}
    assert [by_section["initial_state", k] for k in range(25)] == facts

    def texts(frame):
        out = {}
        for r in frame.orderBy("position").collect():
            out.setdefault(r["plan_id"], []).append((r["position"], r["token"]))
        assert all([at for at, _ in v] == list(range(len(v))) for v in out.values())
        return {k: [t for _, t in v] for k, v in out.items()}

    got = texts(records.sequence_tokens(placed, sizes))
    assert got["p"] == [START, *facts, GOALS, *goals, ACTIONS, *actions, END]
    assert got["q"] == [START, GOALS, ACTIONS, END]
    got = texts(records.prompt_tokens(placed, sizes, F.lit(2)))
    assert got == {"p": [*facts, GOALS, *goals, ACTIONS, *actions[:2]], "q": [GOALS, ACTIONS]}


def test_flat_records_of_rows(spark):
    schema = "name string, initial array<string>, goals array<string>, actions array<string>"
    nested = spark.createDataFrame([("xml-GEN-p1_2.SOL", ["f"] * 25, ["g"] * 25, ["A"] * 25)], schema)
    flat = records.plan_records(nested).collect()[0]
    assert (flat["pddl_problem_file"], flat["actions_idx"], flat["eop_idx"]) == ("p1.pddl", 52, 78)
