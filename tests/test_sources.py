"""Readers and writers on files, parsers on hand-written texts."""

import hashlib
import json
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from planloom.catalog import QUERIES
from planloom.operators import replay
from planloom.operators.records import normalize_raw, plan_records
from planloom.plans import sample_texts
from planloom.schemas import GENERATED_PLAN, PLAN_RAW, PLAN_RECORD
from planloom.sources import readers, texts, writers
from planloom.sources.lines import read_lines, text_lines

PROBLEM = """(define (problem small)
(:domain logistics)
(:objects
\tapn4 apn5 - airplane
\tcit5 - city
\tobj23 obj44 - package
)
(:init
\t(at apn4 apt4) (at obj23 pos12)
\t(in-city apt4 cit5)
\t(at obj44 pos12)
)
(:goal
\t(and
\t\t(at obj23 apt4)
\t\t(in obj44 apn4)
))
)
"""

LOG = """; Time 0.01
;;(:metadata <State><F>(at obj1 pos1)</F><F>(at tru1 pos1)</F></State>) . ;;(:metadata <Action><Name>(LOAD-TRUCK OBJ1 TRU1 POS1)</Name><Id>1</Id><Parent>0</Parent><Student>a&amp;b</Student><FFheuristic>3<FFheuristic><Predecessors></Predecessors><Preconds><F>(at obj1 pos1)</F><F>(at tru1 pos1)</F></Preconds><PositiveEffects><F>(in obj1 tru1)</F></PositiveEffects><NegativeEffects><F>(at obj1 pos1)</F></NegativeEffects></Action>)
0: (LOAD-TRUCK OBJ1 TRU1 POS1) [1]
;;(:metadata <Action><Predecessors><P><Id>1</Id></P></Predecessors><Name>(DRIVE-TRUCK TRU1 POS1 POS2 CIT1)</Name><Id>2</Id><Parent>1</Parent><Student>s</Student><FFheuristic>2<FFheuristic><Preconds></Preconds><PositiveEffects><F>(at tru1 pos2)</F></PositiveEffects><NegativeEffects></NegativeEffects></Action>)
;;(:metadata <Goals><F>(at obj1 pos2)</F></Goals>)
"""


def record(name, split_words=("f1 f2", "g1", "A1")):
    initial, goals, actions = split_words
    return dict(
        name=name, pddl_problem_file="p.pddl", initial_state=initial, goals=goals, actions=actions,
        len_initial_state=2, len_goals=1, len_plan=1, actions_idx=5, eop_idx=7,
    )


def test_json_arrays_and_splits(spark, tmp_path):
    for split, n in (("train", 3), ("test", 2)):
        path = tmp_path / f"logistics_plans_{split}_0.json"
        path.write_text(json.dumps([record(f"{split}{i}") for i in range(n)], indent=2))
    records = readers.read_records(spark, str(tmp_path))
    assert records.count() == 5 and records.schema == PLAN_RECORD
    assert records.filter("len_goals = 1 and eop_idx = 7").count() == 5
    counts = readers.read_splits(spark, str(tmp_path)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {"train": 3, "test": 2}


def test_written_splits_have_bounded_files(spark, tmp_path):
    rows = [(f"n{i}", "test" if i % 5 == 0 else "train") for i in range(50)]
    df = spark.createDataFrame(rows, "name string, split string").coalesce(1)
    writers.write_splits(df, str(tmp_path / "out"), plans_per_file=10)
    files = list((tmp_path / "out" / "split=train").glob("*.json"))
    assert [len(f.read_text().splitlines()) for f in files] == [10] * 4
    back = readers.read_records(spark, str(tmp_path / "out" / "split=test"), lines=True)
    assert back.count() == 10


@pytest.mark.parametrize("parts", [1, 5])
def test_shuffled_files_are_the_seeded_shuffle(spark, tmp_path, parts):
    names = spark.range(103).select(F.concat(F.lit("n"), "id").alias("name"), "id").repartition(parts)
    writers.write_shuffled(names, F.col("name"), str(tmp_path / "out"), plans_per_file=10, seed=3)
    files = sorted((tmp_path / "out").glob("part-*.json"))
    assert [len(f.read_text().splitlines()) for f in files] == [10] * 10 + [3]
    written = [json.loads(line)["name"] for f in files for line in f.read_text().splitlines()]
    assert written == sorted((f"n{n}" for n in range(103)), key=lambda n: hashlib.md5(f"3|{n}".encode()).hexdigest())
    writers.write_shuffled(names.limit(0), F.col("name"), str(tmp_path / "none"))
    assert spark.read.schema(names.schema).json(str(tmp_path / "none")).count() == 0


def test_generated_batches(spark, tmp_path):
    plan = dict(input="i", plan="A1", actions_seen=2, problem_id="p", example_id="e")
    folder = tmp_path / "2_actions"
    folder.mkdir()
    (folder / "to_validate_0_1.json").write_text(json.dumps([plan, plan]))
    (folder / "to_validate_2_2.json").write_text(json.dumps([plan]))
    (folder / "output_0_1.json").write_text("[]")
    (tmp_path / "other").mkdir()
    assert readers.read_generated(spark, str(tmp_path)).count() == 3

    made = spark.createDataFrame([("i", "A", 0, "p", "e"), ("i", "A B", 1, "p", "e")], GENERATED_PLAN)
    writers.write_generated(made, str(tmp_path / "made"))
    back = readers.read_generated(spark, str(tmp_path / "made"), prefix="part-", lines=True)
    assert sorted(back.select("actions_seen").collect()) == [(0,), (1,)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "plan string, step long")
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    nested = rows.select("plan", F.array(F.struct("step")).alias("steps"))
    writers.write_json(nested, str(tmp_path / "json"))
    assert spark.read.schema(nested.schema).json(str(tmp_path / "json")).count() == 2


def test_problem_files(spark, tmp_path):
    (tmp_path / "p1.pddl").write_text(PROBLEM)
    row = readers.read_problems(spark, str(tmp_path)).collect()[0]
    assert row["name"] == "p1.pddl"
    assert (row["len_initial_state"], row["len_goals"], row["len_plan"]) == (3, 1, 0)
    assert (row["actions_idx"], row["eop_idx"]) == (6, -1)

    lines = read_lines(spark, str(tmp_path))
    found = texts.prefixed_lines(lines, "(in-city").collect()
    assert [r["fact"] for r in found] == ["in-city apt4 cit5"]
    sections = texts.problem_sections(lines)
    objects = {(r["object"], r["type"]) for r in texts.problem_objects(sections).collect()}
    assert objects == {("apn4", "airplane"), ("apn5", "airplane"), ("cit5", "city"), ("obj23", "package"), ("obj44", "package")}
    facts = {(r["section"], r["place"]): r["fact"] for r in texts.problem_facts(sections, ["at"]).collect()}
    assert facts == {("init", 0): "atapn4apt4", ("init", 1): "atobj23pos12", ("init", 2): "atobj44pos12", ("goal", 0): "atobj23apt4"}
    facts = texts.problem_facts(sections)
    assert facts.filter("section = 'init'").count() == 4 and facts.filter("section = 'goal'").count() == 2


def test_objects_take_the_next_type(spark):
    text = "(define\n(:objects a1 b2\n  c3 - kind\n d4 - other e5\n\tf6\n) (:init (at a1 b2)) (:goal (and (at c3 d4)\n(at a1 d4)))"
    sections = texts.problem_sections(text_lines(spark.createDataFrame([("p", text)], "name string, text string")))
    objects = {r["object"]: r["type"] for r in texts.problem_objects(sections).collect()}
    assert objects == {"a1": "kind", "b2": "kind", "c3": "kind", "d4": "other", "e5": None, "f6": None}
    facts = {(r["section"], r["place"]): r["fact"] for r in texts.problem_facts(sections).collect()}
    assert facts == {("init", 0): "at a1 b2", ("goal", 0): "at c3 d4", ("goal", 1): "at a1 d4"}


def test_plan_logs(spark, tmp_path):
    (tmp_path / "xml-GEN-p1_2.SOL").write_text(LOG)
    raw = readers.read_plan_logs(spark, str(tmp_path))
    assert raw.schema.simpleString() == PLAN_RAW.simpleString()
    row = raw.collect()[0]
    assert row["initial_state"] == ["at obj1 pos1", "at tru1 pos1"] and row["goals"] == ["at obj1 pos2"]
    first, second = row["actions"]
    assert (first["name"], first["id"], first["parent"], first["student"]) == ("LOAD-TRUCK OBJ1 TRU1 POS1", "1", "0", "a&b")
    assert first["precondition"] == ["at obj1 pos1", "at tru1 pos1"] and first["predecessor"] == []
    assert (second["id"], second["predecessor"], second["negative_effects"]) == ("2", ["1"], [])
    flat = plan_records(normalize_raw(raw)).collect()[0]
    assert flat["actions"] == "LOADTRUCKOBJ1TRU1POS1 DRIVETRUCKTRU1POS1POS2CIT1"
    assert (flat["pddl_problem_file"], flat["len_plan"], flat["actions_idx"], flat["eop_idx"]) == ("p1.pddl", 2, 5, 8)


def test_log_without_metadata_is_left_out(spark):
    df = spark.createDataFrame([("a", "nothing\nhere")], "name string, text string")
    assert texts.log_rows(text_lines(df)).count() == 0


def small_splits(spark, size):
    """Settings under which files are read in splits of ``size`` bytes."""
    return {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@contextmanager
def settings(spark, changed):
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def long_log(actions):
    head, *_, goals = LOG.strip().split("\n")[1:]
    step = ";;(:metadata <Action><Name>(MOVE A{0})</Name><Id>{0}</Id><Parent>0</Parent><Student>s</Student><FFheuristic>2<FFheuristic><Predecessors></Predecessors><Preconds><F>(at a{1})</F></Preconds><PositiveEffects><F>(at a{0})</F></PositiveEffects><NegativeEffects><F>(at a{1})</F></NegativeEffects></Action>)"
    lines = [head] + [line for n in range(2, actions + 1) for line in (f"{n}: (MOVE)", step.format(n, n - 1))]
    return "\n".join([*lines, goals]) + "\n"


def test_a_long_log_parses_alike_in_many_blocks(spark, tmp_path):
    (tmp_path / "long.SOL").write_text(long_log(20_000))
    (tmp_path / "short.SOL").write_text(LOG)
    whole = readers.read_log_rows(spark, str(tmp_path)).select("plan_name", "step", F.to_json("action").alias("a"), "initial", "goals")
    want = sorted(map(tuple, whole.collect()), key=repr)
    assert len(want) == 20_000 + 1 + 3
    with settings(spark, small_splits(spark, 100_000)):
        lines = read_lines(spark, str(tmp_path))
        assert lines.blocked and lines.rows.select("block").distinct().count() > 50
        cut = texts.log_rows(lines).select("plan_name", "step", F.to_json("action").alias("a"), "initial", "goals")
        assert sorted(map(tuple, cut.collect()), key=repr) == want
        held = replay.replay_logs(texts.log_rows(lines), 500)
        facts = {(r["plan_id"], r["step"], r["fact"]): r["holds"] for r in held.collect()}
    plain = replay.replay_logs(texts.log_rows(read_lines(spark, str(tmp_path))), 10**9)
    assert facts == {(r["plan_id"], r["step"], r["fact"]): r["holds"] for r in plain.collect()}
    # a1 is nowhere before step 2; each later step stands where the last one went.
    assert facts["long.SOL", 2, "at a1"] is False and all(facts["long.SOL", n, f"at a{n - 1}"] for n in range(3, 20_001))


def test_a_long_problem_file_parses_alike_in_many_blocks(spark, tmp_path):
    body = "\n".join(f"\t(at obj{n} pos{n % 7})" for n in range(3000))
    objects = "\n".join(f"\tobj{n}" + (" - package" if n % 10 == 9 else "") for n in range(3000))
    (tmp_path / "long.pddl").write_text(f"(define (problem x)\n(:objects\n{objects}\n)\n(:init\n{body}\n)\n(:goal\n(and\n{body}\n))\n)\n")

    def parsed():
        lines = read_lines(spark, str(tmp_path))
        sections = texts.problem_sections(lines)
        return lines.blocked, [sorted(map(tuple, f.collect())) for f in (texts.problem_facts(sections), texts.problem_objects(sections), texts.parse_problems(sections))]

    blocked, want = parsed()
    assert not blocked and len(want[0]) == 6000 and {r[2] for r in want[1]} == {"package"}
    with settings(spark, small_splits(spark, 10_000)):
        blocked, got = parsed()
    assert blocked and got == want


def test_a_file_is_brought_together_before_it_is_lines(spark):
    blocks = spark.createDataFrame([(f"f{i}", 0, ["(:init", f"(at x{i})", ")"]) for i in range(5)], "name string, block long, lines array<string>")
    lines = sample_texts.as_lines(blocks, F.col("name"), F.col("lines"), False)
    plan = texts.problem_facts(texts.problem_sections(lines))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(name") == 1
    assert plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning(name")


def test_records_of_problem_files_hold_their_texts(spark, tmp_path):
    lines = text_lines(spark.createDataFrame([("d/p1.pddl", PROBLEM), ("d/p2.pddl", "")], "name string, text string"))
    records = texts.problem_records(texts.problem_sections(lines))
    rows = {r["name"]: r for r in records.collect()}
    found = rows["p1.pddl"]
    assert (found["initial_state"], found["goals"], found["actions"]) == ("atapn4apt4 atobj23pos12 atobj44pos12", "atobj23apt4", "")
    assert (found["len_initial_state"], found["len_goals"], found["actions_idx"], found["piece"]) == (3, 1, 6, 0)
    assert (rows["p2.pddl"]["initial_state"], rows["p2.pddl"]["goals"], rows["p2.pddl"]["len_goals"]) == ("", "", 0)


def test_records_of_a_long_problem_file_have_rows_of_bounded_texts(spark, tmp_path):
    body = "\n".join(f"\t(at obj{n} pos{n % 7})" for n in range(3000))
    (tmp_path / "long.pddl").write_text(f"(define (problem x)\n(:init\n{body}\n)\n(:goal\n(and\n{body}\n))\n)\n")
    with settings(spark, small_splits(spark, 10_000)):
        lines = read_lines(spark, str(tmp_path))
        rows = texts.problem_records(texts.problem_sections(lines), facts_per_row=700).orderBy("piece").collect()
    facts = [f"atobj{n}pos{n % 7}" for n in range(3000)]
    assert lines.blocked and [len(r["goals"].split(" ")) for r in rows] == [700] * 4 + [200] and {(r["len_initial_state"], r["len_goals"]) for r in rows} == {(3000, 3000)}
    for c in ("initial_state", "goals"):
        assert " ".join(r[c] for r in rows).split(" ") == facts


@pytest.mark.parametrize("name", ["problem_parse", "static_fact_extract"])
def test_orders_and_their_lines_have_problem_files(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).select("name").collect()
    parts = [len(r["name"].split("_")) for r in rows]
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    empty = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_anti").count()
    assert parts.count(2) == orders.count() and parts.count(3) == lines.count() + empty
