"""Static facts and applicable actions."""

from functools import partial

import pytest
from mini import INITIAL

from planloom.operators import applicable, enrich
from planloom.plans.domains import LOGISTICS, Action, Domain


@pytest.mark.parametrize("limit", [65_536, 10])
def test_static_facts_follow_the_initial_state(spark, monkeypatch, limit):
    monkeypatch.setattr(enrich, "long_groups", partial(enrich.long_groups, limit=limit))
    facts = [("p1", f"s{i:02d}") for i in range(25)] + [("p1", "s00"), ("p2", "t")]
    facts = spark.createDataFrame(facts, "problem_id string, fact string")
    plans = [(1, "p1", 2), (2, "p1", 0), (3, "p2", 1), (4, "p3", 1)]
    plans = spark.createDataFrame(plans, "plan_id long, problem_id string, n_initial_state long")
    initial = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (3, 0, "c"), (4, 0, "d")], "plan_id long, place long, fact string")
    got = {}
    for r in enrich.enrich_static_facts(initial, plans, facts).orderBy("plan_id", "place").collect():
        got.setdefault(r["plan_id"], []).append((r["place"], r["fact"]))
    assert all([at for at, _ in v] == list(range(len(v))) for v in got.values())
    assert got[1][:2] == [(0, "a"), (1, "b")] and sorted(f for _, f in got[1][2:]) == [f"s{i:02d}" for i in range(25)]
    assert [f for _, f in got[2]] == [f for _, f in got[1][2:]]
    assert got[3] == [(0, "c"), (1, "t")] and got[4] == [(0, "d")]


def actions_of(spark, facts, domain=LOGISTICS):
    rows = spark.createDataFrame([("p", f) for f in facts], "plan_id string, fact string")
    return applicable.applicable_actions(rows, domain)


def test_applicable_logistics_actions(spark):
    got = {r["action"] for r in actions_of(spark, INITIAL).collect()}
    drives = {f"DRIVE-TRUCK_tru1_pos1_{to}_cit1" for to in ("pos1", "pos2")}
    assert got == drives | {"LOAD-TRUCK_obj1_tru1_pos1"}
    loaded = ["attru1pos2", "inobj1tru1", "incitypos1cit1", "incitypos2cit1"]
    got = {r["action"] for r in actions_of(spark, loaded).collect()}
    assert "UNLOAD-TRUCK_obj1_tru1_pos2" in got and not any(a.startswith("LOAD") for a in got)


def test_open_parameters_stay_variables(spark):
    allowed = actions_of(spark, ["atapn1apt1", "atobj1apt1"])
    assert {r["action"] for r in allowed.collect()} == {"FLY-AIRPLANE_apn1_apt1_?airport", "LOAD-AIRPLANE_obj1_apn1_apt1"}


def test_unconnected_preconditions_are_refused(spark):
    loose = Domain("d", (Action("X", (("a", "t"), ("b", "t")), pre=(("p", "a"), ("q", "b"))),), prefixes={"o": "t"})
    try:
        actions_of(spark, ["po1", "qo2"], loose)
    except ValueError as error:
        assert "share no variable" in str(error)
    else:
        raise AssertionError("expected an error")


def test_facts_are_made_once_for_all_places(spark, tmp_path):
    """Facts of repeated, foreign and malformed tokens, against a plain match of all preconditions."""
    domain = Domain(
        "d",
        (
            Action("ONE", (("a", "t"),), pre=(("p", "a"),)),
            Action("TWO", (("a", "t"), ("b", "u")), pre=(("p", "a"), ("q", "a", "b"))),
            Action("THREE", (("a", "t"), ("b", "u"), ("c", "t")), pre=(("p", "a"), ("q", "a", "b"), ("r", "b", "c"))),
        ),
        prefixes={"o": "t", "v": "u"},
    )
    facts = [(n, f) for n in (1, 2) for f in ("po1", "po2", "qo1v1", "qo2v2", "rv1o2", "rv1o1", "qv1o1", "po1o2", "xo1", "p", "")]
    facts += [(2, "qo1v2"), (3, "qo1v1"), (1, None), (None, "po1"), (None, "qo1v1")]
    spark.createDataFrame(facts, "plan_id long, fact string").write.parquet(f"{tmp_path}/f")
    allowed = applicable.applicable_actions(spark.read.parquet(f"{tmp_path}/f"), domain)
    want = {(n, a) for n in (1, 2) for a in ("ONE_o1", "ONE_o2", "TWO_o1_v1", "TWO_o2_v2", "THREE_o1_v1_o1", "THREE_o1_v1_o2")}
    # Without a plan there is nothing to join.
    want |= {(2, "TWO_o1_v2"), (None, "ONE_o1")}
    rows = list(map(tuple, allowed.collect()))
    assert set(rows) == want and len(rows) == len(want)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        allowed.collect()
        joined = applicable.applicable_actions(spark.read.parquet(f"{tmp_path}/f"), domain)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
