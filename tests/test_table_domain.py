"""Domains read from texts against the same domain in code, and domains that have no code."""

import pytest
from mini import GOALS, INITIAL, OBJECTS, SCHEMA, chunk_rows, mutants

from planloom.operators import table_domain, validate
from planloom.plans.corpus import from_chunks
from planloom.plans.domains import LOGISTICS
from planloom.sources.domain_texts import ancestors, parse_domains, read_domains

LOGISTICS_TEXT = """
; a typed domain
(define (domain moves)
  (:requirements :strips :typing)
  (:types truck airplane - vehicle
          package vehicle - physobj
          airport location - place
          city place physobj - object)
  (:predicates (in-city ?l - place ?c - city) (at ?o - physobj ?l - place) (in ?p - package ?v - vehicle))
  (:action LOAD-TRUCK :parameters (?p - package ?t - truck ?l - place)
    :precondition (and (at ?t ?l) (at ?p ?l)) :effect (and (not (at ?p ?l)) (in ?p ?t)))
  (:action UNLOAD-TRUCK :parameters (?p - package ?t - truck ?l - place)
    :precondition (and (at ?t ?l) (in ?p ?t)) :effect (and (not (in ?p ?t)) (at ?p ?l)))
  (:action DRIVE-TRUCK :parameters (?t - truck ?a ?b - place ?c - city)
    :precondition (and (at ?t ?a) (in-city ?a ?c) (in-city ?b ?c)) :effect (and (not (at ?t ?a)) (at ?t ?b)))
  (:action LOAD-AIRPLANE :parameters (?p - package ?v - airplane ?l - place)
    :precondition (and (at ?p ?l) (at ?v ?l)) :effect (and (not (at ?p ?l)) (in ?p ?v)))
  (:action UNLOAD-AIRPLANE :parameters (?p - package ?v - airplane ?l - place)
    :precondition (and (in ?p ?v) (at ?v ?l)) :effect (and (not (in ?p ?v)) (at ?p ?l)))
  (:action FLY-AIRPLANE :parameters (?v - airplane ?a - airport ?b - airport)
    :precondition (at ?v ?a) :effect (and (not (at ?v ?a)) (at ?v ?b))))
"""

CRANES_TEXT = """
(define (domain cranes)
  (:types yard - spot
          crate pallet - surface
          spot surface crane)
  (:constants home - yard)
  (:action LIFT :parameters (?h - crane ?c - crate ?s - surface ?y - spot)
    :precondition (and (near ?h ?y) (free ?h) (on ?c ?s) (clear ?c))
    :effect (and (not (on ?c ?s)) (not (clear ?c)) (not (free ?h)) (holds ?h ?c) (clear ?s)))
  (:action DROP :parameters (?h - crane ?c - crate ?s - surface ?y - spot)
    :precondition (and (near ?h ?y) (holds ?h ?c) (clear ?s))
    :effect (and (free ?h) (not (holds ?h ?c)) (clear ?c) (not (clear ?s)) (on ?c ?s)))
  (:action GO-HOME :parameters (?h - crane ?y - yard) :precondition (near ?h ?y) :effect (and (not (near ?h ?y)) (near ?h home)))
  (:action WAIT :parameters () :effect ()))
"""


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, text string")


def listed(spark, objects=OBJECTS):
    return spark.createDataFrame(list(objects.items()), "name string, type string")


@pytest.mark.parametrize("block", [65_536, 2])
def test_a_domain_text_gives_the_classes_of_the_domain_in_code(spark, block):
    rows = chunk_rows() + [(n, 1, i, g, s) for n, i, g, s in mutants(120)]
    corpus = from_chunks(spark.createDataFrame(rows, SCHEMA), block)
    domain = table_domain.TableDomain(parse_domains(texts(spark, ("x", LOGISTICS_TEXT), ("y", CRANES_TEXT))).only("x"))
    objects = listed(spark, OBJECTS | {"pos3": "location", "obj2": "package"})
    want = {tuple(r) for r in validate.classify(corpus, LOGISTICS, objects).collect()}
    assert {tuple(r) for r in table_domain.classify(corpus, domain, objects).collect()} == want
    assert len({w[1] for w in want}) == 6


def test_tables_that_are_too_large_are_joined(spark, monkeypatch):
    monkeypatch.setattr(table_domain, "SENT_ROWS", 0)
    corpus = from_chunks(spark.createDataFrame(chunk_rows(), SCHEMA))
    domain = table_domain.TableDomain(parse_domains(texts(spark, ("x", LOGISTICS_TEXT))).only("x"))
    want = {tuple(r) for r in validate.classify(corpus, LOGISTICS, listed(spark)).collect()}
    assert {tuple(r) for r in table_domain.classify(corpus, domain, listed(spark)).collect()} == want


def test_objects_of_another_problem_are_unknown(spark):
    rows = [(p, 1, INITIAL, GOALS, chunk_rows()[0][4], q) for p, q in (("a", "here"), ("b", "there"))]
    corpus = from_chunks(spark.createDataFrame(rows, SCHEMA + ", problem_id string"))
    own = [("here", n, t) for n, t in OBJECTS.items()] + [("there", n, t) for n, t in OBJECTS.items() if n != "tru1"]
    objects = spark.createDataFrame(own, "problem_id string, name string, type string")
    domain = table_domain.TableDomain(parse_domains(texts(spark, ("x", LOGISTICS_TEXT))).only("x"))
    found = {r["plan_id"]: r["class"] for r in table_domain.classify(corpus, domain, objects).collect()}
    assert found == {"a": "valid", "b": "unknown_type_error"}


def test_a_domain_without_code(spark, tmp_path):
    (tmp_path / "cranes.pddl").write_text(CRANES_TEXT)
    tables = read_domains(spark, str(tmp_path)).only("cranes.pddl")
    params = {(r["op"], r["slot"]): r["type"] for r in tables.params.collect()}
    assert params["LIFT", 3] == "spot" and params["WAIT", -1] is None and ("WAIT", 0) not in params
    conds = {(r["op"], r["kind"], r["predicate"], tuple(tuple(a) for a in r["args"])) for r in tables.conds.collect()}
    assert ("LIFT", "delete", "clear", ((1, None),)) in conds and ("LIFT", "add", "clear", ((2, None),)) in conds
    assert ("GO-HOME", "add", "near", ((0, None), (-1, "home"))) in conds and len(conds) == 20

    initial = ["nearh1y1", "freeh1", "onc1p1", "clearc1", "clearp2", "onc2p3", "clearc2"]
    objects = {"h1": "crane", "c1": "crate", "c2": "crate", "p1": "pallet", "p2": "pallet", "p3": "pallet", "y1": "yard", "home": "yard"}
    lift, drop = ("LIFT", ["h1", "c1", "p1", "y1"]), ("DROP", ["h1", "c1", "p2", "y1"])
    plans = {
        "good": ([lift, drop], "valid"),
        "onto": ([lift, ("DROP", ["h1", "c1", "c2", "y1"])], "unsatisfied_goal_error"),
        "twice": ([lift, lift], "precondition_error"),
        "home": ([("WAIT", []), lift, drop, ("GO-HOME", ["h1", "y1"])], "valid"),
        "away": ([lift, ("GO-HOME", ["h1", "y1"]), drop], "precondition_error"),
        "wrong": ([("LIFT", ["h1", "p2", "p1", "y1"])], "type_checking_error"),
    }
    rows = [(n, 1, initial, ["onc1p2"], s) for n, (s, _) in plans.items()]
    corpus = from_chunks(spark.createDataFrame(rows, SCHEMA))
    found = table_domain.classify(corpus, table_domain.TableDomain(tables), listed(spark, objects))
    assert {r["plan_id"]: r["class"] for r in found.collect()} == {n: c for n, (_, c) in plans.items()}


def test_ancestors_of_three_levels_and_of_a_cycle(spark):
    tree = [("truck", "vehicle"), ("vehicle", "physobj"), ("physobj", "object"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    got = {tuple(r) for r in ancestors(spark.createDataFrame(tree, "type string, parent string")).collect()}
    up = {("truck", t) for t in ("truck", "vehicle", "physobj", "object")} | {("vehicle", t) for t in ("vehicle", "physobj", "object")}
    up |= {("physobj", "physobj"), ("physobj", "object"), ("object", "object")}
    up |= {(x, y) for x in "abc" for y in "abc"} | {("d", t) for t in "abcd"}
    assert got == up
    assert ancestors(spark.createDataFrame([], "type string, parent string")).count() == 0


def test_texts_without_actions_or_types(spark):
    tables = parse_domains(texts(spark, ("x", "(define (domain d))"), ("y", ""), ("z", None)))
    assert tables.params.count() == tables.conds.count() == tables.types.count() == 0
