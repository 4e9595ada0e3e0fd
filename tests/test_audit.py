import random

import pytest

from salvage.operators import audit

LONG = "x" * 80


@pytest.fixture(scope="module")
def child(spark):
    rng = random.Random(1)
    rows = [
        (
            None if rng.random() < 0.1 else (7 if rng.random() < 0.4 else rng.randrange(60)),
            rng.choice(["a", "b", None, LONG, LONG + "y"]),
        )
        for _ in range(3000)
    ]
    return rows, spark.createDataFrame(rows, "k int, t string").repartition(6)


@pytest.mark.parametrize("columns", [("k",), ("t",), ("k", "t")])
@pytest.mark.parametrize("primary,unique", [(True, True), (False, True), (False, False)])
def test_keys_against_brute_force(child, columns, primary, unique):
    rows, df = child
    picked = [tuple(row[("k", "t").index(c)] for c in columns) for row in rows]
    whole = [p for p in picked if None not in p]
    n_dup, n_null = len(whole) - len(set(whole)), len(picked) - len(whole)
    got = audit.audit_keys({"c": df}, [audit.Key("c", "key", columns, primary, unique)]).first()
    holds = not ((primary or unique) and n_dup) and not (primary and n_null)
    assert tuple(got) == ("c", "key", len(rows), n_dup, n_null, holds)


def test_keys_that_hold(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, t string")
    keys = [audit.Key("c", "pk", ("id",), True), audit.Key("c", "uq", ("t",)), audit.Key("c", "pk_t", ("t",), True)]
    assert [r["holds"] for r in audit.audit_keys({"c": df}, keys).collect()] == [True, True, False]
    assert tuple(audit.audit_keys({"c": df.where("id > 5")}, keys).first())[2:] == (0, 0, 0, True)


def test_a_long_text_is_not_its_digest(spark):
    import hashlib

    rows = [(LONG,), ("#" + hashlib.sha256(LONG.encode()).hexdigest(),)]
    df = spark.createDataFrame(rows, "t string")
    assert audit.audit_keys({"c": df}, [audit.Key("c", "k", ("t",))]).first()["n_dup"] == 0


@pytest.mark.parametrize("columns", [("k",), ("k", "t")])
def test_relationships_against_brute_force(no_broadcast, child, columns):
    rows, df = child
    parents = [(k, t) for k in range(0, 40, 2) for t in ("a", LONG)] + [(7, "b"), (None, "a")]
    parent = no_broadcast.createDataFrame(parents, "pk int, pt string")
    known = {tuple(p[("k", "t").index(c)] for c in columns) for p in parents}
    picked = [tuple(row[("k", "t").index(c)] for c in columns) for row in rows]
    orphans = sum(1 for p in picked if None not in p and p not in known)
    rel = audit.Relationship("r", "c", "p", columns, tuple("p" + c for c in columns))
    got = audit.audit_relationships({"c": df, "p": parent}, [rel]).first()
    assert tuple(got) == ("r", len(rows), orphans, orphans == 0) and orphans


def test_a_hot_reference_is_one_row_before_the_shuffle(no_broadcast, child):
    _, df = child
    parent = no_broadcast.createDataFrame([(7,)], "pk int")
    rel = audit.Relationship("r", "c", "p", ("k",), ("pk",))
    plan = audit.audit_relationships({"c": df, "p": parent}, [rel])._jdf.queryExecution().executedPlan().toString()
    child_side = plan[plan.index("SortMergeJoin") : plan.index("Exchange hashpartitioning(_k0")]
    assert "partial_count(1)" in child_side and child_side.count("Exchange hashpartitioning(k#") == 1


def test_property_rows(spark):
    df = spark.createDataFrame([("s", "user", {"b": b"x", "a": None}), ("r", "user", {})], "source string, scope string, props map<string,binary>")
    assert [tuple(r) for r in audit.property_rows(df, ordered=True).collect()] == [("s", "user", "a", None), ("s", "user", "b", "eA==")]


def test_linked_tables_with_properties(spark):
    inventory = spark.createDataFrame([("a", True, False), ("b", False, True)], "name string, linked boolean, system_object boolean")
    props = spark.createDataFrame([("a", {"k": "v"})], "name string, properties map<string,string>")
    assert [tuple(r) for r in audit.linked_tables(inventory, props).collect()] == [("a", "linked", {"k": "v"})]
    assert audit.linked_tables(inventory).first()["properties"] == {}
    assert [tuple(r) for r in audit.system_objects(inventory).collect()] == [("b", "table")]


def test_both_ends_must_be_selected(spark):
    row = ("r", "A", "B", ["x"], ["y"], False, False)
    rels = spark.createDataFrame([row, ("q", "A", "C", ["x"], ["y"], False, False)], audit.RELATIONSHIPS)
    assert [r["name"] for r in audit.declared_relationships(rels, ["A", "B"]).collect()] == ["r"]
    assert audit.declared_relationships(rels, ["A"]).isEmpty()
    assert audit.declared_relationships(rels, ["a", "b"]).isEmpty()
    assert audit.constraints(rels).count() == 2
