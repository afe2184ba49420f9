import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from keelson.errors import PlanError
from keelson.functions.expr import All, AnyOf, Cmp, Lit, canon, compile_expr, condition, field, lit, param, params_of, some, substitute

SCHEMA = "id long, x double, y double, s string, b boolean, r struct<v:long>"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, 5.0, 0.0, "abc", True, (7,)), (2, None, 2.0, None, None, None), (3, 0.0, 0.0, "", False, (None,)), (4, -1.5, 3.0, "12", True, (1,))]
    return spark.createDataFrame(data, SCHEMA).cache()


def values(rows, e):
    return {r[0]: r[1] for r in rows.select("id", compile_expr(e, rows.schema).alias("v")).collect()}


def kept(rows, e):
    return {r[0] for r in rows.filter(condition(e, rows.schema)).select("id").collect()}


def test_equality_is_strict_and_null_equals_null(rows):
    assert kept(rows, field("x").eq(None)) == {2}
    assert kept(rows, field("x").ne(5)) == {2, 3, 4}
    assert kept(rows, field("x").eq("5")) == set()
    assert kept(rows, field("x").ne("5")) == {1, 2, 3, 4}
    assert kept(rows, field("r", "v").eq(field("x"))) == {2}


def test_null_acts_as_zero_in_order_and_arithmetic(rows):
    assert kept(rows, field("x") < 1) == {2, 3, 4}
    assert kept(rows, field("x") > 1) == {1}
    assert values(rows, field("x") + lit(1)) == {1: 6.0, 2: 1.0, 3: 1.0, 4: -0.5}


def test_division_never_raises(rows):
    v = values(rows, field("x") / field("y"))
    assert v[1] == math.inf and v[2] == 0.0 and math.isnan(v[3]) and v[4] == -0.5
    assert values(rows, field("x") / lit(0))[4] == -math.inf


def test_text_joins_and_contains(rows):
    assert values(rows, field("s") + field("x")) == {1: "abc5", 2: "nullnull", 3: "0", 4: "12-1.5"}
    assert kept(rows, field("s").has("b")) == {1}
    assert kept(rows, field("s").has("")) == {1, 2, 3, 4}
    assert kept(rows, field("s").has("ul")) == {2}


def test_logic_has_two_values(rows):
    assert kept(rows, ~field("b")) == {2, 3}
    assert kept(rows, field("b") & lit(True)) == {1, 4}
    assert kept(rows, All(())) == {1, 2, 3, 4}
    assert kept(rows, AnyOf(())) == set()
    assert kept(rows, some(field("s"))) == {1, 3, 4}
    assert kept(rows, field("x")) == set()


def test_mixed_comparison_coerces_text_to_numbers(rows):
    assert kept(rows, field("s") > lit(10)) == {4}
    assert kept(rows, field("s") <= lit(0)) == {2, 3}


def test_unknown_fields_and_holes_are_refused(rows):
    with pytest.raises(PlanError):
        compile_expr(field("nothing"), rows.schema)
    with pytest.raises(PlanError):
        compile_expr(param("p"), rows.schema)
    with pytest.raises(PlanError):
        compile_expr(Cmp("~", lit(1), lit(2)), rows.schema)


def test_holes_are_listed_and_filled():
    e = (field("x") > param("a")) & ~field("y").eq(param("b"))
    assert list(params_of(e)) == ["a", "b"]
    assert list(params_of(substitute(e, {"a": 1}))) == ["b"]


def test_canon_tells_plans_apart():
    assert canon(field("a", "b")) != canon(field("a.b"))
    assert canon(lit(1)) != canon(lit("1"))
    assert canon(lambda get: get("x")) is None
    assert canon(All((field("x"), field("y")))) != canon(AnyOf((field("x"), field("y"))))


def test_plain_comparisons_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = df.filter(condition((field("o_orderkey") > 5) & field("o_orderstatus").eq("F"), df.schema))._jdf.queryExecution().toString()
    assert "GreaterThan(o_orderkey,5)" in text and "EqualTo(o_orderstatus,F)" in text


numbers = st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(0.0))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=8), st.sampled_from(["==", "!=", "<", "<=", ">", ">=", "+", "-", "*"]))
def test_against_a_plain_evaluator(spark, pairs, op):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a double, b double")
    e = Cmp(op, field("a"), field("b")) if op in ("==", "!=", "<", "<=", ">", ">=") else {"+": field("a") + field("b"), "-": field("a") - field("b"), "*": field("a") * field("b")}[op]
    got = {r[0]: r[1] for r in df.select("i", compile_expr(e, df.schema)).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = a or 0.0, b or 0.0
        want = {"==": a == b, "!=": a != b, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "+": x + y, "-": x - y, "*": x * y}[op]
        assert got[i] == want, (a, op, b)


def test_literals_of_other_kinds_are_refused(rows):
    with pytest.raises(PlanError):
        compile_expr(Lit([1]), rows.schema)
