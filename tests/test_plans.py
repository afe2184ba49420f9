import pytest
from pyspark.sql import functions as F

from keelson.errors import KeyClash, PlanError
from keelson.functions.expr import field, lit, param
from keelson.functions.folds import Collect, Count, Custom, Max, Min, Sum, down, up
from keelson.operators.running import ordered_pass, running_sum
from keelson.plans.builder import Cell, from_
from keelson.plans.check import canon, check
from keelson.plans.compile import Compiler, Ordering, compile_plan
from keelson.plans.nodes import Agg, Expand, Filter, Join, Pure, Scan, Source, Union, fill, key_paths, params
from keelson.plans.why import why

ORDERS, CLIENTS = from_("orders", "id"), from_("clients", "id")


@pytest.fixture(scope="module")
def tables(spark):
    orders = spark.createDataFrame([(1, 1, 5.0), (2, 2, 20.0), (10, None, 30.0), (3, 1, 1.0)], "id long, client long, sum double")
    clients = spark.createDataFrame([(1, 1, "gold"), (2, 2, None), (3, None, "plain")], "id long, code long, tier string")
    docs = spark.createDataFrame([(1, "a", [(1, 5), (2, 6)]), (2, "b", []), (3, "c", None)], "id long, title string, links array<struct<to:long,weight:long>>")
    none = spark.createDataFrame([], "id long, client long, sum double")
    return {"orders": orders, "clients": clients, "docs": docs, "none": none}


def got(q, tables, *columns, **kw):
    df = q.batch(tables, **kw)
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_projection_sees_the_row_as_it_came(tables):
    q = ORDERS.with_(sum=field("sum") * lit(2), double=field("sum") * lit(2)).pick("id", "double", "missing")
    assert got(q, tables) == [(1, 10.0, None), (10, 60.0, None), (2, 40.0, None), (3, 2.0, None)]


def test_join_nests_and_residual_is_part_of_the_match(tables):
    q = ORDERS.join(CLIENTS, "c", ("client", "code"), residual=field("sum") > 3)
    assert got(q, tables, "id", "c.tier") == [(1, "gold"), (2, None)]
    keep = ORDERS.join(CLIENTS, "c", ("client", "code"), residual=field("sum") > 3, keeping=True)
    assert got(keep, tables, "id", F.col("c").isNull()) == [(1, False), (10, True), (2, False), (3, True)]


def test_null_keys_match_nobody(tables):
    assert got(ORDERS.join(CLIENTS, "c", ("client", "code")), tables, "id") == [(1,), (2,), (3,)]


def test_join_on_several_fields_and_with_itself(tables):
    q = ORDERS.join(ORDERS, "o", [("client", "client"), ("id", "id")])
    assert len(got(q, tables)) == 3
    q = ORDERS.join(ORDERS, "o", ("client", "client"), residual=field("id").ne(field("o", "id")))
    assert got(q, tables, "id", "o.id") == [(1, 3), (3, 1)]


def test_folds(tables):
    q = ORDERS.groupBy("client", n=Count(), total=Sum(field("sum")), least=Min(field("sum")), most=Max(field("sum")), ids=Collect(field("id"), (down("sum"),)))
    assert got(q, tables) == [(1, 2, 6.0, 1.0, 5.0, [1, 3]), (2, 1, 20.0, 20.0, 20.0, [2]), (None, 1, 30.0, 30.0, 30.0, [10])]


def test_whole_table_folds_give_one_row_over_nothing(tables):
    assert got(from_("none", "id").fold(n=Count(), total=Sum(field("sum")), most=Max(field("sum"))), tables) == [(0, 0.0, None)]


def test_collect_orders_by_key_as_text_and_keeps_nulls(tables):
    assert got(ORDERS.fold(ids=Collect(field("id")), clients=Collect(field("client"))), tables) == [([1, 10, 2, 3], [1, None, 2, 1])]


def test_custom_fold_runs_in_key_order(tables):
    fold = Custom(F.lit(""), lambda held, row: F.concat(held, row["id"].cast("string"), F.lit(";")))
    assert got(ORDERS.fold(all=fold), tables) == [("1;10;2;3;",)]


def test_union_refuses_keys_on_both_sides(tables):
    assert len(got(ORDERS.union(from_("none", "id")), tables, verify=True)) == 4
    with pytest.raises(KeyClash):
        ORDERS.union(ORDERS).batch(tables, verify=True)


def test_expand_drops_empty_lists_and_refuses_repeats(spark, tables):
    q = from_("docs", "id").expand("links", "link", "to")
    assert got(q, tables, "id", "link.to", "link.weight") == [(1, 1, 5), (1, 2, 6)]
    twice = spark.createDataFrame([(1, [(1, 5), (1, 6)])], "id long, links array<struct<to:long,weight:long>>")
    with pytest.raises(KeyClash):
        from_("docs", "id").expand("links", "links", "to").batch({"docs": twice}, verify=True)


@pytest.mark.parametrize("two", [False, True])
def test_running_sums_break_ties_by_key_as_text(spark, two):
    df = spark.createDataFrame([(1, 5, 1.0), (2, 5, 2.0), (10, 5, 4.0), (3, 1, 8.0), (4, None, None)], "id long, rank long, h double")
    out = running_sum(df, [(F.col("rank"), False)], F.col("id").cast("string"), F.col("h"), "b", "t", 100, two_phases=two)
    assert {r["id"]: (r["b"], r["t"]) for r in out.collect()} == {4: (100.0, 100.0), 3: (100.0, 108.0), 1: (108.0, 109.0), 10: (109.0, 113.0), 2: (113.0, 115.0)}
    assert out.columns == ["id", "rank", "h", "b", "t"]


def test_places_in_two_phases(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 g", "id * 13 % 1000 v")
    one, two = (ordered_pass(df, [(F.col("g"), True), (F.col("v"), False)], [F.col("id")], F.col("v"), "b", "t", "p", 3, two_phases=k) for k in (False, True))
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, two.collect())) and sorted(r[-1] for r in rows) == list(range(1000))


def test_a_filter_over_a_scan_sees_the_whole_pass(tables):
    q = ORDERS.scan(up("sum"), "sum", as_="b").filter(field("sum") > 10)
    assert got(q, tables, "id", "b") == [(10, 26.0), (2, 6.0)]


def test_ordering(tables):
    o = Ordering(ORDERS.scan(up("sum"), "sum", start=5).tree(), tables)
    one = lambda df: [tuple(r) for r in df.collect()]
    assert one(o.offset_at(1)) == [(6.0,)] and one(o.offset_of("2")) == [(11.0,)] and one(o.key_at(0)) == [("3",)] and one(o.place_of("10")) == [(3,)]
    assert one(o.at(12)) == [(2, "2", 1.0)] and one(o.at(-9)) == [(0, "3", -14.0)] and one(o.at(1e9))[0][0] == 3
    assert one(o.extent()) == [(61.0, 4)]
    empty = Ordering(from_("none", "id").scan(up("sum"), "sum", start=5).tree(), tables)
    assert one(empty.at(1)) == [] and one(empty.extent()) == [(5.0, 0)]


def test_cells_get_holes_of_their_own(tables):
    a, b = Cell(3), Cell(1)
    q = ORDERS.where("sum", ">", a).join(CLIENTS.where("id", "==", b), "c", ("client", "code"))
    assert len(params(q.tree())) == 2
    assert got(q, tables, "id") == [(1,)]
    a.value = 0
    assert got(q, tables, "id") == [(1,), (3,)]
    with pytest.raises(PlanError):
        compile_plan(q.tree(), tables)


def test_holes_are_filled_everywhere():
    s = Source("a", ("id",))
    node = Scan(Agg(Pure(Filter(s, field("x") > param("p")), (("y", param("q")),)), ("id",), (("t", Sum(param("r"))),)), (up("id"),), param("s"))
    assert params(node) == ["p", "q", "r", "s"] and params(fill(node, dict.fromkeys("pqrs", 1))) == []


S = Source("a", ("id",))


@pytest.mark.parametrize(
    "node",
    [
        Source("a", ()), Pure(S, (("id", lit(1)),)), Pure(S, (), ("x",)), Join(S, S, "b", ()), Join(S, S, "", (("x", "y"),)), Join(S, S, "id", (("x", "y"),)), Scan(S, (), lit(1)),
        Scan(S, (up("x"),), lit(1), "id"), Union(S, Source("b", ("k",))), Expand(S, "", "x", ("k",)), Expand(S, "x", "y", ()), Agg(S, ("id",), ()), Agg(S, ("id",), (("id", Count()),)), Agg(S, (), (("n", Count()), ("n", Count()))),
    ],
)
def test_plans_that_mean_nothing_are_refused(node):
    with pytest.raises(PlanError):
        check(Filter(node, lit(True)))


def test_compile_refuses_what_the_data_cannot_give(tables):
    for q in (from_("nowhere", "id"), from_("orders", "nothing"), ORDERS.groupBy("nothing", n=Count()), ORDERS.join(CLIENTS, "c", ("sum", "tier")), ORDERS.join(CLIENTS, "sum", ("client", "code"))):
        with pytest.raises(PlanError):
            q.batch(tables)


def test_keys_and_texts():
    j = ORDERS.join(CLIENTS, "c", ("client", "code")).expand("c", "e", "k").tree()
    assert key_paths(j) == [("id",), ("c", "id"), ("e", "k")]
    assert canon(ORDERS.groupBy("client", n=Count()).tree()) == canon(Agg(Source("orders", ("id",)), ("client",), (("n", Count()),)))
    assert canon(ORDERS.groupBy("client", v=Collect(field("id"), (up("sum"),))).tree()) != canon(ORDERS.groupBy("client", v=Collect(field("id"))).tree())
    assert canon(ORDERS.filter(lambda get: get("id")).tree()) is None


def test_why(tables):
    back = lambda q, *keys: sorted((r["source"], r["key"]) for r in why(q.tree(), tables, *keys).collect())
    join = ORDERS.join(CLIENTS, "c", ("client", "code"), keeping=True)
    assert back(join, "[1,1]") == [("clients", "1"), ("orders", "1")]
    assert back(join, "[10,null]") == [("orders", "10")]
    assert back(ORDERS.filter(field("sum") > 2).groupBy("client", n=Count()), "1") == [("orders", "1")]
    assert back(ORDERS.fold(n=Count()), "[]") == [("orders", "1"), ("orders", "10"), ("orders", "2"), ("orders", "3")]
    assert back(from_("docs", "id").expand("links", "l", "to"), "[1,2]") == [("docs", "1")]
    assert back(ORDERS.union(from_("none", "id")).scan(up("sum"), "sum", as_="b"), "2") == [("orders", "2")]


def _joined_fold():
    """Keys in order; only an ordered, associative join gives the same text."""
    return Custom(F.lit(""), lambda held, row: F.concat(held, row["id"].cast("string"), F.lit(";")), join=lambda a, b: F.concat(a, b))


@pytest.mark.parametrize("by", [["g"], []])
def test_large_groups_are_folded_in_stretches(spark, by):
    rows = spark.range(500).select("id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, 1).otherwise(2).alias("g"), (F.col("id") % 11).cast("double").alias("v"))
    folds = {"n": Count(), "s": Sum(field("v")), "low": Min(field("v")), "high": Max(field("v")), "ids": _joined_fold()}
    node = (from_("t", "id").groupBy(by, **folds) if by else from_("t", "id").fold(**folds)).tree()
    whole, split = (Compiler({"t": rows}, two_phases=two)(node) for two in (False, True))
    assert whole.dtypes == split.dtypes
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    assert "rangepartitioning" in split._jdf.queryExecution().toString()


def test_stretches_of_nothing(spark):
    empty = spark.range(0).withColumn("v", F.lit(1.0))
    q = from_("t", "id").fold(n=Count(), s=Sum(field("v")), high=Max(field("v")), ids=_joined_fold())
    assert [tuple(r) for r in Compiler({"t": empty}, two_phases=True)(q.tree()).collect()] == [(0, 0.0, None, "")]
    lone = Compiler({"t": empty}, two_phases=True)(from_("t", "id").fold(ids=Collect()).tree())
    assert lone.first()["ids"] == []
