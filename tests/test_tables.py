import random

import pytest
from pyspark.sql import functions as F

from keelson import notice as notices
from keelson.errors import KeyClash
from keelson.functions.expr import field, lit
from keelson.functions.folds import Count, Sum, down, up
from keelson.operators import formulas, logs, overlay, views
from keelson.operators.keyed import Keyed, alike, by_revision, crowded, same_items

DDL = "id long, grp string, score long, rev long"


def table(spark, rows, wins=None):
    return Keyed(spark.createDataFrame(rows, DDL), ("id",), wins)


def held(k):
    return {r["id"]: tuple(r) for r in (k.df if isinstance(k, Keyed) else k).collect()}


def test_random_batches_match_a_dictionary(spark):
    rng, model, t = random.Random(7), {}, table(spark, [])
    for _ in range(12):
        put = [(i, rng.choice(["even", "odd"]), rng.randrange(100), 1) for i in rng.sample(range(20), rng.randrange(1, 6))]
        drop = [(rng.randrange(20),) for _ in range(rng.randrange(3))]
        if rng.random() < 0.2:
            t = t.replace(spark.createDataFrame(put, DDL))
            model = {r[0]: r for r in put}
        else:
            t = t.apply(spark.createDataFrame(put, DDL), spark.createDataFrame(drop, "id long"))
            model |= {r[0]: r for r in put}
            for (i,) in drop:
                model.pop(i, None)
        t = Keyed(spark.createDataFrame([tuple(r) for r in t.df.collect()], DDL), t.key)
        assert held(t) == model
    even = field("grp").eq("even")
    assert held(t.where(even)) == {k: r for k, r in model.items() if r[1] == "even"}
    assert t.count(even).first()[0] == sum(r[1] == "even" for r in model.values())
    assert t.sum_by(field("score") * lit(2)).first()[0] == 2 * sum(r[2] for r in model.values())
    order = sorted(model.values(), key=lambda r: (-r[2], r[0]))
    view = views.Ordered(t, down("score"))
    assert [tuple(r) for r in view.slice(1, 4).collect()] == order[1:4]
    assert [tuple(r) for r in view.slice(-5, 2).collect()] == order[:2] and view.slice(3, 3).count() == 0
    assert [view.rank(r[0]).first()[0] for r in order[:3]] == [0, 1, 2] and view.rank(999).first()[0] == -1


def test_an_older_revision_loses_even_in_a_snapshot(spark):
    t = table(spark, [(1, "a", 1, 5), (2, "b", 2, 5)], by_revision("rev"))
    page = spark.createDataFrame([(1, "old", 9, 4), (3, "new", 3, 1)], DDL)
    assert held(t.replace(page)) == {1: (1, "a", 1, 5), 3: (3, "new", 3, 1)}
    assert held(t.put(page)) == {1: (1, "a", 1, 5), 2: (2, "b", 2, 5), 3: (3, "new", 3, 1)}
    again = spark.createDataFrame([(7, "x", 1, 2, 1), (7, "y", 2, 1, 2), (7, "z", 3, 2, 3)], DDL + ", seq long")
    assert held(t.put(again, "seq"))[7] == (7, "z", 3, 2)


def test_changes_and_null_keys(spark):
    a, b = table(spark, [(1, "a", 1, 0), (None, "n", 1, 0)]), table(spark, [(1, "a", 2, 0), (None, "n", 1, 0), (3, "c", 1, 0)])
    change = a.changes_to(b).collect()
    assert sorted((r["prev"] and r["prev"]["score"], r["next"]["id"]) for r in change if r["prev"] or r["next"]["id"] == 1) == [(1, 1)] and len(change) == 2
    live = a.where_live(field("score") > 5, field("score") > 0).collect()
    assert len(live) == 2 and all(r["prev"] is None for r in live)
    assert a.row(None).count() == 1 and a.has(1) and not a.has(9)
    with pytest.raises(KeyClash):
        table(spark, [(1, "a", 1, 0), (1, "b", 1, 0)]).checked()


def test_views_of_nulls_and_numbers(spark):
    t = table(spark, [(10, "a", None, 0), (9, "a", 5, 0), (2, "b", 5, 0)])
    assert [r["id"] for r in views.Ordered(t, up("score")).rows().collect()] == [10, 2, 9]
    assert [r["id"] for r in views.Ordered(t, down("score")).rows().collect()] == [2, 9, 10]
    for by in (up("score"), down("score")):
        v = views.Ordered(t, by)
        assert [v.rank(r["id"]).first()[0] for r in v.rows().collect()] == [0, 1, 2]
    assert [r["id"] for r in views.list_for(t, "id", 10).collect()] == [10] and views.list_for(t, "grp", "zz").count() == 0
    assert {(r["grp"], r["id"]) for r in views.lists_by(t, "grp", (up("score"),), (0, 1)).collect()} == {("a", 10), ("b", 2)}
    assert sorted(tuple(r) for r in views.by_each(t, "grp", {"key": views.key_of("grp"), "n": Count()}).select("key", "n").collect()) == [("a", 2), ("b", 1)]
    assert tuple(views.fold_all(t, {"n": Count(), "s": Sum(field("score"))}, views.has("grp", "zz")).first()) == (0, 0.0)
    line = {r["id"]: (r["place"], r["offset"]) for r in views.offsets(t, field("score")).collect()}
    assert line == {2: (0, 0.0), 9: (1, 5.0), 10: (2, 10.0)}
    assert t.df.select(alike(["id", "score"], ["id", "score"]).alias("s")).filter("s").count() == 3


def test_blocks_and_ranges(spark):
    df = spark.range(100).selectExpr("'a' line", "id at", "id v")
    parts = {r["block"]: r["part"] for r in views.blocks(df, "line", "at", F.sum("v")).collect()}
    assert parts[0] == sum(range(32)) and parts[3] == sum(range(96, 100))
    assert views.range_fold(df, "line", "at", 10, 12, F.sum("v")).first()["fold"] == 33


def test_crowded_joins_are_noticed(spark):
    heard = []
    off = notices.on_notice(lambda kind, facts: heard.append((kind, facts["rows"])))
    df = spark.range(50).selectExpr("id % 2 k")
    assert crowded(df, ["k"], 25).count() == 2 and heard == [("join.crowded", 25)]
    off()
    assert crowded(df, ["k"], 26).count() == 0 and len(heard) == 1


def test_boards(spark):
    ddl = "lanes map<string,array<int>>, ids array<int>, notes array<struct<kind:string,id:int,lane:string,at:int,stuck:boolean>>"
    lanes = {"a": [1, 2], "b": [3, 9]}

    def after(*notes):
        df = spark.createDataFrame([(lanes, [1, 2, 3], list(notes))], ddl)
        return df.select(overlay.laid(F.col("lanes"), F.col("ids"), F.col("notes"))).first()[0]

    assert after() == {"a": [1, 2], "b": [3]}
    assert after(("place", 1, "b", 0, False), ("take", 2, "", 0, False)) == {"a": [], "b": [1, 3]}
    assert after(("place", 1, "nowhere", 0, False)) == {"a": [2], "b": [3]}
    assert after(("take", 1, "", 0, True), ("put", 9, "", 0, False)) == {"a": [1, 2], "b": [3, 9]}
    assert after(("place", 1, "b", 99, False), ("place", 1, "b", 99, False)) == {"a": [2], "b": [3, 1]}
    row = spark.createDataFrame([([5, 6],)], "l array<int>").select(overlay.lane_find(F.col("l"), F.lit(6)), overlay.lane_find(F.col("l"), F.lit(7)), overlay.lane_append(F.col("l"), F.lit(5))).first()
    assert tuple(row) == (1, -1, [6, 5])


def test_projection_of_notes(spark):
    df = spark.createDataFrame([([("add", 2, False), ("odd", 9, False), ("add", 5, True), ("double", 0, False)],)], "n array<struct<kind:string,by:int,stuck:boolean>>")
    v = overlay.projected(F.lit(1), F.col("n"), {"add": lambda h, n: h + n["by"], "double": lambda h, n: h * 2})
    assert df.select(v).first()[0] == 6


def test_formulas(spark):
    df = spark.createDataFrame([("7", "2", "text", None)], "A string, B string, C string, D string")
    value = lambda f: df.select(formulas.compile_row(f, df.columns)).first()[0]
    assert value("1+2*3^2^1-4/2") == 17.0 and value("-A1+B1") == -5.0 and value("2^-1") == 0.5
    assert value("SUM(A1:D1)") == 9.0 and value("AVG(A1:D1)") == 2.25 and value("COUNT(A1:D1)") == 2.0 and value("PROD(A1,B1)") == 14.0 and value("MIN(A1:C1)") == 0.0 and value("MAX(A1:C1)") == 7.0
    assert value("INT(-2.7)") == -2.0 and value("MOD(-7,3)") == -1.0 and value("ROUND(2.5,0)") == 2.0 and value("ROUND(0.125,2)") == 0.12 and value("SIGN(-3)") == -1.0 and value("ABS(-3)") == 3.0 and value("SQRT(16)") == 4.0 and value("POW(2,3)") == 8.0
    assert value("1/0") is None and value("SQRT(-1)") is None and value("MOD(1,0)") is None
    for text, error in (("1+", formulas.SYNTAX), ("FOO(1)", formulas.NAME), ("ABS(1,2)", formulas.VALUE), ("Z9", formulas.REF), ("(1", formulas.SYNTAX)):
        with pytest.raises(formulas.FormulaError, match="#"):
            try:
                formulas.compile_row(text, df.columns)
            except formulas.FormulaError as e:
                assert str(e) == error
                raise


def test_log_search(spark):
    df = spark.createDataFrame([(i, f"line {i} error" if i % 3 == 0 else f"line {i}") for i in range(200)], "n int, t string")
    first, total = logs.search(df, "t", "error", "n")
    assert [r["n"] for r in first.collect()] == list(range(0, 150, 3)) and total.first()[0] == 67
    assert logs.search(df, "t", "1[0-9]$", "n", regex=True)[1].first()[0] == 10 * 2 - 0 - sum((i % 3 == 0) for i in range(200) if i % 100 in range(10, 20))
    assert logs.search(df, "t", "(", "n", regex=True)[1].first()[0] == 0 and logs.search(df, "t", "", "n")[1].first()[0] == 0
    h = {r["bucket"]: r["n"] for r in logs.histogram(spark.createDataFrame([(5.0,), (250.0,), (9999.0,)], "ms double"), "ms").collect()}
    assert len(h) == 20 and h[0] == 1 and h[2] == 1 and h[19] == 1 and sum(h.values()) == 3
    bars = {r["n"]: r["height"] for r in logs.bar_heights(spark.createDataFrame([(0,), (1,), (1000,)], "n int"), "n").collect()}
    assert bars[0] == 0.0 and bars[1] >= 4.0 and abs(bars[1000] - 100) < 1e-9


def test_signs_bind_tighter_than_powers(spark):
    row = spark.createDataFrame([("3", "2.5")], "A string, B string")
    value = lambda text: row.select(formulas.compile_row(text, ["A", "B"]).alias("v")).first()["v"]
    assert (value("-2^2"), value("2^-1"), value("2^3^2"), value("-A1^2"), value("0-2^2")) == (4.0, 0.5, 512.0, 9.0, -4.0)
    assert (value("ROUND(B1)"), value("round(b1, 0)"), value("sum(a1:b1)"), value("SUM()"), value("PROD()"), value("AVG()")) == (2.0, 2.0, 5.5, 0.0, 1.0, None)
    with pytest.raises(formulas.FormulaError):
        formulas.parse("ROUND(1, 2, 3)")


def test_a_page_with_several_revisions_of_a_key(spark):
    empty = Keyed(spark.createDataFrame([], DDL), ("id",), by_revision("rev"))
    page = spark.createDataFrame([(1, "new", 1, 5), (1, "old", 1, 1), (2, "b", 2, 2), (1, "mid", 1, 3)], DDL)
    for t in (empty.put(page), empty.replace(page), empty.put(page.orderBy("rev")), empty.put(page, seq="rev")):
        assert {r["id"]: r["rev"] for r in t.df.collect()} == {1: 5, 2: 2}


def test_repeated_keys_without_an_order_are_refused(spark):
    t = Keyed(spark.createDataFrame([], DDL), ("id",))
    same = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 1, 1), (2, "b", 2, 2)], DDL)
    assert t.put(same).df.count() == 2
    with pytest.raises(Exception, match="several rows have the key"):
        t.put(spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 1)], DDL)).df.collect()
    numbered = spark.createDataFrame([(1, "a", 1, 1, 2), (1, "b", 1, 1, 1)], DDL + ", n int")
    assert t.replace(numbered, seq="n").df.collect()[0][1] == "a"


def test_maps_are_compared_by_their_entries(spark):
    ddl = "id long, m map<string,struct<x:int,y:map<string,int>>>"
    a = Keyed(spark.createDataFrame([(1, {"p": (1, {"q": 1}), "r": (2, None)}), (2, {}), (3, None)], ddl), ("id",))
    b = Keyed(spark.createDataFrame([(1, {"r": (2, None), "p": (1, {"q": 1})}), (2, None), (3, None)], ddl), ("id",))
    assert [r["prev"]["id"] for r in a.changes_to(b).collect()] == [2]
    met = a.df.withColumn("n", F.col("m"))
    assert met.filter(alike(["m"], ["n"], met)).count() == 3 and met.filter(same_items(met, "m", "n")).count() == 3
    assert a.put(b.df).df.count() == 3


def test_folds_over_rows_with_maps_and_long_sums(spark):
    from keelson.functions.expr import field
    from keelson.functions.folds import Collect, Custom, Sum
    from keelson.plans.builder import from_

    rows = spark.createDataFrame([(1, "a", {"x": 1}, 2**62), (2, "a", {"y": 2}, 2**62), (3, "a", None, 2**62)], "id long, g string, m map<string,int>, n long")
    plan = from_("t", "id").groupBy("g", total=Sum(field("n")), all=Collect(), maps=Collect(field("m")), seen=Custom(F.lit(""), lambda h, r: F.concat(h, r["id"].cast("string"))))
    got = plan.batch({"t": rows}).collect()[0]
    assert got["total"] == 3.0 * 2**62 and [r["id"] for r in got["all"]] == [1, 2, 3] and got["maps"] == [{"x": 1}, {"y": 2}, None] and got["seen"] == "123"
