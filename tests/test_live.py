import random
import shutil

import pytest
from pyspark.sql import functions as F

from keelson.errors import KeyClash
from keelson.functions.expr import field, lit, param
from keelson.functions.folds import Collect, Count, Max, Sum, up
from keelson.plans.builder import from_
from keelson.plans.compile import compile_plan
from keelson.streaming.delta import netted
from keelson.streaming import live as live_module
from keelson.streaming.live import Live, window_changes
from keelson.streaming.versions import Versions

SCHEMAS = {"orders": "id long, client long, sum double", "clients": "id long, tier string", "extra": "id long, client long, sum double", "docs": "id long, title string, links array<struct<to:long,weight:long>>"}
ORDERS, CLIENTS = from_("orders", "id"), from_("clients", "id")
PLANS = {
    "filter": ORDERS.filter(field("sum") > 10).with_(twice=field("sum") * lit(2)),
    "inner": ORDERS.join(CLIENTS, "c", ("client", "id"), residual=field("sum") > 10),
    "keeping": ORDERS.join(CLIENTS, "c", ("client", "id"), residual=field("sum") > 10, keeping=True),
    "self": ORDERS.join(ORDERS, "o", ("client", "client"), residual=field("id").ne(field("o", "id"))),
    "agg": ORDERS.groupBy("client", n=Count(), total=Sum(field("sum")), most=Max(field("sum")), ids=Collect(field("id"))).where("total", ">", 20),
    "whole": ORDERS.fold(n=Count(), total=Sum(field("sum"))),
    "union": ORDERS.union(from_("extra", "id")),
    "expand": from_("docs", "id").expand("links", "link", "to"),
    "scan": ORDERS.scan(up("sum"), "sum", as_="b", through="t"),
}


def some_rows(rng, name):
    if name == "docs":
        return {i: (i, f"t{i}", [(to, rng.randrange(5)) for to in rng.sample(range(9), rng.randrange(4))]) for i in rng.sample(range(8), 3)}
    if name == "clients":
        return {i: (i, rng.choice(["gold", "plain"])) for i in rng.sample(range(5), 2)}
    base = 100 if name == "extra" else 0
    return {base + i: (base + i, rng.choice([None, 0, 1, 2, 3]), float(rng.randrange(40))) for i in rng.sample(range(12), 5)}


@pytest.mark.parametrize("name", PLANS)
def test_live_equals_batch_after_every_change(spark, tmp_path, name):
    rng, live = random.Random(name), Live(spark, PLANS[name].tree(), SCHEMAS, str(tmp_path))
    for step in range(2):
        patches = {}
        for source in live.keys:
            if step == 0 or rng.random() < 0.7:
                rows = some_rows(rng, source)
                gone = spark.createDataFrame([(k,) for k in rng.sample(sorted(rows), 1)] + [(rng.randrange(12),)], "id long")
                patches[source] = (spark.createDataFrame(list(rows.values()), live.schemas[source]), gone if step else None)
        change = live.apply(patches)
        want = compile_plan(live.node, live.tables())
        assert sorted(map(str, live.rows().select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert change.filter(F.col("prev").eqNullSafe(F.col("next"))).count() == 0
    assert live.changes_since(1).count() == change.count() and live.changes_since(99) is None


def test_retuning_sends_the_difference(spark, tmp_path):
    node = ORDERS.filter(field("sum") > param("least")).tree()
    live = Live(spark, node, SCHEMAS, str(tmp_path), {"least": 10})
    live.apply({"orders": (spark.createDataFrame([(1, 1, 5.0), (2, 1, 15.0), (3, 1, 25.0)], SCHEMAS["orders"]), None)})
    change = live.retune({"least": 20}, node).collect()
    assert [r["prev"]["id"] for r in change] == [2] and [r["id"] for r in live.rows().collect()] == [3]


def test_union_collision_raises(spark, tmp_path):
    live = Live(spark, PLANS["union"].tree(), SCHEMAS, str(tmp_path))
    rows = spark.createDataFrame([(1, 1, 1.0)], SCHEMAS["orders"])
    with pytest.raises(KeyClash):
        live.apply({"orders": (rows, None), "extra": (rows, None)})


def test_a_stream_of_changes_is_followed(spark, tmp_path):
    live = Live(spark, PLANS["agg"].tree(), SCHEMAS, str(tmp_path / "live"))
    feed, ddl = str(tmp_path / "feed"), "kind string, seq long, id long, client long, sum double"
    spark.createDataFrame([("put", 1, 1, 7, 30.0), ("put", 2, 2, 7, 5.0), ("drop", 3, 2, None, None), ("put", 4, 3, 8, 50.0), ("drop", 5, 3, None, None), ("put", 6, 3, 9, 60.0)], ddl).coalesce(1).write.parquet(feed)
    q = live.follow(spark.readStream.schema(ddl).parquet(feed), "orders", str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert sorted((r["client"], r["total"]) for r in live.rows().collect()) == [(7, 30.0), (9, 60.0)]
    again = Live(spark, PLANS["agg"].tree(), SCHEMAS, str(tmp_path / "live"))
    assert again.version == live.version == 1 and again.rows().count() == 2
    q = again.follow(spark.readStream.schema(ddl).parquet(feed), "orders", str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert again.version == 1
    shutil.rmtree(tmp_path / "checkpoint")  # the batch comes again under its number, as after a failure
    q = again.follow(spark.readStream.schema(ddl).parquet(feed), "orders", str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert again.version == 1 and again.rows().count() == 2


def test_logs_are_compacted_and_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Versions.write_base, "__defaults__", (2,))
    monkeypatch.setattr(live_module, "KEEP", 2)
    live = Live(spark, ORDERS.filter(field("sum") > 1).tree(), SCHEMAS, str(tmp_path))
    for k in range(6):
        live.apply({"orders": (spark.createDataFrame([(k, 1, 9.0), (0, 1, float(k))], SCHEMAS["orders"]).filter(f"id = {k} or id = 0").dropDuplicates(["id"]), None)})
    log = live.logs["orders"]
    assert len(log.bases) > 1 and live.rows(6).count() == 6 and live.rows(4).count() == 4
    live.forget()
    assert sorted(r["id"] for r in live.rows().collect()) == [0, 1, 2, 3, 4, 5] and min(log.bases) > 0 and live.rows(4).count() == 4
    assert live.changes_since(3) is None and live.changes_since(4) is not None
    assert Live(spark, ORDERS.filter(field("sum") > 1).tree(), SCHEMAS, str(tmp_path)).rows().count() == 6


def test_netting(spark):
    ddl = "prev struct<id:long,v:long>, next struct<id:long,v:long>, seq long"
    rows = [(None, (1, 1), 1), ((1, 1), (1, 2), 2), (None, (2, 1), 1), ((2, 1), None, 2), ((3, 1), (3, 2), 1), ((3, 2), (3, 1), 2)]
    assert [(r["prev"], r["next"]["v"]) for r in netted(spark.createDataFrame(rows, ddl), ["id"]).collect()] == [(None, 2)]


def test_window_changes(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "id long, v long"), spark.createDataFrame([(2, 3), (4, 4)], "id long, v long")
    assert sorted((r["what"], r["row"]["id"]) for r in window_changes(a, b, ["id"]).collect()) == [("changed", 2), ("entered", 4), ("left", 1)]


def test_a_refused_batch_leaves_nothing_behind(spark, tmp_path):
    live = Live(spark, PLANS["union"].tree(), SCHEMAS, str(tmp_path))
    rows = lambda *ids: spark.createDataFrame([(i, 1, 1.0) for i in ids], SCHEMAS["orders"])
    live.apply({"orders": (rows(1), None)})
    with pytest.raises(KeyClash):
        live.apply({"extra": (rows(1), None)})
    live.apply({"orders": (rows(2), None)})
    assert live.tables()["extra"].count() == 0 and sorted(r["id"] for r in live.rows().collect()) == [1, 2]
    again = Live(spark, PLANS["union"].tree(), SCHEMAS, str(tmp_path))
    assert again.version == 2 and again.tables()["extra"].count() == 0 and again.rows().count() == 2


def test_counts_and_whole_sums_are_added_to(spark, tmp_path, monkeypatch):
    from keelson.streaming import delta

    node = ORDERS.groupBy("client", n=Count(), total=Sum(field("client"))).tree()
    live = Live(spark, node, SCHEMAS, str(tmp_path))
    rows = lambda *some: spark.createDataFrame([(i, c, 1.0) for i, c in some], SCHEMAS["orders"])
    live.apply({"orders": (rows((1, 5), (2, 5), (3, None)), None)})
    monkeypatch.setattr(delta, "_semi", lambda *a: 1 / 0)  # no group is read again
    live.apply({"orders": (rows((2, 6), (4, 5)), spark.createDataFrame([(3,)], "id long"))})
    assert sorted(map(tuple, live.rows().collect())) == [(5, 2, 10.0), (6, 1, 6.0)]


def test_a_query_is_brought_to_life(spark, tmp_path):
    rich = ORDERS.filter(field("sum") > param("least"))
    live = rich.live(spark, SCHEMAS, str(tmp_path), least=10)
    live.apply({"orders": (spark.createDataFrame([(1, 1, 5.0), (2, 1, 15.0)], SCHEMAS["orders"]), None)})
    assert [r["id"] for r in rich.live(spark, SCHEMAS, str(tmp_path), least=10).rows().collect()] == [2]
