"""Registered queries of the relational library and their SQL twins, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.expr import field, lit, param, some
from keelson.functions.folds import Collect, Count, Custom, Max, Min, Sum, down, up
from keelson.operators import formulas, logs, overlay, views
from keelson.operators.keyed import Keyed, alike, by_revision
from keelson.plans.builder import Cell, from_
from keelson.operators.line import Line
from keelson.operators.running import checkpointed
from keelson.plans.compile import Ordering, compile_plan, key_column
from keelson.plans.why import why
from keelson.sources.outbox import DONE, STUCK, WAITING, active, owed, readable, stuck
from keelson.sources.remote import FAILED, VALUE, status_of
from keelson.streaming.delta import Delta, netted
from keelson.streaming.feed import Feed
from keelson.streaming.live import Live, window_changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


class Tables(dict):
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__({n: None for n in TABLES})
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if super().get(name) is None:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return super().__getitem__(name)


def query(sql: str, name: str | None = None):
    """Register a function of the tables with its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE[key] = sql
        return f

    return register


LINES, ORDERS, CUSTOMERS = from_("lineitem", *LINE), from_("orders", "o_orderkey"), from_("customer", "c_custkey")
DOCS, LABELS, EVENTS = from_("documents", "doc_id"), from_("labels", "doc_id"), from_("events", "event_id")


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS qty FROM lineitem WHERE l_quantity > 24 GROUP BY 1")
def agg_flagship(t):
    return LINES.where("l_quantity", ">", 24).groupBy("l_returnflag", n=Count(), qty=Sum(field("l_quantity"))).batch(t)


# Filters and expressions.

for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_sql} 25", f"filter_cmp_{_name}")(
        lambda t, op=_op: LINES.where("l_quantity", op, 25).batch(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    )


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_type, 'BRASS') OR contains(p_name, '1')")
def filter_has(t):
    return from_("part", "p_partkey").filter(field("p_type").has("BRASS") | field("p_name").has(1)).pick("p_partkey", "p_name").batch(t)


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT o_orderpriority = '1-URGENT'")
def filter_and_or_not(t):
    return ORDERS.filter((field("o_orderstatus").eq("F") | (field("o_totalprice") > 200000)) & ~field("o_orderpriority").eq("1-URGENT")).pick("o_orderkey").batch(t)


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id)")
def filter_some(t):
    return DOCS.join(LABELS, "l", ("doc_id", "doc_id"), keeping=True).filter(some(field("l", "quality"))).batch(t).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def filter_not_equal_null(t):
    return DOCS.join(LABELS, "l", ("doc_id", "doc_id"), keeping=True).filter(field("l", "quality").ne(1)).batch(t).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 120000 AND o_orderstatus = 'O'")
def filter_param(t):
    least = Cell(120000)
    return ORDERS.where("o_totalprice", ">", least).filter(field("o_orderstatus").eq(param("status"))).pick("o_orderkey", "o_totalprice").batch(t, status="O")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
def filter_function(t):
    return ORDERS.filter(lambda get: get("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).pick("o_orderkey").batch(t)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS twice, l_quantity - 1 AS less, l_returnflag || '/' || l_linenumber AS tag FROM lineitem")
def pure_fields(t):
    q = LINES.with_(twice=field("l_quantity") * lit(2), less=field("l_quantity") - lit(1), tag=field("l_returnflag") + lit("/") + field("l_linenumber"))
    return q.batch(t).select("l_orderkey", "l_linenumber", "l_partkey", "twice", "less", "tag")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def pure_pick(t):
    return CUSTOMERS.pick("c_custkey", "c_mktsegment").batch(t)


@query("SELECT event_id, CASE WHEN value = 50 THEN 'x' ELSE 'y' END AS side, CASE WHEN value = 50 THEN 1 ELSE 0 END::BIGINT AS endless FROM events")
def math_div_guarded(t):
    df = EVENTS.with_(r=field("value") / (field("value") - lit(50))).batch(t)
    return df.select("event_id", F.when(F.col("r") == float("inf"), "x").otherwise("y").alias("side"), F.when(F.abs("r") == float("inf"), 1).otherwise(0).cast("long").alias("endless"))


# Joins.


@query("SELECT o_orderkey, c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return ORDERS.join(CUSTOMERS, "c", ("o_custkey", "c_custkey")).batch(t).select("o_orderkey", "c.c_custkey", "c.c_name", "c.c_mktsegment")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000 AND c_acctbal < 5000")
def join_inner_residual(t):
    q = ORDERS.join(CUSTOMERS, "c", ("o_custkey", "c_custkey"), residual=(field("o_totalprice") > 100000) & (field("c", "c_acctbal") < 5000))
    return q.batch(t).select("o_orderkey", "c.c_name")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_keeping(t):
    return DOCS.join(LABELS, "l", ("doc_id", "doc_id"), keeping=True).batch(t).select("doc_id", "l.quality")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def join_keeping_residual(t):
    return CUSTOMERS.join(ORDERS, "o", ("c_custkey", "o_custkey"), residual=field("o", "o_totalprice") > 250000, keeping=True).batch(t).select("c_custkey", "o.o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def join_multi_key(t):
    return CUSTOMERS.join(from_("supplier", "s_suppkey"), "s", [("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")]).batch(t).select("c_custkey", "s.s_suppkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_residual(t):
    n = from_("nation", "n_nationkey")
    return n.join(n, "o", ("n_regionkey", "n_regionkey"), residual=field("n_nationkey") < field("o", "n_nationkey")).batch(t).select(F.col("n_nationkey").alias("a"), F.col("o.n_nationkey").alias("b"))


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k FROM orders) SELECT o_orderkey, c_name FROM o LEFT JOIN customer ON k = c_custkey")
def join_null_keys(t):
    t["part_orders"] = t["orders"].select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k"))
    return from_("part_orders", "o_orderkey").join(CUSTOMERS, "c", ("k", "c_custkey"), keeping=True).batch(t).select("o_orderkey", "c.c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45")
def join_three_way(t):
    q = LINES.filter(field("l_quantity") > 45).join(ORDERS.join(CUSTOMERS, "c", ("o_custkey", "c_custkey")), "o", ("l_orderkey", "o_orderkey"))
    return q.batch(t).select("l_orderkey", "l_linenumber", "l_partkey", "o.o_orderstatus", "o.c.c_mktsegment")


# Aggregations.


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_count(t):
    return ORDERS.groupBy(["o_orderstatus", "o_orderpriority"], n=Count()).batch(t)


@query("SELECT l_returnflag, sum(l_quantity)::DOUBLE AS qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem GROUP BY 1")
def agg_sum(t):
    return LINES.groupBy("l_returnflag", qty=lambda g: g.sum("l_quantity"), price=lambda g: g.sum("l_extendedprice", "decimal(18,2)")).batch(t)


@query("SELECT o_custkey, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def agg_min_max(t):
    return ORDERS.groupBy("o_custkey", least=Min(field("o_totalprice")), most=Max(field("o_totalprice"))).batch(t)


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS ids FROM orders GROUP BY 1")
def agg_collect_ordered(t):
    df = ORDERS.groupBy("o_custkey", ids=Collect(field("o_orderkey"), (down("o_totalprice"),))).batch(t)
    return df.select("o_custkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS ids FROM orders GROUP BY 1")
def agg_collect_key_text(t):
    df = ORDERS.groupBy("o_custkey", rows=Collect()).batch(t)
    return df.select("o_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("ids"))


@query("SELECT o_orderstatus, bit_xor(o_orderkey) AS mark FROM orders GROUP BY 1")
def agg_custom(t):
    fold = Custom(F.lit(0).cast("long"), lambda held, row: held.bitwiseXOR(row["o_orderkey"]), join=lambda a, b: a.bitwiseXOR(b))
    return ORDERS.groupBy("o_orderstatus", mark=fold).batch(t)


@query("SELECT count(*) AS n, sum(l_quantity)::DOUBLE AS qty, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem")
def agg_whole_table(t):
    return LINES.fold(n=Count(), qty=Sum(field("l_quantity")), least=Min(field("l_quantity")), most=Max(field("l_quantity"))).batch(t)


@query("SELECT count(*) AS n, coalesce(sum(l_quantity), 0)::DOUBLE AS qty, max(l_quantity) AS most FROM lineitem WHERE l_quantity < 0")
def agg_whole_empty(t):
    return LINES.where("l_quantity", "<", 0).fold(n=Count(), qty=Sum(field("l_quantity")), most=Max(field("l_quantity"))).batch(t)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(t):
    return ORDERS.groupBy("o_custkey", n=Count()).where("n", ">", 12).batch(t)


# Unions and nested tables.


@query("SELECT id, price FROM (SELECT o_orderkey AS id, o_totalprice AS price FROM orders UNION ALL SELECT -1 - c_custkey, c_acctbal FROM customer)")
def union_disjoint(t):
    t["a"] = t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    t["b"] = t["customer"].select((-1 - F.col("c_custkey")).alias("id"), F.col("c_acctbal").alias("price"))
    return from_("a", "id").union(from_("b", "id")).batch(t, verify=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def expand_nested(t):
    q = LINES.groupBy("l_orderkey", lines=Collect()).expand("lines", "x", ("l_linenumber", "l_partkey", "l_shipdate"))
    return q.batch(t).select("l_orderkey", "x.l_linenumber", "x.l_partkey", "x.l_quantity")


# Ordered passes.

_RUNNING = "SELECT event_id, coalesce(sum(event_id % 7) OVER (ORDER BY ts, event_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS ahead, (sum(event_id % 7) OVER (ORDER BY ts, event_id::VARCHAR ROWS UNBOUNDED PRECEDING))::DOUBLE AS upto FROM events"
_STEP = EVENTS.with_(step=lambda get: get("event_id") % 7)


@query(f"SELECT event_id, ahead FROM ({_RUNNING})")
def scan_before(t):
    return _STEP.scan(up("ts"), "step", as_="ahead").batch(t).select("event_id", "ahead")


@query(f"SELECT event_id, upto FROM ({_RUNNING})")
def scan_through(t):
    return _STEP.scan(up("ts"), "step", through="upto").batch(t).select("event_id", "upto")


@query("SELECT o_orderkey, (100 + sum(o_orderkey % 10) OVER (ORDER BY o_totalprice DESC, o_orderkey::VARCHAR ROWS UNBOUNDED PRECEDING))::DOUBLE AS upto FROM orders")
def scan_desc_from(t):
    return ORDERS.with_(step=lambda get: get("o_orderkey") % 10).scan(down("o_totalprice"), "step", through="upto", start=100).batch(t).select("o_orderkey", "upto")


@query("WITH r AS (SELECT row_number() OVER (ORDER BY ts, event_id::VARCHAR) - 1 AS place, event_id::VARCHAR AS key, ahead FROM events JOIN (" + _RUNNING + ") USING (event_id)) SELECT place, key, (5000 - ahead)::DOUBLE AS into FROM r WHERE ahead <= 5000 ORDER BY place DESC LIMIT 1")
def ordering_at_point(t):
    return Ordering(_STEP.scan(up("ts"), "step").tree(), t).at(5000).withColumn("place", F.col("place").cast("long"))


@query("SELECT row_number() OVER (ORDER BY ts, event_id::VARCHAR) - 1 AS place, event_id::VARCHAR AS key, ahead AS \"offset\", upto AS \"end\" FROM events JOIN (" + _RUNNING + ") USING (event_id)")
def ordering_places(t):
    return Ordering(_STEP.scan(up("ts"), "step").tree(), t).rows.select(F.col("place").cast("long"), "key", "offset", "end")


@query("SELECT place FROM (SELECT row_number() OVER (ORDER BY ts, event_id::VARCHAR) - 1 AS place, event_id FROM events) WHERE event_id = 77")
def ordering_place_of(t):
    return Ordering(_STEP.scan(up("ts"), "step").tree(), t).place_of("77").select(F.col("place").cast("long"))


@query("SELECT sum(event_id % 7)::DOUBLE AS extent, count(*) AS size FROM events")
def ordering_extent(t):
    return Ordering(_STEP.scan(up("ts"), "step").tree(), t).extent()


# Keyed tables and their views.


def _orders(t, wins=None) -> Keyed:
    return Keyed(t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ("o_orderkey",), wins)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_slice(t):
    return views.Ordered(_orders(t), down("o_totalprice")).slice(10, 30).select("o_orderkey", "o_totalprice")


@query("SELECT rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders) WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def order_rank(t):
    last = t["orders"].agg(F.max("o_orderkey")).first()[0]
    return views.Ordered(_orders(t), down("o_totalprice")).rank(last)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def order_places(t):
    return views.Ordered(_orders(t), up("o_orderstatus"), down("o_totalprice")).placed().select("o_orderkey", F.col("place").cast("long"))


@query("SELECT count(*) FILTER (o_totalprice > 100000) AS count FROM orders")
def table_count_if(t):
    return _orders(t).count(field("o_totalprice") > 100000)


@query("SELECT sum(l_quantity * 2)::DOUBLE AS sum FROM lineitem")
def table_sum_by(t):
    return Keyed(t["lineitem"], LINE).sum_by(field("l_quantity") * lit(2))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -1 - c_custkey, c_custkey, 'N', c_acctbal FROM customer")
def table_apply_patch(t):
    held = _orders(t)
    fresh = t["customer"].select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"))
    put = held.df.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)).unionByName(fresh)
    return held.apply(put, held.df.filter("o_orderstatus = 'P'")).df


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'page' ELSE 'held' END AS origin FROM events WHERE event_type <> 'error'")
def table_replace_wins(t):
    held = Keyed(t["events"].select("event_id", F.lit("held").alias("origin"), F.lit(1).alias("rev")), ("event_id",), by_revision("rev"))
    page = t["events"].filter("event_type <> 'error'").select("event_id", F.lit("page").alias("origin"), F.when(F.col("user_id") % 2 == 0, 2).otherwise(0).alias("rev"))
    return held.replace(page).df.select("event_id", "origin")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'update' END AS what FROM orders WHERE o_orderstatus IN ('P', 'F') AND NOT (o_orderstatus = 'F' AND o_totalprice = 0)")
def table_changes_between(t):
    held = _orders(t)
    later = held.apply(held.df.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), held.df.filter("o_orderstatus = 'P'"))
    return held.changes_to(later).select(F.coalesce("prev.o_orderkey", "next.o_orderkey").alias("o_orderkey"), F.when(F.col("next").isNull(), "delete").when(F.col("prev").isNull(), "insert").otherwise("update").alias("what"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'leaves' ELSE 'enters' END AS what FROM orders WHERE (o_totalprice > 150000) <> (o_totalprice < 100000)")
def table_where_live(t):
    change = _orders(t).where_live(field("o_totalprice") > 150000, field("o_totalprice") < 100000)
    return change.select(F.coalesce("prev.o_orderkey", "next.o_orderkey").alias("o_orderkey"), F.when(F.col("next").isNull(), "leaves").otherwise("enters").alias("what"))


@query("SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders QUALIFY place < 10")
def lists_by_value(t):
    return views.lists_by(_orders(t), "o_orderstatus", (down("o_totalprice"),), (0, 10)).select("o_orderstatus", "o_orderkey", F.col("place").cast("long"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def list_for_value(t):
    return views.list_for(_orders(t), "o_custkey", "7", (up("o_totalprice"),)).select("o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def by_each(t):
    return views.by_each(_orders(t), "o_orderstatus", {"n": Count(), "most": Max(field("o_totalprice"))}, field("o_totalprice") > 1000)


@query("SELECT count(*) AS n, min(o_totalprice) AS least FROM orders WHERE o_orderstatus = 'F'")
def fold_where(t):
    return views.fold_all(_orders(t), {"n": Count(), "least": Min(field("o_totalprice"))}, views.has("o_orderstatus", "F"))


@query("SELECT p_partkey, row_number() OVER w - 1 AS place, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS \"offset\" FROM part WINDOW w AS (ORDER BY p_partkey)")
def offsets_line(t):
    return views.offsets(Keyed(t["part"], ("p_partkey",)), field("p_size")).select("p_partkey", F.col("place").cast("long"), "offset")


@query("SELECT l_returnflag, (l_orderkey // 32)::BIGINT AS block, sum(l_quantity)::DOUBLE AS part FROM lineitem GROUP BY 1, 2")
def blocks_parts(t):
    return views.blocks(t["lineitem"], "l_returnflag", "l_orderkey", F.sum("l_quantity"))


@query("SELECT l_returnflag, sum(l_quantity)::DOUBLE AS fold FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900 GROUP BY 1")
def blocks_range(t):
    return views.range_fold(t["lineitem"], "l_returnflag", "l_orderkey", 100, 900, F.sum("l_quantity"))


# Lineage.


@query("SELECT 'customer' AS source, '7' AS key UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM orders WHERE o_custkey = 7")
def why_join(t):
    keys = t["orders"].filter("o_custkey = 7").select(F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(",7]")))
    return why(ORDERS.join(CUSTOMERS, "c", ("o_custkey", "c_custkey")).tree(), t, keys)


@query("SELECT 'orders' AS source, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderstatus = 'P'")
def why_agg(t):
    return why(ORDERS.groupBy("o_orderstatus", n=Count()).tree(), t, "P")


# Logs, boards and sheets.


@query("SELECT count(*) AS total FROM documents WHERE contains(text, 'License')")
def log_search_total(t):
    return logs.search(t["documents"], "text", "License", "doc_id")[1]


@query("SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '^(click|view)$') ORDER BY event_id LIMIT 50")
def log_search_first(t):
    return logs.search(t["events"], "event_type", "^(click|view)$", "event_id", regex=True)[0].select("event_id", "event_type")


@query("SELECT bucket, coalesce(n, 0)::BIGINT AS n FROM range(20) r(bucket) LEFT JOIN (SELECT least(19, floor(value / 10))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1) USING (bucket)")
def log_histogram(t):
    return logs.histogram(t["events"], "value", 10)


@query("WITH h AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), e AS (SELECT log10(min(n) * 0.7) AS lo, log10(max(n)) AS hi FROM h) SELECT event_type, round(greatest(4, (log10(n) - lo) / (hi - lo) * 100), 6) AS height FROM h, e")
def bar_heights(t):
    counted = t["events"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return logs.bar_heights(counted, "n").select("event_type", F.round("height", 6).alias("height"))


@query("SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN -1 END), 0)::BIGINT AS held FROM orders GROUP BY 1")
def overlay_projection(t):
    notes = t["orders"].groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("kind"), F.lit(False).alias("stuck")))).alias("notes"))
    held = overlay.projected(F.lit(0).cast("long"), F.col("notes"), {"F": lambda h, n: h + 1, "O": lambda h, n: h - 1})
    return notes.select("o_custkey", held.alias("held"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY (o_orderkey <> last), o_orderkey) AS lane FROM orders JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1")
def lanes_board(t):
    boards = t["orders"].groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"), F.max("o_orderkey").alias("last"))
    note = F.struct(F.lit("place").alias("kind"), F.col("last").alias("id"), F.lit("all").alias("lane"), F.lit(0).alias("at"), F.lit(False).alias("stuck"))
    moved = overlay.laid(F.create_map(F.lit("all"), F.col("ids")), F.col("ids"), F.array(note))
    return boards.select("o_custkey", F.array_join(F.transform(moved["all"], lambda x: x.cast("string")), ",").alias("lane"))


@query("SELECT p_partkey, (p_partkey + p_size * 2 - (p_size % 7))::DOUBLE AS v FROM part")
def formula_row(t):
    cells = t["part"].select("p_partkey", F.col("p_partkey").alias("A"), F.col("p_size").alias("B"))
    return cells.select("p_partkey", formulas.compile_row("SUM(A1:B1) + B1 - MOD(B1, 7)", ["A", "B"]).alias("v"))


@query("SELECT sum(p_size)::DOUBLE AS \"SUM\", min(p_size)::DOUBLE AS \"MIN\", max(p_size)::DOUBLE AS \"MAX\", count(*) AS \"COUNT\" FROM part")
def formula_range(t):
    return formulas.range_folds(t["part"].select(F.col("p_size").cast("string").alias("text"))).select("SUM", "MIN", "MAX", "COUNT")


# Changes: the old answer with the derived change applied is the new answer.


def _changed(t, name: str, key: tuple[str, ...], old: DataFrame, node, columns: list) -> DataFrame:
    before, after = dict(t) | {name: old}, dict(t) | {name: t[name]}
    for other in TABLES:
        if other != name and other in ("customer", "orders", "lineitem"):
            before[other] = after[other] = t[other]
    change = Delta(before, after, {name: Keyed(old, key).changes_to(Keyed(after[name], key))})(node)
    held = compile_plan(node, before)
    gone = change.filter(F.col("prev").isNotNull()).select("prev.*")
    kept = held.withColumn("_k", key_column(held, node)).join(gone.select(key_column(gone, node).alias("_k")), "_k", "left_anti").drop("_k")
    return kept.unionByName(change.filter(F.col("next").isNotNull()).select("next.*")).select(*columns)


def _before(t) -> DataFrame:
    """Orders as they were: open ones cheaper, pending ones not there yet."""
    return t["orders"].filter("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") - 50000).otherwise(F.col("o_totalprice")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def delta_equals_batch_filter(t):
    return _changed(t, "orders", ("o_orderkey",), _before(t), ORDERS.where("o_totalprice", ">", 150000).tree(), ["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def delta_equals_batch_join(t):
    node = CUSTOMERS.join(ORDERS, "o", ("c_custkey", "o_custkey"), residual=field("o", "o_totalprice") > 250000, keeping=True).tree()
    return _changed(t, "orders", ("o_orderkey",), _before(t), node, ["c_custkey", "o.o_orderkey"])


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def delta_equals_batch_agg(t):
    node = ORDERS.groupBy("o_custkey", n=Count(), most=Max(field("o_totalprice"))).tree()
    return _changed(t, "orders", ("o_orderkey",), _before(t), node, ["o_custkey", "n", "most"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def delta_equals_batch_expand(t):
    node = ORDERS.groupBy("o_custkey", all=Collect()).expand("all", "x", "o_orderkey").tree()
    return _changed(t, "orders", ("o_orderkey",), _before(t), node, ["o_custkey", "x.o_orderkey", "x.o_totalprice"])


@query("SELECT o_orderkey, (sum(o_orderkey % 10) OVER (ORDER BY o_totalprice, o_orderkey::VARCHAR ROWS UNBOUNDED PRECEDING))::DOUBLE AS upto FROM orders")
def delta_equals_batch_scan(t):
    node = ORDERS.with_(step=lambda get: get("o_orderkey") % 10).scan(up("o_totalprice"), "step", through="upto").tree()
    return _changed(t, "orders", ("o_orderkey",), _before(t), node, ["o_orderkey", "upto"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def delta_netted(t):
    """Each order cheaper, then as it is, then finished ones gone: the net change by key."""
    row = lambda price: F.struct("o_orderkey", price.alias("o_totalprice"))
    o, none = t["orders"], F.lit(None).cast("struct<o_orderkey:bigint,o_totalprice:double>")
    first = o.select(none.alias("prev"), row(F.col("o_totalprice") - 1).alias("next"), F.lit(1).alias("seq"))
    second = o.select(row(F.col("o_totalprice") - 1).alias("prev"), row(F.col("o_totalprice")).alias("next"), F.lit(2).alias("seq"))
    third = o.filter("o_orderstatus = 'F'").select(row(F.col("o_totalprice")).alias("prev"), none.alias("next"), F.lit(3).alias("seq"))
    return netted(first.unionByName(second).unionByName(third), ["o_orderkey"]).select("next.*")


# Live relations and feeds: every one is told of its tables in three batches, in a folder of its own.


def _folder(t: Tables) -> str:
    """A new folder where all executors can write."""
    checkpointed(t.spark.range(1))  # sets the context's folder from the session's
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/live-{uuid.uuid4()}"


def _live(t: Tables, node, names: dict[str, str]) -> Live:
    """A live relation over the tables named (with their keys): a first third with other values, then everything as it is, then without every seventh row of the first table."""
    live = Live(t.spark, node, {n: t[n].schema for n in names}, _folder(t))
    third = lambda n: t[n].filter(F.col(names[n]) % 3 == 0)
    first = next(iter(names))
    number = next(f.name for f in t[first].schema if f.dataType.typeName() == "double")
    live.apply({n: (third(n).withColumn(number, F.lit(1e6)) if n == first else third(n), None) for n in names})
    live.apply({n: (t[n], None) for n in names})
    live.apply({first: (None, t[first].filter(F.col(names[first]) % 7 == 0).select(names[first]))})
    return live


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderkey % 7 <> 0")
def live_filter(t):
    return _live(t, ORDERS.where("o_totalprice", ">", 150000).tree(), {"orders": "o_orderkey"}).rows().select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000 WHERE o_orderkey % 7 <> 0")
def live_join(t):
    node = ORDERS.join(CUSTOMERS, "c", ("o_custkey", "c_custkey"), residual=field("o_totalprice") > 100000, keeping=True).tree()
    return _live(t, node, {"orders": "o_orderkey", "customer": "c_custkey"}).rows().select("o_orderkey", "c.c_name")


@query("SELECT o_custkey, count(*) AS n, sum(o_orderkey)::DOUBLE AS total FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def live_agg_running(t):
    return _live(t, ORDERS.groupBy("o_custkey", n=Count(), total=Sum(field("o_orderkey"))).tree(), {"orders": "o_orderkey"}).rows().select("o_custkey", "n", "total")


@query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def live_agg_recomputed(t):
    return _live(t, ORDERS.groupBy("o_orderstatus", n=Count(), most=Max(field("o_totalprice"))).tree(), {"orders": "o_orderkey"}).rows().select("o_orderstatus", "n", "most")


@query("SELECT p_partkey, (sum(p_size) OVER (ORDER BY p_partkey) - p_size)::DOUBLE AS ahead FROM part WHERE p_partkey % 7 <> 0")
def live_scan(t):
    return _live(t, from_("part", "p_partkey").scan(up("p_partkey"), "p_size", as_="ahead").tree(), {"part": "p_partkey"}).rows().select("p_partkey", "ahead")


@query(
    "SELECT 2 AS version, NULL::BIGINT AS prev_key, o_orderkey AS next_key FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 150000 "
    "UNION ALL SELECT 2, o_orderkey, CASE WHEN o_totalprice > 150000 THEN o_orderkey END FROM orders WHERE o_orderkey % 3 = 0 "
    "UNION ALL SELECT 3, o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice > 150000"
)
def live_changes_since(t):
    live = _live(t, ORDERS.where("o_totalprice", ">", 150000).tree(), {"orders": "o_orderkey"})
    return live.changes_since(1).select("version", F.col("prev.o_orderkey").alias("prev_key"), F.col("next.o_orderkey").alias("next_key"))


@query(
    "WITH b AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey::VARCHAR LIMIT 50), a AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey::VARCHAR LIMIT 50 OFFSET 20) "
    "SELECT 'left' AS what, p_partkey FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a) UNION ALL SELECT 'entered', p_partkey FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM b)"
)
def window_diff(t):
    """Equal prices stand by key as text, as in a scan; `Ordered` alone would put numbers in their own order."""
    columns = t["part"].columns
    line = views.Ordered(Keyed(t["part"].withColumn("_text", F.col("p_partkey").cast("string")), ("p_partkey",)), down("p_retailprice"), up("_text"))
    found = window_changes(line.slice(0, 50).select(*columns), line.slice(20, 70).select(*columns), ["p_partkey"])
    return found.select("what", "row.p_partkey")


def _feed(t: Tables, **options) -> Feed:
    return Feed(t.spark, _folder(t), t["part"].schema, ("p_partkey",), **options)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 5 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 5 <> 0")
def feed_take_lose(t):
    feed = _feed(t)
    feed.take(t["part"])
    feed.take(t["part"].filter("p_partkey % 2 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 5))
    feed.lose(t["part"].filter("p_partkey % 5 = 0").select("p_partkey"))
    return feed.rows().select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size < 20")
def feed_reset_and_reopened(t):
    feed = _feed(t)
    feed.take(t["part"].withColumn("p_retailprice", F.lit(0.0)))
    feed.reset(t["part"].filter("p_size < 20"))
    return Feed(t.spark, feed.folder, feed.schema, feed.key).rows().select("p_partkey", "p_retailprice")


@query("SELECT user_id, max(event_id) AS rev, max_by(event_type, event_id) AS status FROM events GROUP BY 1")
def rail_by_revision(t):
    """Pages and deltas in any order: an older revision never beats a newer one."""
    rows = t["events"].select("user_id", F.col("event_id").alias("rev"), F.col("event_type").alias("status"))
    empty = Keyed(rows.limit(0), ("user_id",), by_revision("rev"))
    newer, older = rows.filter("rev % 2 = 0"), rows.filter("rev % 2 = 1")
    return empty.put(newer).put(older).put(newer).df


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10 AND p_partkey % 3 <> 0")
def rail_page_then_delta(t):
    rev = lambda df, n: df.withColumn("rev", F.lit(n))
    page = rev(t["part"].filter("p_size > 10"), 2)
    held = Keyed(rev(t["part"], 1), ("p_partkey",), by_revision("rev")).replace(page)
    late = held.put(rev(t["part"].filter("p_size > 10").withColumn("p_retailprice", F.lit(-1.0)), 1))
    return late.drop(t["part"].filter("p_partkey % 3 = 0").select("p_partkey")).df.select("p_partkey", "p_retailprice")


# Ordered lines by key and by index.


@query("SELECT (coalesce(sum(p_size), 0))::DOUBLE AS \"offset\" FROM part WHERE p_partkey < 100")
def ordering_offset_of(t):
    return Ordering(from_("part", "p_partkey").scan(up("p_partkey"), "p_size", as_="b").tree(), t).offset_of("100")


@query("SELECT (sum(p_size) OVER (ORDER BY p_partkey) - p_size)::DOUBLE AS \"offset\" FROM part ORDER BY p_partkey LIMIT 1 OFFSET 42")
def ordering_offset_at(t):
    return Ordering(from_("part", "p_partkey").scan(up("p_partkey"), "p_size", as_="b").tree(), t).offset_at(42)


@query("SELECT p_partkey::VARCHAR AS key FROM part ORDER BY p_partkey LIMIT 1 OFFSET 17")
def ordering_key_at(t):
    return Ordering(from_("part", "p_partkey").scan(up("p_partkey"), "p_size", as_="b").tree(), t).key_at(17)


@query(
    "WITH l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_size::DOUBLE AS size FROM part), "
    "e AS (SELECT i, CASE WHEN i = 3 THEN 1000.0 ELSE size END AS size FROM l UNION ALL SELECT * FROM (VALUES (4.5, 7.0), (4.6, 8.0)) v(i, size)), "
    "n AS (SELECT row_number() OVER (ORDER BY i) - 1 AS j, size FROM e) "
    "SELECT (j - CASE WHEN j >= 10 THEN 2 ELSE 0 END)::BIGINT AS index, size, (sum(size) OVER (ORDER BY j) - size)::DOUBLE AS \"offset\" FROM n WHERE j NOT IN (8, 9)"
)
def line_edits(t):
    placed = views.offsets(Keyed(t["part"], ("p_partkey",)), field("p_size"))
    line = Line(placed.select(F.col("place").cast("long").alias("index"), F.col("measure").alias("size")))
    return line.measure(3, 1000.0).insert(5, [7.0, 8.0]).remove(8, 2).placed().select("index", "size", "offset")


# Books of calls and answers, as tables.


def _book(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", DONE).when(F.col("o_orderstatus") == "P", STUCK).otherwise(WAITING)
    return t["orders"].select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("lane"), state.alias("state"))


@query("SELECT 'owed' AS view, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'stuck', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'active', count(*) FROM orders WHERE o_orderstatus = 'O'")
def outbox_views(t):
    book = _book(t)
    counted = [f(book).agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n")) for name, f in (("owed", owed), ("stuck", stuck), ("active", active))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS arrived, min(o_orderkey)::DOUBLE AS at FROM orders GROUP BY 1")
def answers_status(t):
    answers = t["orders"].select("o_custkey", F.when(F.col("o_orderstatus") == "F", VALUE).otherwise(FAILED).alias("state"), F.col("o_orderkey").cast("double").alias("at"))
    return status_of(answers, "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND 1000 - o_orderkey <= 300")
def kept_readable(t):
    envelopes = t["orders"].select("o_orderkey", (F.col("o_orderkey") % 2).alias("v"), F.col("o_orderkey").cast("double").alias("at"), F.col("o_orderstatus").alias("value"))
    return readable(envelopes, 1, 1000.0, 300.0).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_partkey % 2 = 0 AND p_size = 1)")
def alike_maps(t):
    """Rows whose map of attributes equals what it was; every even part has one attribute more if its size is 1."""
    part = t["part"].withColumn("was", F.create_map(F.lit("size"), F.col("p_size")))
    now = F.when((F.col("p_partkey") % 2 == 0) & (F.col("p_size") == 1), F.create_map(F.lit("size"), F.col("p_size"), F.lit("odd"), F.lit(1))).otherwise(F.col("was"))
    part = part.withColumn("now", now)
    return part.filter(alike(["was"], ["now"], part)).select("p_partkey", "p_size")


@query(
    "SELECT o_orderstatus AS list, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders QUALIFY place < 5 "
    "UNION ALL SELECT 'all', o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders QUALIFY place < 5"
)
def lists_by_with_whole(t):
    return views.lists_by(_orders(t), "o_orderstatus", (down("o_totalprice"),), (0, 5), whole="all").select("list", "o_orderkey", F.col("place").cast("long"))
