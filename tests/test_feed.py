import pytest

import random

from keelson.functions.expr import field
from keelson.functions.folds import down
from keelson.operators.keyed import by_revision
from keelson.operators.line import Line
from keelson.sources.outbox import Outbox
from keelson.streaming.feed import Feed

SCHEMA = "id long, score double, rev long"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_a_feed_takes_loses_and_resets(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SCHEMA, ("id",), by_revision("rev"))
    held = lambda: sorted(tuple(r) for r in feed.rows().collect())
    assert feed.take(rows(spark, (1, 5.0, 1), (2, 7.0, 1), (3, 9.0, 3))).count() == 3
    assert feed.take(rows(spark, (1, 6.0, 2), (3, 0.0, 2))).count() == 1  # the older revision of 3 loses
    assert held() == [(1, 6.0, 2), (2, 7.0, 1), (3, 9.0, 3)]
    assert feed.lose(spark.createDataFrame([(2,), (99,)], "id long")).count() == 1
    assert feed.feed(rows(spark, (4, 1.0, 1)), spark.createDataFrame([(1,)], "id long")).count() == 2
    assert held() == [(3, 9.0, 3), (4, 1.0, 1)]
    feed.reset(rows(spark, (3, 2.0, 1), (5, 8.0, 1)))  # a snapshot owns membership, the revision owns content
    assert held() == [(3, 9.0, 3), (5, 8.0, 1)]
    assert feed.peek(5)["score"] == 8.0 and feed.peek(1) is None
    assert feed.size().first()[0] == 2 and feed.count(field("score") > 8).first()[0] == 1 and feed.sum_by(field("score")).first()[0] == 17.0
    assert [r["id"] for r in feed.sorted_by(down("score")).slice(0, 1).collect()] == [3]
    assert [r["id"] for r in feed.only(field("score") < 9).df.collect()] == [5]
    assert feed.only_live(field("score") > 8, field("score") < 9).count() == 2
    assert [c.count() for c in feed.changes_since(3)] == [2, 2]


def test_the_live_half_runs_while_somebody_looks(spark, tmp_path):
    said = []

    def live(give):
        said.append("start")
        give(rows(spark, (1, 1.0, 1)))
        return lambda: said.append("stop")

    feed = Feed(spark, str(tmp_path), SCHEMA, ("id",), live=live)
    one, two = feed.look(), feed.look()
    one()
    one()
    assert said == ["start"] and feed.rows().count() == 1
    two()
    assert said == ["start", "stop"]


def test_a_line_follows_its_edits(spark):
    rng, sizes = random.Random(4), [3.0, 0.0, 5.0, 2.0]
    line = Line.of(spark, sizes)
    for _ in range(6):
        i = rng.randrange(len(sizes))
        match rng.randrange(3):
            case 0:
                sizes[i], line = 4.0, line.measure(i, 4)
            case 1:
                sizes[i:i], line = [1.0, 6.0], line.insert(i, [1, 6])
            case 2:
                line = line.remove(i, 2)
                del sizes[i : i + 2]
    assert [(r["index"], r["size"], r["offset"]) for r in sorted(line.placed().collect())] == [(i, s, sum(sizes[:i])) for i, s in enumerate(sizes)]
    assert tuple(line.total().first()) == (sum(sizes), len(sizes))
    assert line.offset_of(2).first()[0] == sum(sizes[:2])


def test_points_of_a_line(spark):
    line = Line.of(spark, [3, 5, 2])
    assert [tuple(line.at(p).first()) for p in (-2, 0, 3, 7.5, 30)] == [(0, -2.0), (0, 0.0), (1, 0.0), (1, 4.5), (2, 22.0)]
    assert tuple(line.replace([]).at(3).first()) == (-1, 0.0) and line.replace([]).total().first()[0] == 0.0
    assert line.measure(9, 1).df.count() == 3


def test_a_held_book_sends_nothing():
    def send(entry):
        if entry.args == "no":
            raise ValueError("refused")

    box = Outbox(send, classify=lambda e: "permanent")
    box.pause()
    box.offer("a", "x", "rename", "yes")
    box.offer("b", "y", "rename", "no")
    assert box.step() == 0 and box.pending(lambda e: e.lane) == {"x", "y"}
    assert box.resume() == 1 and box.pending(lambda e: e.lane) == set()
    assert box.refused.id == "b" and box.refused.error == "refused"


def test_a_feed_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    from keelson.streaming import feed as module

    new = lambda: Feed(spark, str(tmp_path), "id long, v string", ("id",))
    rows = lambda *some: spark.createDataFrame(list(some), "id long, v string")
    feed = new()
    feed.take(rows((1, "a"), (2, "b")))
    feed.lose(spark.createDataFrame([(2,)], "id long"))
    again = new()
    assert again.version == 2 and [tuple(r) for r in again.rows().collect()] == [(1, "a")]
    with monkeypatch.context() as m:
        m.setattr(module, "COMMIT", "no such type")
        with pytest.raises(Exception):
            again.take(rows((9, "lost")))
    third = new()
    third.take(rows((3, "c")))
    assert third.version == 3 and sorted(tuple(r) for r in new().rows().collect()) == [(1, "a"), (3, "c")]
