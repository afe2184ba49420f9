import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from keelson.cells import Derived, Family, Port, Watch, batch, journal, untracked
from keelson.commands import Command, Whenever, when
from keelson.functions.expr import field
from keelson.plans.builder import from_
from keelson.sources.loader import Kept, load_keys


def test_equal_results_stop_the_wave():
    a, runs, seen = Port(1, "a"), [], []
    odd = Derived(lambda: runs.append(1) or a.get() % 2)
    w = Watch(lambda: seen.append(odd.get()))
    a.set(3)
    assert seen == [1] and len(runs) == 2
    a.set(4)
    assert seen == [1, 0]
    a.set(4)
    assert len(runs) == 3 and journal.counts["set"] >= 2
    w.stop()
    a.set(5)
    assert seen == [1, 0] and odd.get() == 1


def test_batches_and_untracked_reads():
    a, b, seen = Port(1), Port(10), []

    def look():
        with untracked():
            quiet = b.get()
        seen.append((a.get(), quiet))

    Watch(look)
    b.set(11)
    with batch():
        a.set(2)
        a.set(3)
    assert seen == [(1, 10), (3, 11)]


def test_a_watcher_that_wakes_itself_is_stopped():
    a = Port(0)
    Watch(lambda: None)
    with pytest.raises(RecursionError):
        Watch(lambda: a.get() and a.set(a.get() + 1))
        a.set(1)


def test_families_let_the_least_used_go():
    made = []
    f = Family(lambda k: made.append(k) or Port(k), most=2)
    for k in (1, 2, 1, 3, 1, 2):
        assert f[k].get() == k
    assert made == [1, 2, 3, 2]


def test_ports_fill_holes(spark):
    t = {"n": spark.range(10)}
    least = Port(7)
    q = from_("n", "id").where("id", ">=", 0)
    answer = Derived(lambda: q.filter(field("id") >= least.get()).batch(t).count())
    assert answer.get() == 3
    least.set(9)
    assert answer.get() == 1


def test_commands(spark):
    slow = Command(spark, lambda n: spark.range(n).filter("id >= 0").count(), "queue")
    assert slow(10) and slow(20)
    slow.wait()
    assert sorted(slow.results) == [10, 20]
    drop = Command(spark, lambda: time.sleep(0.5), "drop")
    assert drop() and not drop()
    with pytest.raises(ValueError):
        Command(spark, print, "other")


def test_waiting():
    tries = iter([0, None, 5])
    assert when(lambda: next(tries), sleep=lambda s: None) == 5
    with pytest.raises(TimeoutError):
        when(lambda: False, seconds=0, sleep=lambda s: None)


def test_loader_is_a_data_source(spark):
    df = load_keys(spark, "letters", lambda k: [(k, i) for i in range(len(k))], "k string, i int", ["a", "bb"])
    assert sorted(map(tuple, df.collect())) == [("a", 0), ("bb", 0), ("bb", 1)]


def test_kept_values(spark, tmp_path):
    k = Kept(spark, str(tmp_path / "k"), version=2, most_age=10, migrate=lambda v, x: x.upper() if v == 1 else None)
    k.save("b", 5.0)
    assert k.load(8.0) == "b" and k.load(80.0) is None
    Kept(spark, str(tmp_path / "k"), version=1).save("a", 5.0)
    assert k.load(8.0) == "A"
    Kept(spark, str(tmp_path / "k"), version=0).save("z", 5.0)
    assert k.load(8.0) is None


def test_the_package_reaches_workers_that_start_elsewhere(tmp_path):
    """A session started away from the repository, as on a cluster, still runs Python code of the package."""
    root = Path(__file__).parent.parent
    script = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from keelson.shipping import ship\n"
        "from keelson.errors import PlanError\n"
        "ship(spark); ship(spark)\n"
        "def name(batches):\n"
        "    import keelson.errors\n"
        "    for b in batches:\n"
        "        keelson.errors.PlanError\n"
        "        yield b\n"
        "print('rows', spark.range(3).mapInArrow(name, 'id long').count(), PlanError.__name__)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3 PlanError" in done.stdout, done.stderr[-2000:]


def test_a_cell_that_reads_itself_is_named():
    from keelson.cells import CycleError

    a = Derived(lambda: b.value, "a")
    b = Derived(lambda: a.value + 1, "b")
    with pytest.raises(CycleError, match="a -> b -> a"):
        a.get()


def test_a_failure_is_held_for_all_readers():
    runs, p = [], Port(0)

    def fails():
        runs.append(1)
        return 1 / p.value

    a = Derived(fails)
    b = Derived(lambda: a.value + 1)
    for x in (a, b, a, b):
        with pytest.raises(ZeroDivisionError):
            x.get()
    assert len(runs) == 1
    p.set(2)
    assert b.get() == 1.5 and len(runs) == 2


def test_nothing_kept_is_nothing(spark, tmp_path):
    assert Kept(spark, str(tmp_path / "none")).load(1.0) is None


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from keelson.operators import running

    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        running.checkpointed(SimpleNamespace(sparkSession=session))


def test_whenever_a_test_turns_true():
    state, calls = [False], []
    w = Whenever(lambda: state[0], lambda: calls.append(1))
    assert not w.look()
    state[0] = True
    assert w.look() and not w.look() and calls == [1]
    state[0] = False
    w.look()
    state[0] = True
    w.start(0.01)
    when(lambda: len(calls) == 2, 5)
    w.stop()
