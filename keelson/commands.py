"""Commands that run Spark jobs, one at a time each, and waiting for conditions."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Command:
    """Runs `work` in a thread under a tag of its own. While it runs, a new call is dropped ("drop"), stops
    the running one and its Spark jobs ("restart"), or waits ("queue")."""

    def __init__(self, spark: SparkSession, work: Callable[..., Any], policy: str = "drop"):
        if policy not in ("drop", "restart", "queue"):
            raise ValueError(f"no such policy: {policy}")
        self.spark, self.work, self.policy = spark, work, policy
        self._lock, self._thread, self._tag = threading.Lock(), None, None
        self.results: list[Any] = []
        self.errors: list[Exception] = []

    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def __call__(self, *args) -> bool:
        """Start, or not, as the policy says; tells whether it started."""
        with self._lock:
            if self.running():
                if self.policy == "drop":
                    return False
                if self.policy == "restart":
                    self.cancel()
                else:
                    self._thread.join()
            self._tag = f"keelson-{uuid.uuid4()}"
            self._thread = threading.Thread(target=self._run, args=(self._tag, args), daemon=True)
            self._thread.start()
            return True

    def _run(self, tag: str, args: tuple) -> None:
        self.spark.addTag(tag)
        try:
            out = self.work(*args)
            if self._tag == tag:
                self.results.append(out)
        except Exception as e:  # noqa: BLE001
            self.errors.append(e)
        finally:
            self.spark.removeTag(tag)

    def cancel(self) -> None:
        tag, self._tag = self._tag, None
        if tag:
            self.spark.interruptTag(tag)

    def wait(self, seconds: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(seconds)


class Whenever:
    """Runs a command each time `test` turns true (is true, and was not when last looked at); `look` is called by whoever drives it, or `every` seconds by `start`.

    What happens while the command still runs is the command's policy: drop, restart or queue.
    """

    def __init__(self, test: Callable[[], Any], command: Callable[[], Any]):
        self.test, self.command, self.was, self._ended = test, command, False, threading.Event()

    def look(self) -> bool:
        """Whether the test has just turned true, in which case the command was called."""
        now, turned = bool(self.test()), False
        if now and not self.was:
            turned = True
            self.command()
        self.was = now
        return turned

    def start(self, every: float = 0.05) -> Whenever:
        def run():
            while not self._ended.wait(every):
                self.look()

        threading.Thread(target=run, daemon=True).start()
        return self

    def stop(self) -> None:
        self._ended.set()


def when(test: Callable[[], Any], seconds: float = 60.0, every: float = 0.05, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The first true value of test, asked again and again; TimeoutError if there is none in time."""
    end = clock() + seconds
    while not (value := test()):
        if clock() >= end:
            raise TimeoutError("the condition did not come true in time")
        sleep(every)
    return value
