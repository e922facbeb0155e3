"""Spark jobs side by side from one driver: a bounded pool that gathers failures, keyed jobs that can be awaited and cancelled."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor, wait
from functools import wraps

from pyspark.sql import SparkSession


class JobError(RuntimeError):
    """A job that can't start, or jobs that failed (`failures`: item and exception)."""

    def __init__(self, text: str, failures: Iterable[tuple] = ()):
        super().__init__(text)
        self.failures = list(failures)


class BoundedPool:
    """Runs a function over items with at most `workers` at once. One invocation at a time; failures don't stop the others."""

    def __init__(self, workers: int = 4):
        self.workers, self._busy = workers, threading.Lock()

    def invoke(self, f: Callable, items: Iterable) -> list:
        """Results in order of the items; JobError with all failures once the last item is done."""
        if not self._busy.acquire(blocking=False):
            raise JobError("the pool is at work")
        try:
            items = list(items)
            with ThreadPoolExecutor(self.workers) as pool:
                done = [pool.submit(f, x) for x in items]
            failures = [(x, d.exception()) for x, d in zip(items, done) if d.exception() is not None]
            if failures:
                raise JobError(f"{len(failures)} of {len(items)} failed", failures)
            return [d.result() for d in done]
        finally:
            self._busy.release()


class KeyedJobs:
    """Jobs by key, each in a Spark job group of its own."""

    def __init__(self, spark: SparkSession, workers: int = 4):
        self.spark, self.pool, self.jobs = spark, ThreadPoolExecutor(workers), {}
        self._lock = threading.Lock()

    def submit(self, key: str, f: Callable, *args) -> Future:
        """Start f; a key that is still at work is an error."""

        def run():
            self.spark.sparkContext.setJobGroup(f"keyed-{key}", key, interruptOnCancel=True)
            return f(*args)

        with self._lock:
            if (old := self.jobs.get(key)) is not None and not old.done():
                raise JobError(f"{key} is at work")
            self.jobs[key] = self.pool.submit(run)
            return self.jobs[key]

    def busy(self) -> list[str]:
        return [k for k, f in self.jobs.items() if not f.done()]

    def wait_until(self, most: int = 0, seconds: float = 60.0) -> None:
        """Until at most so many are at work; when time is up the rest are cancelled, and JobError names them."""
        end = time.monotonic() + seconds
        while len(left := self.busy()) > most:
            if time.monotonic() > end:
                for key in left:
                    self.cancel(key)
                raise JobError(f"cancelled after {seconds} s: {left}")
            wait([self.jobs[k] for k in left], timeout=min(0.2, max(0.0, end - time.monotonic())), return_when="FIRST_COMPLETED")

    def cancel(self, key: str) -> None:
        self.jobs[key].cancel()
        self.spark.sparkContext.cancelJobGroup(f"keyed-{key}")

    def close(self) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)


def once(f: Callable) -> Callable:
    """f, computed at its first call alone, whatever threads call it; a call that fails may be repeated."""
    lock, made = threading.Lock(), []

    @wraps(f)
    def get():
        if not made:
            with lock:
                if not made:
                    made.append(f())
        return made[0]

    return get
