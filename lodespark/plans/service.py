"""What surrounds the engine on one machine: finding bases, checks, workload admission, cancellation."""

from __future__ import annotations

import os
import stat
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from lodespark.errors import Cancelled, IndexUnavailable
from lodespark.plans.generations import MARK


def discover(start: str, name: str = ".lodespark") -> str | None:
    """The nearest store at or above a directory."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(f"{at}/{name}/{MARK}"):
            return f"{at}/{name}"
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def nested(root: str, name: str = ".lodespark") -> list[str]:
    """All stores below a directory."""
    return sorted(os.path.join(d, name) for d, dirs, _ in os.walk(root) if name in dirs and os.path.exists(os.path.join(d, name, MARK)))


def security_findings(store: str) -> list[str]:
    """Files of a store that others may write or read."""
    out = []
    for d, _, names in os.walk(store):
        for n in [".", *names]:
            mode = os.stat(os.path.join(d, n)).st_mode
            if mode & stat.S_IWOTH:
                out.append(f"others may write {os.path.relpath(os.path.join(d, n), store)}")
    return sorted(set(out))


def readiness(status: dict, missing: int = 0, stale: int = 0) -> dict:
    """Whether an index is there, fits the settings and the files; the first thing that isn't so is the reason."""
    reason = (
        "there is no index" if "generation" not in status else "the settings changed" if not status.get("ready") else "files are missing" if missing else "files are stale" if stale else "files failed" if status.get("errors") else None
    )
    return {"ready": reason is None, "reason": reason}


def upgrade_decision(installed: tuple[int, int, int], available: tuple[int, int, int], schema_changed: bool) -> str:
    """none, patch, minor, major or rebuild."""
    if available <= installed:
        return "none"
    if schema_changed:
        return "rebuild"
    return "major" if available[0] > installed[0] else "minor" if available[1] > installed[1] else "patch"


class Admission:
    """At most ``slots`` operations of a kind at once and ``waiting`` behind them."""

    def __init__(self, slots: int, waiting: int, timeout: float) -> None:
        self._slots, self._waiting, self.timeout = threading.Semaphore(slots), threading.Semaphore(slots + waiting), timeout

    @contextmanager
    def __call__(self) -> Iterator[None]:
        if not self._waiting.acquire(blocking=False):
            raise IndexUnavailable("too many operations wait")
        try:
            if not self._slots.acquire(timeout=self.timeout):
                raise IndexUnavailable("the operation waited too long")
            try:
                yield
            finally:
                self._slots.release()
        finally:
            self._waiting.release()


@contextmanager
def cancellable(spark: SparkSession, tag: str, seconds: float | None = None) -> Iterator[None]:
    """Jobs in the block carry a tag; ``spark.interruptTag(tag)`` or the time limit ends them as Cancelled."""
    sc, done = spark.sparkContext, threading.Event()
    sc.addJobTag(tag)
    timer = threading.Timer(seconds, lambda: (done.set(), sc.cancelJobsWithTag(tag))) if seconds else None
    if timer:
        timer.start()
    try:
        yield
    except Exception as e:
        if done.is_set():
            raise Cancelled(f"stopped after {seconds} seconds", cause=e) from e
        raise
    finally:
        if timer:
            timer.cancel()
        sc.removeJobTag(tag)


def preview_limit(most_bytes: int) -> int:
    """How many items a preview of a byte budget shows."""
    return max(1, min(200, most_bytes // 512))
