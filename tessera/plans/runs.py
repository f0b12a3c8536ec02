"""Runs that count while they work, tell how far they are, and can be cancelled."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation

from tessera.sources.tables import publish


class Run:
    """One job: rows of a plan are published, and counters of rows that pass through are known when it ends.

    Counters are observed by Spark while the rows go by, so nothing is read twice. ``cancel`` interrupts the run's Spark jobs by
    their tag; a cancelled or failed run publishes nothing.
    """

    def __init__(self, df: DataFrame, path: str, tag: str | None = None, **counters: Column):
        """counters: aggregates over the rows of df, by name."""
        self.path, self.tag = path, tag or f"run-{uuid.uuid4().hex}"
        self.sc, self.observed = df.sparkSession.sparkContext, Observation(self.tag)
        self.df = df.observe(self.observed, *(c.alias(n) for n, c in counters.items())) if counters else df
        self.counted, self.version, self.error = bool(counters), None, None
        self.thread: threading.Thread | None = None

    def _work(self) -> None:
        self.sc.addJobTag(self.tag)
        try:
            self.version = publish(self.df, self.path)
        except Exception as e:
            self.error = e
        finally:
            self.sc.removeJobTag(self.tag)

    def start(self) -> Run:
        from pyspark import InheritableThread

        self.thread = InheritableThread(target=self._work)
        self.thread.start()
        return self

    def progress(self) -> float:
        """The share of tasks that have ended, of the stages known so far; 1 when the run is over."""
        if self.thread is not None and not self.thread.is_alive():
            return 1.0
        status = self.sc.statusTracker()
        stages = [status.getStageInfo(s) for s in status.getActiveStageIds()]
        total = sum(s.numTasks for s in stages if s)
        return min(0.99, sum(s.numCompletedTasks for s in stages if s) / total) if total else 0.0

    def cancel(self) -> None:
        self.sc.cancelJobsWithTag(self.tag)

    def wait(self, timeout: float | None = None) -> dict:
        """The counters, once the run has ended; its error is raised here."""
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError(self.tag)
        if self.error is not None:
            raise self.error
        return dict(self.observed.get) if self.counted else {}
