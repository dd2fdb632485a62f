"""Runs of a source's sync: one at a time for each source, retried, held, paused, stopped and recorded."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..sources.registry import TransientError

FIRST_WAIT, LONGEST = 20.0, 3600.0
EVENT = "id string, source string, state string, kind string, clean boolean, stats_json string, error string, started_at string, ended_at string"


class Stopped(Exception):
    """A run was told to stop."""


@dataclass
class Run:
    source: str
    kind: str = "sync"
    clean: bool = False
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "running"
    phase: str = ""
    done: int = 0
    total: int | None = None
    error: str = ""
    started_at: str = ""
    ended_at: str | None = None
    log: list[str] = field(default_factory=list)
    gate: threading.Event = field(default_factory=threading.Event)
    cancelled: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self):
        self.gate.set()

    def check(self) -> None:
        """Waits while the run is paused; raises where it was stopped."""
        self.gate.wait()
        if self.cancelled.is_set():
            raise Stopped

    def stage(self, phase: str, done: int = 0, total: int | None = None) -> None:
        self.check()
        self.phase, self.done, self.total = phase, done, total
        self.log.append(self.line())

    def line(self) -> str:
        share = f" · {100 * self.done // self.total}%" if self.total else ""
        return f"{self.phase} {self.done}/{self.total}{share}" if self.total else f"{self.phase} {self.done}" if self.done else self.phase


class Runs:
    """Starts runs in threads, and keeps their history. clock, sleep and now may be given, for tests."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[Run, float], None] | None = None, now: Callable[[], str] = lambda: datetime.now(UTC).isoformat(), listen: Callable[[Run], None] = lambda run: None):
        self.clock, self.now, self.listen = clock, now, listen
        self.sleep = sleep or (lambda run, seconds: run.cancelled.wait(seconds))
        self.runs: dict[str, Run] = {}
        self.lock = threading.Lock()

    def start(self, source: str, work: Callable[[Run], object], kind: str = "sync", clean: bool = False, wait: bool = False) -> Run:
        """Runs work(run); an error where the source has an active run."""
        with self.lock:
            if any(r.source == source and r.ended_at is None for r in self.runs.values()):
                raise RuntimeError(f"{source} is already running")
            run = Run(source, kind, clean, started_at=self.now())
            self.runs[run.id] = run
        self.listen(run)
        thread = threading.Thread(target=self._work, args=(run, work), daemon=True)
        thread.start()
        if wait:
            thread.join()
        return run

    def _work(self, run: Run, work: Callable[[Run], object]) -> None:
        try:
            self._retried(run, work)
            run.check()
            run.state = "done"
        except Stopped:
            run.state = "stopped"
        except Exception as e:  # recorded, as nobody waits for the thread
            run.state, run.error = "failed", str(e)
        run.ended_at = self.now()
        self.listen(run)

    def _retried(self, run: Run, work: Callable[[Run], object]) -> None:
        """Transient failures are tried again after waits that double, for an hour; then the run is held until it is resumed or stopped."""
        wait, since = FIRST_WAIT, None
        while True:
            run.check()
            try:
                work(run)
                return
            except (TransientError, ConnectionError, TimeoutError) as e:
                now = self.clock()
                since = now if since is None else since
                if now - since >= LONGEST:
                    run.state = "paused"
                    run.gate.clear()
                    run.log.append(f"held after an hour of failures: {e}")
                    self.listen(run)
                    run.check()
                    run.state, wait, since = "running", FIRST_WAIT, None
                    continue
                run.state = "retrying"
                run.log.append(f"trying again in {min(wait, LONGEST - (now - since)):.0f} s: {e}")
                self.listen(run)
                self.sleep(run, min(wait, LONGEST - (now - since)))
                wait *= 2
                run.check()
                run.state = "running"

    def pause(self, run: Run) -> None:
        run.state = "paused"
        run.gate.clear()
        self.listen(run)

    def resume(self, run: Run) -> None:
        run.state = "running"
        run.gate.set()
        self.listen(run)

    def stop(self, run: Run) -> None:
        run.state = "stopping"
        run.cancelled.set()
        run.gate.set()

    def events(self, spark: SparkSession) -> DataFrame:
        rows = [(r.id, r.source, r.state, r.kind, r.clean, "", r.error, r.started_at, r.ended_at) for r in self.runs.values()]
        return spark.createDataFrame(rows, EVENT)

    def revive(self, events: DataFrame, work: Callable[[str], Callable[[Run], object]]) -> list[Run]:
        """Starts again what a former process left paused; the others that it left are to be recorded as interrupted."""
        left = events.where("ended_at is null and state = 'paused'").select("source", "kind").distinct().collect()  # a row per source
        return [self.start(r.source, work(r.source), r.kind) for r in left]


def every(seconds: float, tick: Callable[[], object], stop: threading.Event, clock: Callable[[], float] = time.monotonic) -> int:
    """Calls tick every so many seconds until stopped, never twice at once; calls that a long one missed are not made up for. The number of calls."""
    calls, due = 0, clock()
    while not stop.is_set():
        if clock() >= due:
            tick()
            calls += 1
            due = max(due + seconds, clock())
        stop.wait(max(0.0, min(seconds, due - clock())))
    return calls
