"""The job state machine over a stream of attempted transitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from rasterweave.operators.jobs import ALLOWED, TERMINAL, run_events

OUTPUT = (
    "job_id BIGINT, seq BIGINT, ts TIMESTAMP, from_state STRING, to_state STRING, "
    "accepted BOOLEAN, rejected STRING, revision INT"
)
_COLUMNS = [part.strip().split(" ")[0] for part in OUTPUT.split(",")]
#: stands for a missing time or number on the way to Python, where NULL would turn integers into floats
MISSING = -(2**63)
#: A job alone costs some milliseconds of calls and small frames, so the jobs of a bucket are handled and kept together.
BUCKETS = 1024


def _problem(state: str | None, last: int | None, ts: int | None, target: str) -> str | None:
    """Why an attempt is rejected, NULL if it is accepted."""
    options = ("queued",) if state is None else ALLOWED[state]
    if state in TERMINAL:
        return "terminal"
    if target not in options:
        return "illegal"
    return "late" if last is not None and ts is not None and ts < last else None


def _bucketed(events: DataFrame, buckets: int, *more: str) -> DataFrame:
    """Attempts with whole numbers only, times in microseconds; jobs without an id have a bucket of their own."""
    whole = lambda c: F.coalesce(c, F.lit(MISSING))
    job = F.col("job_id").cast("long")
    return events.select(
        F.when(job.isNull(), -1).otherwise(F.pmod(F.xxhash64(job), F.lit(buckets))).cast("int").alias("bucket"),
        F.coalesce(job, F.lit(0)).alias("job_id"), whole(F.col("seq").cast("long")).alias("seq"),
        whole(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), "to_state", *more,
    )


def _attempts(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """``job_id, seq, ts, to_state`` of one trigger's attempts, by job and in order; what has no number comes last."""
    parts = [(f["job_id"].to_numpy(), f["seq"].to_numpy(), f["at"].to_numpy(), f["to_state"].to_numpy(dtype=object)) for f in frames]
    job, seq, at, target = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((seq, seq == MISSING, job))
    known = lambda values: (None if v == MISSING else v for v in values[order].tolist())
    jobs = job[order].tolist() if key[0] >= 0 else [None] * len(order)
    return zip(jobs, known(seq), known(at), target[order].tolist())


def _outcomes(rows: list[tuple]) -> pd.DataFrame:
    found = dict(zip(_COLUMNS, zip(*rows))) if rows else {c: () for c in _COLUMNS}
    kinds = {"job_id": "Int64", "seq": "Int64", "ts": "Int64", "accepted": "bool", "revision": "int32"}
    return pd.DataFrame({c: pd.Series(list(found[c]), dtype=kinds.get(c, "object")) for c in _COLUMNS})


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros("ts"))


_MICROS = OUTPUT.replace("TIMESTAMP", "BIGINT")
_STATE = "job ARRAY<BIGINT>, state ARRAY<STRING>, ts ARRAY<BIGINT>, revision ARRAY<INT>"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps current state, last accepted time and revision of every job of a bucket."""
    jobs = {job: known for job, *known in zip(*kept.get)} if kept.exists else {}
    out = []
    for job, seq, ts, target in _attempts(key, frames):
        before, last, revision = jobs.get(job, (None, None, -1))
        problem = _problem(before, last, ts, target)
        if problem is None:
            revision += 1
            jobs[job] = (target, ts, revision)
        out.append((job, seq, ts, before, target, problem is None, problem, revision))
    if jobs:
        kept.update((list(jobs), *map(list, zip(*jobs.values()))))
    yield _outcomes(out)


def job_outcomes(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Accepted and rejected attempts of a stream of ``job_id, seq, ts, to_state``.

    ``seq`` must not go backwards between triggers; within one it may arrive in any order. Jobs share
    ``buckets`` groups, whose number must stay when a stream is continued; a trigger rewrites the states of the
    buckets that it touches. Limit the rows of a trigger at the source to bound a busy job.
    """
    rows = _bucketed(events, buckets).groupBy("bucket")
    return _timed(rows.applyInPandasWithState(_advance, _MICROS, _STATE, "append", "NoTimeout"))


class _OrderedJob:
    """As :func:`_advance`, for one job whose attempts come in any order, with times for what never comes.

    An attempt is judged when all before it have been; until then it waits. By the watermark, a gap that
    nothing fills is given up, a job that stands still is reported once per state, and a finished job leaves.
    """

    __slots__ = ("job_id", "state", "last", "revision", "turn", "reported", "held", "due", "_limits", "_out")

    def __init__(self, job_id, limits: tuple, out: list, state=None, last=None, revision=-1, turn=None, reported=False, due=None) -> None:
        self.job_id, self.state, self.last, self.revision, self.reported, self.due = job_id, state, last, revision, reported, due
        self.turn = limits[0] if turn is None else turn
        self.held, self._limits, self._out = {}, limits, out

    def _emit(self, seq, ts, target, problem: str | None, before: str | None) -> None:
        self._out.append((self.job_id, seq, ts, before, target, problem is None, problem, self.revision))

    def _judge(self, seq: int, ts: int | None, target: str) -> None:
        before = self.state
        problem = "incomplete" if ts is None else _problem(before, self.last, ts, target)
        if problem is None:
            self.state, self.last = target, ts
            self.revision, self.reported = self.revision + 1, False
        self.turn = seq + 1
        self._emit(seq, ts, target, problem, before)

    def _drain(self) -> None:
        while self.turn in self.held:
            self._judge(self.turn, *self.held.pop(self.turn))

    def _given_up(self) -> int | None:
        """When the first gap is given up; an attempt without a time waits for no one."""
        return min((0 if ts is None else ts // 1000 + self._limits[1] for ts, _ in self.held.values()), default=None)

    def take(self, seq: int | None, ts: int | None, target: str) -> None:
        if seq is None:
            self._emit(None, ts, target, "incomplete", self.state)
        elif seq < self.turn or seq in self.held:
            self._emit(seq, ts, target, "missed", self.state)
        elif seq == self.turn:
            self._judge(seq, ts, target)
            self._drain()
        else:
            self.held[seq] = (ts, target)

    def settle(self) -> None:
        """Note when something happens by itself, in milliseconds."""
        due = [at for at in [self._given_up()] if at is not None]
        if self.state in TERMINAL:
            due.append(self.last // 1000 + self._limits[3])
        elif self.state is not None and not self.reported:
            due.append(self.last // 1000 + self._limits[2])
        self.due = min(due, default=None)

    def expire(self, now: int) -> bool:
        """What is due by the watermark; true if the job leaves the state."""
        while self.held and self._given_up() <= now:
            self.turn = min(self.held)
            self._drain()
        if self.state in TERMINAL:
            return not self.held and self.last // 1000 + self._limits[3] <= now
        if self.state is not None and not self.reported and self.last // 1000 + self._limits[2] <= now:
            self.reported = True
            self._emit(None, self.last, None, "stalled", self.state)
        return False


_KEPT = ("job_id", "state", "last", "revision", "turn", "reported", "due")
# what waits is kept beside the jobs, by the place of its job
_ORDERED_STATE = (
    "job ARRAY<BIGINT>, state ARRAY<STRING>, ts ARRAY<BIGINT>, revision ARRAY<INT>, turn ARRAY<BIGINT>, reported ARRAY<BOOLEAN>, "
    "due ARRAY<BIGINT>, early_place ARRAY<INT>, early_seq ARRAY<BIGINT>, early_ts ARRAY<BIGINT>, early_state ARRAY<STRING>"
)


def _load(kept: GroupState, limits: tuple, out: list) -> dict:
    if not kept.exists:
        return {}
    held = kept.get
    jobs = [_OrderedJob(job, limits, out, *rest) for job, *rest in zip(*held[: len(_KEPT)])]
    for place, seq, ts, target in zip(*held[len(_KEPT) :]):
        jobs[place].held[seq] = (ts, target)
    return {job.job_id: job for job in jobs}


def _store(kept: GroupState, jobs: list[_OrderedJob], now: int) -> None:
    """Keep the jobs of a bucket and set its timer for the first of them that is due."""
    if not jobs:
        if kept.exists:
            kept.remove()
        return
    early = [(place, seq, *job.held[seq]) for place, job in enumerate(jobs) if job.held for seq in sorted(job.held)]
    kept.update((*([getattr(job, c) for job in jobs] for c in _KEPT), *(list(c) for c in (zip(*early) if early else [()] * 4))))
    due = min((job.due for job in jobs if job.due is not None), default=None)
    if due is not None:
        # a finished job with attempts that still wait may be due already; it is looked at in the next trigger
        kept.setTimeoutTimestamp(max(due, now + 1, 1))


def ordered_job_outcomes(
    events: DataFrame, delay: str, first: int = 0, patience: int = 3600, stall: int = 86400, retention: int = 86400, buckets: int = BUCKETS
) -> DataFrame:
    """Judge attempts ``job_id, seq, ts, to_state`` in order of ``seq``, whatever order they arrive in.

    Each job counts ``seq`` from ``first`` without gaps. An attempt that comes early is held. ``delay`` is how far
    (in event time) an attempt may lag behind the newest of all jobs; Spark drops what is later. The other
    times are seconds of event time by the watermark: ``patience`` after a held attempt its gap is given up,
    and what then comes for it, or comes twice, is rejected as ``missed``; a job without an accepted
    attempt for ``stall`` has a row ``stalled`` with no ``seq`` and ``to_state``, once per state; ``retention`` after
    its end a job leaves the state. An attempt without ``ts`` or ``seq`` is rejected as ``incomplete``; one that
    has a ``seq`` takes its turn all the same. The rows of a trigger are handled before what is due. A job's state
    holds what is ahead of its turn; limit the rows of a trigger at the source to bound it. ``buckets`` as in
    :func:`job_outcomes`.
    """
    limits = (first, patience * 1000, stall * 1000, retention * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        out, now = [], kept.getCurrentWatermarkMs()
        jobs = _load(kept, limits, out)
        touched = {}
        for job_id, seq, ts, target in _attempts(key, frames) if not kept.hasTimedOut else ():
            job = jobs.get(job_id) or jobs.setdefault(job_id, _OrderedJob(job_id, limits, out))
            job.take(seq, ts, target)
            touched[job_id] = job
        for job in touched.values():
            job.settle()
        for job in [j for j in jobs.values() if j.due is not None and j.due <= now]:
            if job.expire(now):
                del jobs[job.job_id]
            else:
                job.settle()
        _store(kept, list(jobs.values()), now)
        yield _outcomes(out)

    rows = _bucketed(events.withWatermark("ts", delay), buckets, "ts").groupBy("bucket")
    return _timed(rows.applyInPandasWithState(run, _MICROS, _ORDERED_STATE, "append", "EventTimeTimeout"))


def publish_runs(publish: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body turning finished pipeline runs into their lifecycle events."""

    def run(batch: DataFrame, batch_id: int) -> None:
        publish(run_events(batch))

    return run
