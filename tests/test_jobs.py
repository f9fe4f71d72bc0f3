import datetime as dt
import json
import random

import pytest

from rasterweave.operators import jobs as J

SCHEMA = "job_id LONG, seq LONG, ts TIMESTAMP, to_state STRING"


def at(minute):
    return dt.datetime(2026, 1, 1, 12) + dt.timedelta(minutes=minute)


def simulate(events):
    """Plain state machine: the expected outcome of every attempt."""
    out, jobs = [], {}
    for job, seq, ts, target in sorted(events, key=lambda e: (e[0], e[1])):
        state, last, rev = jobs.get(job, (None, None, -1))
        options = ("queued",) if state is None else J.ALLOWED[state]
        code = (
            "terminal" if state in J.TERMINAL else "illegal" if target not in options
            else "late" if last and ts < last else None
        )
        before = state
        if code is None:
            state, last, rev = target, ts, rev + 1
            jobs[job] = (state, last, rev)
        out.append((job, seq, ts, before, target, code is None, code, rev))
    return out


def random_events(jobs=30, length=40, seed=5):
    rng = random.Random(seed)
    rows = []
    for job in range(jobs):
        path = list(J.FORWARD)
        for seq in range(length):
            if rng.random() < 0.7 and path:
                state = path.pop(0)
            else:
                state = rng.choice(J.STATES[:7] if rng.random() < 0.95 else J.STATES)
            rows.append((job, seq, at(seq - (30 if rng.random() < 0.2 else 0)), state))
    return rows


@pytest.mark.parametrize("limit", [1000, 0])
def test_state_machine(spark, limit):
    events = random_events()
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    got = [tuple(r) for r in J.apply_events(df, limit=limit).collect()]
    assert sorted(got, key=lambda r: r[:2]) == simulate(events)


def test_history_stays_within_the_longest_path(spark):
    outcomes = J.apply_events(spark.createDataFrame(random_events(), SCHEMA)).where("accepted")
    assert outcomes.groupBy("job_id").count().agg({"count": "max"}).first()[0] <= len(J.FORWARD)


def test_one_winner(spark):
    rows = spark.createDataFrame([(1, 7, 0), (2, 7, 0), (3, 7, 1)], "arrival LONG, job_id LONG, expected_revision INT")
    stored = spark.createDataFrame([(7, 0)], "job_id LONG, stored_revision INT")
    got = J.compare_and_swap(rows, stored).where("accepted").collect()
    assert [(r.arrival, r.new_revision) for r in got] == [(1, 1)]


def valid_job():
    return {
        "job_id": "5f0c7a3e-8a51-4e0e-9c55-2a5b2d6c1d11",
        "state": "preparing",
        "created_at": "2026-01-01T12:00:00+00:00",
        "updated_at": "2026-01-01T12:01:00Z",
        "request": {"aoi": {"type": "Polygon"}, "imagery_source": {"path": "/x"}, "metadata": None},
        "revision": 1,
        "transitions": [
            {"from_state": None, "to_state": "queued", "timestamp": "2026-01-01T12:00:00+00:00", "reason": "job_created"},
            {"from_state": "queued", "to_state": "preparing", "timestamp": "2026-01-01T12:01:00.5+00:00", "reason": None},
        ],
    }


def changed(**values):
    doc = valid_job()
    for path, value in values.items():
        target, *rest = path.split("__")
        if not rest:
            doc[target] = value
        else:
            doc[target][int(rest[0]) if rest[0].isdigit() else rest[0]] = value
    return doc


def without(*path):
    doc = valid_job()
    inner = doc
    for key in path[:-1]:
        inner = inner[key]
    del inner[path[-1]]
    return doc


STEP = valid_job()["transitions"][1]

CASES = [
    (valid_job(), None),
    (changed(job_id="{5f0c7a3e8a514e0e9c552a5b2d6c1d11}"), None),
    ([1], "not_object"),
    (without("revision"), "missing_fields"),
    (changed(job_id="abc"), "job_id_not_uuid"),
    (changed(job_id=5), "job_id_not_uuid"),
    (changed(state=3), "state_not_string"),
    (changed(state="paused"), "unknown_state"),
    (changed(created_at=5), "timestamp_not_string"),
    (changed(created_at="yesterday"), "timestamp_invalid"),
    (changed(created_at="2026-13-01T00:00:00Z"), "timestamp_invalid"),
    (changed(created_at="2026-01-01T12:00:00"), "timestamp_naive"),
    (changed(revision=True), "revision_invalid"),
    (changed(revision=-1), "revision_invalid"),
    (changed(revision=1.0), "revision_invalid"),
    (changed(revision="1"), "revision_invalid"),
    (changed(transitions={}), "transitions_not_list"),
    (changed(transitions__1="x"), "transition_not_object"),
    (without("transitions", 1, "reason"), "transition_missing_fields"),
    (changed(transitions__1={**STEP, "from_state": 1}), "transition_from_state_type"),
    (changed(transitions__1={**STEP, "to_state": None}), "transition_to_state_type"),
    (changed(transitions__1={**STEP, "timestamp": 1}), "transition_timestamp_type"),
    (changed(transitions__1={**STEP, "reason": 1}), "transition_reason_type"),
    (changed(transitions__1={**STEP, "timestamp": "x"}), "transition_timestamp_invalid"),
    (changed(transitions__1={**STEP, "timestamp": "2026-01-01"}), "transition_timestamp_naive"),
    (changed(transitions__1={**STEP, "to_state": "x"}), "transition_unknown_target"),
    (changed(transitions__1={**STEP, "from_state": "x"}), "transition_unknown_source"),
    (changed(transitions=[]), "no_transitions"),
    (changed(transitions=[STEP]), "first_from_state"),
    (changed(transitions=[{**STEP, "from_state": None}]), "first_to_state"),
    (changed(state="tiling"), "last_to_state"),
    (changed(revision=2), "revision_mismatch"),
    (changed(request=[]), "request_not_object"),
    (without("request", "aoi"), "request_missing_fields"),
    (changed(request__aoi=None), "aoi_not_object"),
    (changed(request__imagery_source="x"), "imagery_source_not_object"),
    (changed(request__metadata=1), "metadata_not_object"),
    (changed(request__metadata={"k": 1}), None),
    (without("request", "metadata"), None),
]


def test_document_rules(spark):
    rows = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(CASES)] + [(len(CASES), "{broken")]
    df = spark.createDataFrame(rows, "i INT, doc STRING")
    got = {r.i: (r.errors or [None])[0] for r in J.validate_documents(df).collect()}
    assert got == {**{i: code for i, (_, code) in enumerate(CASES)}, len(CASES): "not_object"}


def test_response_rules(spark):
    docs = [valid_job(), without("state"), changed(revision=True), changed(transitions=[1]), changed(created_at=1)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i INT, payload STRING")
    got = [r.error for r in J.validate_responses(df).orderBy("i").collect()]
    assert got == [None, "missing_fields", "revision_invalid", "transition_not_object", "created_at_not_string"]


def test_recorded_steps_and_durations(spark):
    rows = [(1, i, at(i * i), s) for i, s in enumerate(J.FORWARD)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert J.recorded_steps(df, chunk=2).where("NOT legal").count() == 0
    got = {r.state: r.seconds for r in J.stage_durations(df, chunk=2).collect()}
    assert got["queued"] == 60.0 and got["tiling"] == 7 * 60.0 and got["completed"] is None


def test_run_events_cut_the_reason(spark):
    df = spark.createDataFrame([(1, at(0), "x" * 900), (2, at(0), None)], "job_id LONG, ts TIMESTAMP, error STRING")
    last = {r.job_id: r for r in J.run_events(df).where("step = 6").collect()}
    assert (last[1].to_state, len(last[1].reason)) == ("failed", 500)
    assert (last[2].to_state, last[2].reason) == ("completed", "analysis_completed")
