"""Analysis jobs: stored documents, lifecycle events and optimistic updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.prefix import by_ordinal, shifted
from rasterweave.functions.scalars import ISO_ANY, has_offset, is_json_integer, is_uuid
from rasterweave.session import checkpoint

# Lifecycle states, legal transitions, commands with their recorded reasons.
FORWARD = (
    "queued",
    "preparing",
    "fetching_imagery",
    "tiling",
    "inference",
    "postprocessing",
    "completed",
)
TERMINAL = ("completed", "failed", "cancelled")
STATES = (*FORWARD, "failed", "cancelled")
ALLOWED = {
    "queued": ("preparing", "failed", "cancelled"),
    "preparing": ("fetching_imagery", "failed", "cancelled"),
    "fetching_imagery": ("tiling", "failed", "cancelled"),
    "tiling": ("inference", "failed", "cancelled"),
    "inference": ("postprocessing", "failed", "cancelled"),
    "postprocessing": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}
COMMANDS = {
    "prepare": ("preparing", "preparation_started"),
    "start_imagery_fetch": ("fetching_imagery", "imagery_fetch_started"),
    "start_tiling": ("tiling", "tiling_started"),
    "start_inference": ("inference", "inference_started"),
    "start_postprocessing": ("postprocessing", "postprocessing_started"),
    "complete": ("completed", "analysis_completed"),
    "fail": ("failed", None),
    "cancel": ("cancelled", None),
}
JOB_FIELDS = ("created_at", "job_id", "request", "revision", "state", "transitions", "updated_at")
TRANSITION_FIELDS = ("from_state", "reason", "timestamp", "to_state")
REQUEST_FIELDS = ("aoi", "imagery_source")
REASON_LENGTH = 500

# jobs with more events than this are advanced round by round instead of folded in one row
FOLD_LIMIT = 1000
_SALTS = 32


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def is_allowed(from_state: Column, to_state: Column) -> Column:
    """Legality of one transition; a job that does not exist yet (NULL) can only be queued."""
    pairs = [f"{a}>{b}" for a, group in ALLOWED.items() for b in group]
    step = F.concat_ws(">", F.coalesce(from_state, F.lit("")), to_state)
    return step.isin(">queued", *pairs)


# ------------------------------------------------------------------ event log


def _decide(state: Column, last: Column, to_state: Column, ts: Column) -> Column:
    """Reason code of a rejected attempt, NULL when it is accepted."""
    return (
        F.when(is_terminal(state), "terminal")
        .when(~is_allowed(state, to_state), "illegal")
        .when(ts < last, "late")
    )


def _fold_small(events: DataFrame) -> DataFrame:
    ts_type = events.schema["ts"].dataType.simpleString()
    blank = F.struct(
        F.lit(None).cast("string").alias("state"),
        F.lit(None).cast(ts_type).alias("ts"),
        F.lit(None).cast("long").alias("seq"),
        F.lit(-1).alias("revision"),
    )
    start = F.array().cast(f"array<struct<state: string, ts: {ts_type}, seq: bigint, revision: int>>")

    def top(accepted: Column) -> Column:
        return F.coalesce(F.try_element_at(accepted, F.lit(-1)), blank)

    def step(accepted: Column, e: Column) -> Column:
        now = top(accepted)
        taken = F.struct(
            e["to_state"].alias("state"), e["ts"].alias("ts"), e["seq"].alias("seq"),
            (now["revision"] + 1).alias("revision"),
        )
        ok = _decide(now["state"], now["ts"], e["to_state"], e["ts"]).isNull()
        return F.when(ok, F.concat(accepted, F.array(taken))).otherwise(accepted)

    grouped = events.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "ts", "to_state"))).alias("_events")
    )
    # at most one accepted entry per state on the longest path, so this array stays tiny
    folded = grouped.withColumn("_accepted", F.aggregate("_events", start, step))
    rows = folded.select("job_id", "_accepted", F.inline("_events"))
    before = F.filter("_accepted", lambda a: a["seq"] < F.col("seq"))
    prior = rows.withColumn("_prior", F.coalesce(F.try_element_at(before, F.lit(-1)), blank))
    return _classified(prior)


def _classified(rows: DataFrame) -> DataFrame:
    p = F.col("_prior")
    code = _decide(p["state"], p["ts"], F.col("to_state"), F.col("ts"))
    return rows.select(
        "job_id",
        "seq",
        "ts",
        p["state"].alias("from_state"),
        "to_state",
        code.isNull().alias("accepted"),
        code.alias("rejected"),
        (p["revision"] + F.when(code.isNull(), 1).otherwise(0)).cast("int").alias("revision"),
    )


def _advance_large(events: DataFrame, sizes: DataFrame) -> DataFrame:
    """Jobs of any length. The lifecycle is acyclic, so a job accepts at most one event per state
    of the longest path: that many rounds of "earliest acceptable event after the last accepted
    one" replace the fold. Every round is a salted join and a minimum, never a group in one task.
    ``sizes`` has the jobs and their numbers of events (``_n``): a job has a salt for each ``FOLD_LIMIT`` of them, up
    to ``_SALTS``, so the states that a round spreads are no more than the work needs.
    """
    ts_type = events.schema["ts"].dataType.simpleString()
    salts = F.least(F.ceil(F.col("_n") / FOLD_LIMIT), F.lit(_SALTS)).cast("int")
    sizes = sizes.select("job_id", salts.alias("_salts"))
    # read by every round
    salted = checkpoint(
        events.join(sizes, "job_id").withColumn("_salt", F.pmod(F.xxhash64("seq"), F.col("_salts")).cast("int")).drop("_salts")
    )

    def spread(per_job: DataFrame) -> DataFrame:
        return per_job.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")

    entry = f"struct<state: string, ts: {ts_type}, seq: bigint, revision: int>"
    state = sizes.select("job_id", "_salts", F.array().cast(f"array<{entry}>").alias("_accepted"))
    for round_no in range(len(FORWARD)):
        now = F.try_element_at("_accepted", F.lit(-1))
        later = F.coalesce(F.col("seq") > now["seq"], F.lit(True))
        ok = _decide(now["state"], now["ts"], F.col("to_state"), F.col("ts")).isNull()
        place = F.struct("seq", "ts", "to_state")
        found = (
            salted.join(spread(state), ["job_id", "_salt"])
            .where(later & ok)
            .groupBy("job_id")
            .agg(F.min(place).alias("_next"))
        )
        taken = F.struct(
            F.col("_next.to_state").alias("state"), F.col("_next.ts").alias("ts"),
            F.col("_next.seq").alias("seq"), F.lit(round_no).alias("revision"),
        )
        advanced = state.join(found, "job_id", "left").select(
            "job_id", "_salts",
            F.when(F.col("_next").isNull(), F.col("_accepted"))
            .otherwise(F.concat("_accepted", F.array(taken)))
            .alias("_accepted"),
        )
        # one small row per long job, read twice by the next round
        state = checkpoint(advanced)
    blank = F.struct(
        F.lit(None).cast("string").alias("state"), F.lit(None).cast(ts_type).alias("ts"),
        F.lit(None).cast("long").alias("seq"), F.lit(-1).alias("revision"),
    )
    rows = salted.join(spread(state), ["job_id", "_salt"])
    before = F.filter("_accepted", lambda a: a["seq"] < F.col("seq"))
    return _classified(rows.withColumn("_prior", F.coalesce(F.try_element_at(before, F.lit(-1)), blank)))


def apply_events(events: DataFrame, limit: int = FOLD_LIMIT) -> DataFrame:
    """Run every job's attempted transitions through the state machine in arrival order.

    ``events`` has ``job_id, seq, ts, to_state`` with ``seq`` unique per job. Each attempt comes
    back with ``from_state, accepted, rejected, revision``; rejections are ``terminal`` (job
    finished), ``illegal`` (no such transition) or ``late`` (before the last accepted timestamp).
    """
    events = events.select("job_id", F.col("seq").cast("long").alias("seq"), "ts", "to_state")
    # one aggregate over a single column tells whether any job is too long to fold
    sizes = events.groupBy("job_id").agg(F.count("*").alias("_n"))
    long_jobs = checkpoint(sizes.where(F.col("_n") > limit))
    if long_jobs.isEmpty():
        return _fold_small(events)
    folded = _fold_small(events.join(long_jobs, "job_id", "left_anti"))
    return folded.unionByName(_advance_large(events, long_jobs))


def current_states(outcomes: DataFrame) -> DataFrame:
    """Latest accepted state, revision and update time per job."""
    last = F.max_by(F.struct("to_state", "revision", "ts"), "seq")
    return outcomes.where("accepted").groupBy("job_id").agg(last.alias("_l")).select(
        "job_id", F.col("_l.to_state").alias("state"), F.col("_l.revision").alias("revision"),
        F.col("_l.ts").alias("updated_at"),
    )


def recorded_steps(events: DataFrame, chunk: int = 65536) -> DataFrame:
    """Recorded transitions with the state recorded just before, and whether the step is legal."""
    rows = shifted(events, ["job_id"], ["seq"], by_ordinal("seq", chunk), {"from_state": F.col("to_state")})
    return rows.withColumn("legal", is_allowed(F.col("from_state"), F.col("to_state")))


def stage_durations(accepted: DataFrame, chunk: int = 65536) -> DataFrame:
    """Seconds a job stayed in each accepted state; NULL for the state it is still in."""
    rows = shifted(accepted, ["job_id"], ["seq"], by_ordinal("seq", chunk), {"_left": F.col("ts")}, offset=1)
    micros = F.unix_micros(F.col("_left").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select("job_id", F.col("to_state").alias("state"), "ts", (micros / 1e6).alias("seconds"))


def command_events(commands: DataFrame) -> DataFrame:
    """Translate lifecycle commands to attempted transitions; unknown commands keep a NULL state."""
    items = [F.lit(v) for name, (state, _) in COMMANDS.items() for v in (name, state)]
    notes = [F.lit(v) for name, (_, reason) in COMMANDS.items() if reason for v in (name, reason)]
    command = F.col("command")
    fixed = F.try_element_at(F.create_map(*notes), command)
    return commands.select(
        "job_id", "seq", "ts",
        F.try_element_at(F.create_map(*items), command).alias("to_state"),
        F.coalesce(fixed, F.col("reason")).alias("reason"),
    )


def run_events(runs: DataFrame) -> DataFrame:
    """Events one pipeline run records: five forward states, then completed or failed.

    ``runs`` has ``job_id, ts, error``; a failure keeps the first 500 characters of its message.
    """
    steps = [
        F.struct(F.lit(i).alias("step"), F.lit(state).alias("to_state"), F.lit(reason).alias("reason"))
        for i, (state, reason) in enumerate(list(COMMANDS.values())[:5], start=1)
    ]
    failed = F.col("error").isNotNull()
    final = F.struct(
        F.lit(6).alias("step"),
        F.when(failed, "failed").otherwise("completed").alias("to_state"),
        F.when(failed, F.substring("error", 1, REASON_LENGTH)).otherwise("analysis_completed").alias("reason"),
    )
    return runs.select("job_id", "ts", F.inline(F.array(*steps, final)))


def windowed_throughput(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Attempts, completions and failures per time window; late data beyond ``delay`` is dropped
    when the input is a stream."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(
            F.count("*").alias("attempts"),
            F.count_if(F.col("to_state") == "completed").alias("completed"),
            F.count_if(F.col("to_state") == "failed").alias("failed"),
        )
        .select(F.col("w.start").alias("window_start"), "attempts", "completed", "failed")
    )


# ------------------------------------------------------------------ optimistic updates


def compare_and_swap(updates: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Add ``accepted`` and ``new_revision`` to proposed updates.

    An update counts when its expected revision is the stored one; of those the first arrival per
    job wins. The winner is found by a minimum per job and matched back on the unique arrival
    number, so a job with very many proposals does not concentrate in one task.
    ``current`` (``job_id, stored_revision``) is joined when the updates do not carry it.
    """
    rows = updates if current is None else updates.join(current, "job_id", "left")
    fits = F.col("expected_revision") == F.col("stored_revision")
    winners = (
        rows.where(fits).groupBy("job_id").agg(F.min("arrival").alias("arrival")).select("arrival", F.lit(True).alias("_won"))
    )
    return rows.join(winners, "arrival", "left").select(
        *rows.columns,
        F.coalesce("_won", F.lit(False)).alias("accepted"),
        F.when(F.col("_won"), F.col("expected_revision") + 1).alias("new_revision"),
    )


def create_once(creations: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``accepted``: the first creation of a job id that does not exist yet."""
    first = creations.groupBy("job_id").agg(F.min("arrival").alias("arrival"))
    new = first.join(existing.select("job_id"), "job_id", "left_anti")
    won = new.select("arrival", F.lit(True).alias("_won"))
    return creations.join(won, "arrival", "left").select(
        *creations.columns, F.coalesce("_won", F.lit(False)).alias("accepted")
    )


# ------------------------------------------------------------------ document rules


def _kind(value: Column) -> Column:
    """JSON type of a variant value by the head of its schema text; NULL when absent."""
    # Heads of variant schema texts; every other head is a number
    heads = {"ST": "string", "OB": "object", "AR": "array", "BO": "boolean", "VO": "null"}
    head = F.substring(F.schema_of_variant(value), 1, 2)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]), head)
    return F.when(value.isNotNull(), F.coalesce(named, F.lit("number")))


def _is_iso(text: Column) -> Column:
    return text.rlike(ISO_ANY) & F.try_to_timestamp(text).isNotNull()


def _members(
    value: Column, names: tuple[str, ...], texts: tuple[str, ...] = (), kinds: dict[str, Column] | None = None
) -> dict[str, Column]:
    """Description of a variant: its kind, the kind of each member and the text of some.

    ``kinds`` supplies member kinds that are already known.
    """
    known = kinds or {}
    described = {"kind": _kind(value)}
    for name in names:
        member = F.try_variant_get(value, f"$.{name}", "variant")
        described[f"{name}_kind"] = known.get(name, _kind(member))
    for name in texts:
        described[f"{name}_text"] = F.try_variant_get(value, f"$.{name}", "string")
    return described


def _columns(described: dict[str, Column], prefix: str) -> list[Column]:
    return [column.alias(prefix + name) for name, column in described.items()]


def _read(described: dict[str, Column], prefix: str) -> dict[str, Column]:
    return {name: F.col(prefix + name) for name in described}


def _lacks(described: Column | dict[str, Column], names: tuple[str, ...]) -> Column:
    """True when one of the named members is absent (a JSON null is present)."""
    missing = described[f"{names[0]}_kind"].isNull()
    for name in names[1:]:
        missing = missing | described[f"{name}_kind"].isNull()
    return missing


def _transition_problem(item: Column) -> Column:
    """First failed rule of one described transition."""
    ts_text, from_text = item["timestamp_text"], item["from_state_text"]
    return (
        F.when(item["kind"] != "object", "transition_not_object")
        .when(_lacks(item, TRANSITION_FIELDS), "transition_missing_fields")
        .when(~item["from_state_kind"].isin("string", "null"), "transition_from_state_type")
        .when(item["to_state_kind"] != "string", "transition_to_state_type")
        .when(item["timestamp_kind"] != "string", "transition_timestamp_type")
        .when(~item["reason_kind"].isin("string", "null"), "transition_reason_type")
        .when(~_is_iso(ts_text), "transition_timestamp_invalid")
        .when(~has_offset(ts_text), "transition_timestamp_naive")
        .when(~item["to_state_text"].isin(*STATES), "transition_unknown_target")
        .when((item["from_state_kind"] == "string") & ~from_text.isin(*STATES), "transition_unknown_source")
    )


def _request_problem(request: dict[str, Column]) -> Column:
    """First failed rule of a described request."""
    return (
        F.when(request["kind"] != "object", "request_not_object")
        .when(_lacks(request, REQUEST_FIELDS), "request_missing_fields")
        .when(request["aoi_kind"] != "object", "aoi_not_object")
        .when(request["imagery_source_kind"] != "object", "imagery_source_not_object")
        .when(~F.coalesce(request["metadata_kind"], F.lit("null")).isin("object", "null"), "metadata_not_object")
    )


_REQUEST_MEMBERS = ("aoi", "imagery_source", "metadata")


def _described(documents: DataFrame, document: str) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Parse each document once and describe it, its request and its transitions.

    Returns the rows and the columns describing document and request. The descriptions are plain
    columns, which the rules read many times and the optimizer therefore keeps computed once.
    """
    doc = F.col("_doc")
    items = F.try_variant_get(doc, "$.transitions", "array<variant>")
    request = F.try_variant_get(doc, "$.request", "variant")
    present = F.try_variant_get(doc, "$.transitions", "variant").isNotNull()
    # naming the type of a whole history would walk all of it
    history = F.when(items.isNotNull(), "array").when(present, "other")
    d = _members(doc, JOB_FIELDS, ("job_id", "state", "created_at", "updated_at"), {"transitions": history})
    r = _members(request, _REQUEST_MEMBERS)

    def transition(item: Column) -> Column:
        return F.struct(*_columns(_members(item, TRANSITION_FIELDS, ("from_state", "to_state", "timestamp")), ""))

    rows = documents.select("*", F.try_parse_json(F.col(document)).alias("_doc")).select(
        *documents.columns,
        *_columns(d, "_d_"),
        *_columns(r, "_r_"),
        F.transform(items, transition).alias("_t"),
        # the parsed value cannot tell 1.0 from 1, the text can
        F.get_json_object(F.col(document), "$.revision").alias("_n_text"),
    )
    digits = (F.col("_d_revision_kind") == "number") & is_json_integer(F.col("_n_text"), 0)
    rows = rows.withColumns(
        {
            "_n_ok": F.coalesce(digits, F.lit(False)),
            "_n": F.when(digits, F.col("_n_text").try_cast("decimal(38,0)")),
        }
    )
    return rows, _read(d, "_d_"), _read(r, "_r_")


def validate_documents(documents: DataFrame, document: str = "doc") -> DataFrame:
    """Add ``errors``: codes of all failed rules of a stored job, in checking order.

    The first code is the one a reader that stops at the first failure would report. Every rule is
    a column expression over the parsed document; no document leaves its row.
    """
    described, d, r = _described(documents, document)
    items = F.col("_t")
    is_object = F.coalesce(d["kind"] == "object", F.lit(False))
    rows = described.select(
        "*",
        is_object.alias("_object"),
        (is_object & ~_lacks(d, JOB_FIELDS)).alias("_full"),
        F.filter(F.transform(items, _transition_problem), lambda p: p.isNotNull()).alias("_bad"),
    )
    full = F.col("_full")
    created, updated = d["created_at_text"], d["updated_at_text"]
    typed = (d["created_at_kind"] == "string") & (d["updated_at_kind"] == "string")
    iso = typed & _is_iso(created) & _is_iso(updated)
    is_list = d["transitions_kind"] == "array"
    readable = full & is_list & (F.size("_bad") == 0)
    filled = readable & (F.size(items) > 0)
    first, last = F.get(items, F.lit(0)), F.try_element_at(items, F.lit(-1))
    id_ok = F.coalesce(d["job_id_kind"] == "string", F.lit(False)) & is_uuid(d["job_id_text"])
    codes = [
        F.when(~F.col("_object"), "not_object"),
        F.when(F.col("_object") & ~full, "missing_fields"),
        F.when(full & ~id_ok, "job_id_not_uuid"),
        F.when(full & (d["state_kind"] != "string"), "state_not_string"),
        F.when(full & (d["state_kind"] == "string") & ~d["state_text"].isin(*STATES), "unknown_state"),
        F.when(full & ~typed, "timestamp_not_string"),
        F.when(full & typed & ~iso, "timestamp_invalid"),
        F.when(full & iso & ~(has_offset(created) & has_offset(updated)), "timestamp_naive"),
        F.when(full & ~F.col("_n_ok"), "revision_invalid"),
        F.when(full & ~is_list, "transitions_not_list"),
        F.when(full & is_list, F.get("_bad", F.lit(0))),
        F.when(readable & (F.size(items) == 0), "no_transitions"),
        F.when(filled & (first["from_state_kind"] != "null"), "first_from_state"),
        F.when(filled & (first["to_state_text"] != "queued"), "first_to_state"),
        F.when(filled & (last["to_state_text"] != F.coalesce(d["state_text"], F.lit(""))), "last_to_state"),
        F.when(filled & F.col("_n_ok") & (F.col("_n") != F.size(items) - 1), "revision_mismatch"),
        F.when(full, _request_problem(r)),
    ]
    return rows.select(*documents.columns, F.array_compact(F.array(*codes)).alias("errors"))


def validate_requests(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``error``: first failed rule of a job creation request, NULL when it is fine."""
    described = _members(F.col("_doc"), _REQUEST_MEMBERS)
    rows = payloads.select("*", F.try_parse_json(F.col(payload)).alias("_doc")).select(
        *payloads.columns, *_columns(described, "_r_")
    )
    r = _read(described, "_r_")
    problem = F.when(~F.coalesce(r["kind"] == "object", F.lit(False)), "not_object").otherwise(_request_problem(r))
    return rows.select(*payloads.columns, problem.alias("error"))


def validate_responses(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``error``: first failed rule of a job response, NULL when it is fine."""
    rows, d, r = _described(payloads, payload)
    id_ok = F.coalesce(d["job_id_kind"] == "string", F.lit(False)) & is_uuid(d["job_id_text"])
    problem = (
        F.when(~F.coalesce(d["kind"] == "object", F.lit(False)), "not_object")
        .when(_lacks(d, JOB_FIELDS), "missing_fields")
        .when(~id_ok, "job_id_not_uuid")
        .when(d["state_kind"] != "string", "state_not_string")
        .when(~F.col("_n_ok"), "revision_invalid")
        .when(d["created_at_kind"] != "string", "created_at_not_string")
        .when(d["updated_at_kind"] != "string", "updated_at_not_string")
        .otherwise(
            F.coalesce(
                _request_problem(r),
                F.when(d["transitions_kind"] != "array", "transitions_not_list").when(
                    F.exists("_t", lambda i: i["kind"] != "object"), "transition_not_object"
                ),
            )
        )
    )
    return rows.select(*payloads.columns, problem.alias("error"))


def missing_keys(documents: DataFrame, required: tuple[str, ...], document: str = "doc") -> DataFrame:
    """Add ``missing``: required top-level keys a JSON object lacks, in the order given."""
    keys = F.coalesce(F.json_object_keys(F.col(document)), F.array().cast("array<string>"))
    return documents.withColumn("missing", F.array_except(F.array(*[F.lit(k) for k in required]), keys))
