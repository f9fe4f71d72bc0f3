"""Queries over job documents and lifecycle events."""

from pyspark.sql import functions as F

from rasterweave.functions import scalars as S
from rasterweave.operators import jobs as J
from rasterweave.plans.registry import query
from rasterweave.sources.documents import canonical_job

# fixed values: the legal steps, written out here as the check must not read them from the operator
_ALLOWED_SQL = """'queued>preparing', 'queued>failed', 'queued>cancelled', 'preparing>fetching_imagery', 'preparing>failed',
'preparing>cancelled', 'fetching_imagery>tiling', 'fetching_imagery>failed', 'fetching_imagery>cancelled', 'tiling>inference',
'tiling>failed', 'tiling>cancelled', 'inference>postprocessing', 'inference>failed', 'inference>cancelled',
'postprocessing>completed', 'postprocessing>failed', 'postprocessing>cancelled'"""
_LEGAL = f"(concat(coalesce({{f}}, ''), '>', {{t}}) IN ('>queued', {_ALLOWED_SQL}))"

_RUN = f"""
a AS (SELECT job_id, seq, ts, to_state FROM job_events),
run(job_id, seq, ts, from_state, to_state, rejected, state, last, revision) AS (
  SELECT job_id, seq, ts, CAST(NULL AS VARCHAR), to_state, CASE WHEN to_state <> 'queued' THEN 'illegal' END,
         CASE WHEN to_state = 'queued' THEN to_state END, CASE WHEN to_state = 'queued' THEN ts END,
         CASE WHEN to_state = 'queued' THEN 0 ELSE -1 END FROM a WHERE seq = 0
  UNION ALL
  SELECT job_id, seq, ts, state, to_state, code, CASE WHEN code IS NULL THEN to_state ELSE state END,
         CASE WHEN code IS NULL THEN ts ELSE last END, revision + CASE WHEN code IS NULL THEN 1 ELSE 0 END
  FROM (SELECT a.job_id, a.seq, a.ts, a.to_state, r.state, r.last, r.revision,
          CASE WHEN r.state IN ('completed', 'failed', 'cancelled') THEN 'terminal'
               WHEN NOT {_LEGAL.format(f='r.state', t='a.to_state')} THEN 'illegal'
               WHEN a.ts < r.last THEN 'late' END AS code
        FROM run r JOIN a ON a.job_id = r.job_id AND a.seq = r.seq + 1) z)"""


@query("ST-2b W-5 W-7 W-8 J-11", "job_events", f"""
WITH RECURSIVE {_RUN} SELECT job_id, seq, ts, from_state, to_state, rejected IS NULL AS accepted, rejected, revision FROM run""")
def job_outcomes(v):
    return J.apply_events(v.job_events)


@query("ST-2b W-8", "job_events", f"""
WITH RECURSIVE {_RUN} SELECT job_id, seq, ts, from_state, to_state, rejected IS NULL AS accepted, rejected, revision FROM run""")
def job_outcomes_long_jobs(v):
    """The way taken for jobs too long to fold, applied to every job."""
    return J.apply_events(v.job_events, limit=0)


@query("ST-2b", "job_events", f"""
WITH RECURSIVE {_RUN}, l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM run WHERE rejected IS NULL)
SELECT job_id, to_state AS state, revision, ts AS updated_at FROM l WHERE n = 1""")
def job_states(v):
    return J.current_states(J.apply_events(v.job_events))


@query("W-5", "job_events", f"""
SELECT *, {_LEGAL.format(f='from_state', t='to_state')} AS legal FROM (
  SELECT job_id, seq, ts, to_state, lag(to_state) OVER (PARTITION BY job_id ORDER BY seq) AS from_state FROM job_events) z""")
def recorded_steps(v):
    return J.recorded_steps(v.job_events, chunk=3)


@query("W-6", "job_events", f"""
WITH RECURSIVE {_RUN}
SELECT job_id, to_state AS state, ts, round((epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY seq)) - epoch_us(ts)) / 1e6, 6) AS seconds
FROM run WHERE rejected IS NULL""")
def stage_durations(v):
    accepted = J.apply_events(v.job_events).where("accepted")
    return J.stage_durations(accepted, chunk=3).withColumn("seconds", F.round("seconds", 6))


_CAS = """
w AS (SELECT job_id, min(arrival) AS arrival FROM job_updates WHERE expected_revision = stored_revision GROUP BY 1)
SELECT u.*, w.arrival IS NOT NULL AS accepted, CASE WHEN w.arrival IS NOT NULL THEN expected_revision + 1 END AS new_revision
FROM job_updates u LEFT JOIN w ON w.arrival = u.arrival"""


@query("J-11", "job_updates", f"WITH {_CAS}")
def compare_and_swap(v):
    return J.compare_and_swap(v.job_updates)


@query("J-12", "events customer", """
WITH f AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY 1)
SELECT event_id AS arrival, user_id AS job_id, coalesce(event_id = f.e AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0), false) AS accepted
FROM events LEFT JOIN f USING (user_id)""")
def create_once(v):
    creations = v.events.select(F.col("event_id").alias("arrival"), F.col("user_id").alias("job_id"))
    existing = v.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("job_id"))
    return J.create_once(creations, existing)


@query("ST-3", "job_events", """
SELECT job_id, seq, ts, CASE to_state WHEN 'queued' THEN NULL ELSE to_state END AS to_state,
  CASE to_state WHEN 'preparing' THEN 'preparation_started' WHEN 'fetching_imagery' THEN 'imagery_fetch_started' WHEN 'tiling' THEN 'tiling_started'
  WHEN 'inference' THEN 'inference_started' WHEN 'postprocessing' THEN 'postprocessing_started' WHEN 'completed' THEN 'analysis_completed'
  ELSE concat('note ', seq) END AS reason FROM job_events""")
def command_events(v):
    names = {state: name for name, (state, _) in J.COMMANDS.items()}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    commands = v.job_events.select(
        "job_id", "seq", "ts", F.try_element_at(lookup, F.col("to_state")).alias("command"),
        F.concat(F.lit("note "), F.col("seq").cast("string")).alias("reason"),
    )
    return J.command_events(commands)


@query("ST-4", "documents", """
WITH r AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN text END AS error FROM documents)
SELECT job_id, step, to_state, reason FROM r, (VALUES (1, 'preparing', 'preparation_started'), (2, 'fetching_imagery', 'imagery_fetch_started'),
  (3, 'tiling', 'tiling_started'), (4, 'inference', 'inference_started'), (5, 'postprocessing', 'postprocessing_started')) s(step, to_state, reason)
UNION ALL SELECT job_id, 6, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END,
  CASE WHEN error IS NULL THEN 'analysis_completed' ELSE substr(error, 1, 500) END FROM r""")
def run_events(v):
    runs = v.documents.select(
        F.col("doc_id").alias("job_id"), F.lit(None).cast("timestamp").alias("ts"),
        F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("error"),
    )
    return J.run_events(runs).drop("ts")


@query("ST-6", "job_events", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS attempts, count(*) FILTER (to_state = 'completed') AS completed,
       count(*) FILTER (to_state = 'failed') AS failed FROM job_events GROUP BY 1""")
def hourly_throughput(v):
    rows = J.windowed_throughput(v.job_events.withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_DOC_RULES = """
f AS (SELECT doc_id, doc, json_type(doc) = 'OBJECT' AS obj, json_type(doc, '$.revision') AS rt, json_extract_string(doc, '$.revision') AS rv,
        json_extract_string(doc, '$.job_id') AS id, json_extract_string(doc, '$.state') AS st, json_extract_string(doc, '$.created_at') AS ca,
        CAST(json_array_length(doc, '$.transitions') AS BIGINT) AS n, json_extract_string(doc, '$.transitions[0].from_state') AS f0,
        json_type(doc, '$.transitions[0].from_state') AS f0t,
        json_extract_string(doc, '$.transitions[0].timestamp') AS t0, json_extract_string(doc, '$.transitions[1].to_state') AS s1,
        json_extract_string(doc, concat('$.transitions[', greatest(coalesce(CAST(json_array_length(doc, '$.transitions') AS BIGINT), 1) - 1, 0), '].to_state')) AS sl,
        json_type(doc, '$.request.aoi') AS aoi, json_type(doc, '$.request.metadata') AS md FROM job_docs),
g AS (SELECT *, obj AND rt IS NOT NULL AS full_doc,
        CASE WHEN n > 0 AND t0 NOT LIKE '%+00:00' THEN 'transition_timestamp_naive' WHEN s1 = 'resting' THEN 'transition_unknown_target' END AS ti FROM f)
SELECT doc_id, concat_ws(',', CASE WHEN NOT obj THEN 'not_object' END, CASE WHEN obj AND NOT full_doc THEN 'missing_fields' END,
  CASE WHEN full_doc AND NOT regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'job_id_not_uuid' END,
  CASE WHEN full_doc AND st NOT IN ('queued', 'preparing', 'fetching_imagery', 'failed') THEN 'unknown_state' END,
  CASE WHEN full_doc AND ca NOT LIKE '%+00:00' THEN 'timestamp_naive' END,
  CASE WHEN full_doc AND (rt NOT IN ('UBIGINT', 'BIGINT') OR rv LIKE '-%') THEN 'revision_invalid' END,
  CASE WHEN full_doc THEN ti END, CASE WHEN full_doc AND n = 0 THEN 'no_transitions' END,
  CASE WHEN full_doc AND ti IS NULL AND n > 0 AND f0t <> 'NULL' THEN 'first_from_state' END,
  CASE WHEN full_doc AND ti IS NULL AND n > 0 AND sl <> st THEN 'last_to_state' END,
  CASE WHEN full_doc AND ti IS NULL AND n > 0 AND rt IN ('UBIGINT', 'BIGINT') AND rv NOT LIKE '-%' AND CAST(rv AS DOUBLE) <> n - 1 THEN 'revision_mismatch' END,
  CASE WHEN full_doc AND aoi IS NULL THEN 'request_missing_fields' WHEN full_doc AND md NOT IN ('OBJECT', 'NULL') THEN 'metadata_not_object' END) AS errors
FROM g"""


@query("F-14 C-4 C-5 C-6", "job_docs", f"WITH {_DOC_RULES}")
def job_document_problems(v):
    rows = J.validate_documents(v.job_docs)
    return rows.select("doc_id", F.concat_ws(",", "errors").alias("errors"))


@query("F-14", "job_docs", f"""
WITH {_DOC_RULES.replace("SELECT doc_id, concat_ws", "SELECT first_error, count(*) AS documents FROM (SELECT string_split(concat_ws").replace(" AS errors", ", ',')[1] AS first_error")}) z GROUP BY 1""")
def job_document_first_problem(v):
    rows = J.validate_documents(v.job_docs)
    first = F.coalesce(F.get("errors", F.lit(0)), F.lit(""))
    return rows.groupBy(first.alias("first_error")).agg(F.count("*").alias("documents"))


@query("F-15", "payloads", """
SELECT doc_id, CASE WHEN json_type(payload) <> 'OBJECT' THEN 'not_object'
  WHEN json_type(payload, '$.aoi') IS NULL OR json_type(payload, '$.imagery_source') IS NULL THEN 'request_missing_fields'
  WHEN json_type(payload, '$.aoi') <> 'OBJECT' THEN 'aoi_not_object'
  WHEN json_type(payload, '$.imagery_source') <> 'OBJECT' THEN 'imagery_source_not_object'
  WHEN json_type(payload, '$.metadata') NOT IN ('OBJECT', 'NULL') THEN 'metadata_not_object' END AS error FROM payloads""")
def request_problems(v):
    return J.validate_requests(v.payloads).select("doc_id", "error")


@query("F-15", "job_docs", f"""
WITH {_DOC_RULES[:_DOC_RULES.index("SELECT doc_id, concat_ws")]}
SELECT doc_id, CASE WHEN NOT obj THEN 'not_object' WHEN NOT full_doc THEN 'missing_fields'
  WHEN NOT regexp_full_match(id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'job_id_not_uuid'
  WHEN rt NOT IN ('UBIGINT', 'BIGINT') OR rv LIKE '-%' THEN 'revision_invalid'
  WHEN aoi IS NULL THEN 'request_missing_fields' WHEN md NOT IN ('OBJECT', 'NULL') THEN 'metadata_not_object' END AS error FROM g""")
def response_problems(v):
    return J.validate_responses(v.job_docs, "doc").select("doc_id", "error")


@query("X-1", "job_docs", """
SELECT doc_id, CASE WHEN json_type(doc) <> 'OBJECT' THEN 'created_at,job_id,request,revision,state,transitions,updated_at'
  WHEN json_type(doc, '$.revision') IS NULL THEN 'revision' ELSE '' END AS missing FROM job_docs""")
def missing_job_keys(v):
    rows = J.missing_keys(v.job_docs, J.JOB_FIELDS)
    return rows.select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("S-7 C-4", "job_events", f"""
WITH RECURSIVE {_RUN}, acc AS (SELECT * FROM run WHERE rejected IS NULL), d AS (
SELECT job_id, min(ts) AS c, max(ts) AS u, max(revision) AS revision, last(to_state ORDER BY seq) AS state,
  string_agg(concat('{{"from_state":', CASE WHEN from_state IS NULL THEN 'null' ELSE concat('"', from_state, '"') END,
   ',"reason":null,"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00","to_state":"', to_state, '"}}'), ',' ORDER BY seq) AS t
FROM acc GROUP BY job_id)
SELECT CAST(job_id AS VARCHAR) AS job_id, replace(concat('{{"created_at":"', strftime(c, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00","job_id":"', job_id,
  '","request":{{"aoi":{{"type":"Polygon"}},"imagery_source":{{"path":"/x","zone":1}}}},"revision":', revision, ',"state":"', state,
  '","transitions":[', t, '],"updated_at":"', strftime(u, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00"}}'), '.000000+00:00', '+00:00') AS doc FROM d""")
def canonical_documents(v):
    outcomes = J.apply_events(v.job_events).where("accepted")
    entry = F.struct(
        "seq", "from_state", F.lit(None).cast("string").alias("reason"),
        S.format_instant(F.col("ts")).alias("timestamp"), "to_state",
    )
    # the accepted history of a job has at most one entry per lifecycle state
    jobs = outcomes.groupBy("job_id").agg(
        F.array_sort(F.collect_list(entry)).alias("_t"), F.max("revision").cast("long").alias("revision"),
        F.min("ts").alias("_c"), F.max("ts").alias("_u"),
    )
    request = F.struct(
        F.lit('{"type":"Polygon"}').alias("aoi"), F.lit('{"zone":1,"path":"/x"}').alias("imagery_source"),
        F.lit(None).cast("string").alias("metadata"),
    )
    return canonical_job(
        jobs.select(
            S.format_instant(F.col("_c")).alias("created_at"), F.col("job_id").cast("string").alias("job_id"),
            request.alias("request"), "revision", F.element_at("_t", -1)["to_state"].alias("state"),
            F.transform("_t", lambda t: t.dropFields("seq")).alias("transitions"),
            S.format_instant(F.col("_u")).alias("updated_at"),
        )
    )


@query("S-15", "events", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts::DATE + INTERVAL (event_id % 86400) SECOND
  WHEN 1 THEN ts::DATE::TIMESTAMP WHEN 5 THEN TIMESTAMP '2024-02-01' ELSE ts END AS acquired_at FROM events""")
def file_name_times(v):
    """Names with a full time, a day, an impossible month, an impossible clock, nothing, and a
    day hidden behind an impossible one."""
    day = F.date_format("ts", "yyyyMMdd")
    clock = F.date_format(F.timestamp_seconds(F.col("event_id") % 86400).cast("timestamp_ntz"), "HHmmss")
    k = F.col("event_id") % 6
    stem = (
        F.when(k == 0, F.concat(F.lit("imagery_"), day, F.lit("T"), clock, F.lit("_v2")))
        .when(k == 1, F.concat(F.lit("scene-"), day))
        .when(k == 2, F.lit("x_20241399T101010"))
        .when(k == 3, F.lit("a20249931"))
        .when(k == 4, F.lit("plain"))
        .otherwise(F.lit("0020240201"))
    )
    return v.events.select("event_id", S.timestamp_in_name(stem, F.col("ts")).alias("acquired_at"))
