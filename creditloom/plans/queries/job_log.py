"""Queries: job-log lists, counters, signals, next-state tables, audit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ...operators import job_log as jl
from ...schema import STALE_EXHAUSTED, STALE_REQUEUED, TERMINAL_STATUSES
from ...session import new_table_path
from ...sources.files import decode_fields
from .common import A, AS_OF, J, jobs, register


KNOWN_TYPES = ["type_0", "type_1", "type_2", "type_3", "type_4"]


register(
    "jobs_by_status",
    O.with_ctes(J, f"SELECT {O.JOB_COLS} FROM job WHERE status = 'dead_letter' ORDER BY updated_at DESC, job_id DESC LIMIT 50"),
)(lambda spark, d: jl.jobs_by_status(jobs(spark, d), " Dead_Letter ", 50))


register(
    "jobs_due",
    O.with_ctes(J, f"SELECT * FROM job WHERE status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= {A}) "
                   "ORDER BY next_attempt_at ASC NULLS FIRST, created_at, job_id"),
)(lambda spark, d: jl.jobs_due(jobs(spark, d), AS_OF))


register(
    "jobs_active_latest",
    O.with_ctes(J, "SELECT job_type, job_id, status, created_at, updated_at, attempts FROM ("
                   "SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY updated_at DESC, job_id DESC) AS rn "
                   "FROM job WHERE status IN ('queued', 'running')) WHERE rn = 1"),
)(lambda spark, d: jl.active_latest_by_type(jobs(spark, d)))


register(
    "job_stats",
    O.with_ctes(
        J,
        "SELECT *, paused AND running = 0 AS drained, queued >= 500 AS capacity_exceeded FROM (SELECT "
        + ", ".join(f"{O.cnt(f'status = {O.q(s)}')} AS {s}" for s in ["queued", "running", "succeeded", "dead_letter", "canceled"])
        + ", count(*) AS total, "
        + ", ".join(f"min(CASE WHEN status = '{s}' THEN created_at END) AS oldest_{s}" for s in ["queued", "running", "dead_letter"])
        + ", false AS paused FROM job)",
    ),
)(lambda spark, d: jl.job_stats(jobs(spark, d)))


register(
    "job_type_stats",
    O.with_ctes(J, "SELECT job_type, " + ", ".join(f"{O.cnt(f'status = {O.q(s)}')} AS {s}" for s in ["queued", "running", "dead_letter"])
                + ", count(*) AS total FROM job GROUP BY job_type ORDER BY total DESC, job_type LIMIT 50"),
)(lambda spark, d: jl.job_type_stats(jobs(spark, d), 50))


register(
    "queue_age",
    O.with_ctes(J, "SELECT queued, oldest_queued_at, age AS oldest_queued_age_seconds, cast(300 AS double) AS threshold_seconds, "
                   "coalesce(age >= 300, false) AS breached FROM (SELECT count(*) AS queued, min(created_at) AS oldest_queued_at, "
                   f"CASE WHEN min(created_at) IS NOT NULL THEN greatest({O.secs('min(created_at)', A)}, cast(0 AS double)) END AS age "
                   "FROM job WHERE status = 'queued')"),
)(lambda spark, d: jl.queue_age(jobs(spark, d), AS_OF, 300.0))


_DL = "status = 'dead_letter'"
_RECENT_DL = O.cnt(f"{_DL} AND updated_at >= {O.ts(jl.shifted(AS_OF, -3600))}")
_ALL_DL = O.cnt(_DL)


register(
    "dead_letter_rate",
    O.with_ctes(J, "SELECT *, cast(3600 AS double) AS window_seconds, cast(1 AS double) AS threshold_per_minute, "
                   "recent_dead_letter / cast(60 AS double) AS rate_per_minute, recent_dead_letter / cast(60 AS double) >= 1 AS breached "
                   f"FROM (SELECT {_RECENT_DL} AS recent_dead_letter, {_ALL_DL} AS total_dead_letter FROM job)"),
)(lambda spark, d: jl.dead_letter_rate(jobs(spark, d), AS_OF, 3600.0, 1.0))


register(
    "dead_letter_types",
    O.with_ctes(J, "SELECT job_type, count(*) AS dead_letter FROM job WHERE status = 'dead_letter' GROUP BY job_type "
                   "ORDER BY dead_letter DESC, job_type LIMIT 10"),
)(lambda spark, d: jl.dead_letter_top_types(jobs(spark, d), 10))


_RC, _PC = O.ts(jl.shifted(AS_OF, -3600)), O.ts(jl.shifted(AS_OF, -7200))


register(
    "dead_letter_trend",
    O.with_ctes(J, "SELECT *, cast(3600 AS double) AS window_seconds, recent_count - previous_count AS delta, "
                   "CASE WHEN recent_count > previous_count THEN 'up' WHEN recent_count < previous_count THEN 'down' ELSE 'flat' END AS direction "
                   f"FROM (SELECT {O.cnt(f'{_DL} AND updated_at >= {_RC}')} AS recent_count, "
                   f"{O.cnt(f'{_DL} AND updated_at >= {_PC} AND updated_at < {_RC}')} AS previous_count FROM job)"),
)(lambda spark, d: jl.dead_letter_trend(jobs(spark, d), AS_OF, 3600.0))


register(
    "dead_letter_errors",
    O.with_ctes(J, "SELECT coalesce(nullif(trim(error), ''), '(no error message)') AS error_message, count(*) AS dead_letter "
                   "FROM job WHERE status = 'dead_letter' GROUP BY 1 ORDER BY dead_letter DESC, error_message LIMIT 10"),
)(lambda spark, d: jl.dead_letter_errors(jobs(spark, d), 10))


register(
    "queued_oldest",
    O.with_ctes(J, f"SELECT {O.JOB_COLS} FROM job WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 20"),
)(lambda spark, d: jl.oldest_queued(jobs(spark, d), 20))


register(
    "dead_letter_recent",
    O.with_ctes(J, f"SELECT {O.JOB_COLS} FROM job WHERE status = 'dead_letter' ORDER BY updated_at DESC, job_id DESC LIMIT 20"),
)(lambda spark, d: jl.recent_dead_letters(jobs(spark, d), 20))


register(
    "stale_recovery",
    O.with_ctes(J, "SELECT job_id, job_type, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'dead_letter' END AS status, "
                   f"CASE WHEN attempts < max_attempts THEN {O.q(STALE_REQUEUED)} ELSE {O.q(STALE_EXHAUSTED)} END AS error, "
                   f"attempts, max_attempts, CASE WHEN attempts < max_attempts THEN {A} END AS next_attempt_at, {A} AS updated_at "
                   f"FROM job WHERE status = 'running' AND updated_at <= {O.ts(jl.shifted(AS_OF, -300))}"),
)(lambda spark, d: jl.stale_recovery(jobs(spark, d), AS_OF, 300.0))


def failures(spark, d):
    j = jobs(spark, d).filter(F.col("status") == "running")
    return j.withColumn("error", F.coalesce(F.col("error"), F.lit("handler failed")))


register(
    "retry_transition",
    O.with_ctes(J, "SELECT job_id, job_type, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'dead_letter' END AS status, "
                   "cast(NULL AS varchar) AS result_json, coalesce(error, 'handler failed') AS error, attempts, max_attempts, "
                   f"CASE WHEN attempts < max_attempts THEN {A} + to_microseconds(cast(attempts * cast(200000 AS double) AS bigint)) END "
                   f"AS next_attempt_at, {A} AS updated_at FROM job WHERE status = 'running'"),
)(lambda spark, d: jl.retry_transition(failures(spark, d), AS_OF, 0.2))


_KNOWN_SQL = ", ".join(O.q(t) for t in KNOWN_TYPES)


register(
    "requeue_candidates",
    O.with_ctes(J, f"SELECT job_id, job_type, 'queued' AS status, 0 AS attempts, cast(NULL AS varchar) AS result_json, "
                   f"cast(NULL AS varchar) AS error, {A} AS next_attempt_at, {A} AS updated_at FROM ("
                   "SELECT * FROM job WHERE status = 'dead_letter' ORDER BY updated_at, job_id LIMIT 100) "
                   f"WHERE job_type IN ({_KNOWN_SQL})"),
)(lambda spark, d: jl.requeue_candidates(jobs(spark, d), spark.createDataFrame([(t,) for t in KNOWN_TYPES], "job_type string"),
                                         AS_OF, None, 100))


register(
    "cancel_candidates",
    O.with_ctes(J, f"SELECT job_id, job_type, 'canceled' AS status, cast(NULL AS timestamp) AS next_attempt_at, {A} AS updated_at "
                   "FROM (SELECT * FROM job WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 200)"),
)(lambda spark, d: jl.cancel_candidates(jobs(spark, d), AS_OF, None, 200))


register(
    "retention_keep",
    O.with_ctes(J, "SELECT * FROM job WHERE NOT (status IN ('succeeded', 'dead_letter', 'canceled') "
                   f"AND updated_at <= {O.ts(jl.shifted(AS_OF, -86400))})"),
)(lambda spark, d: jl.retention_keep(jobs(spark, d), AS_OF, 86400.0))


def annotations(spark, d):
    j = jobs(spark, d)
    raw = j.select(
        F.col("job_id").alias("annotation_id"),
        F.col("job_type").alias("scope"),
        F.col("error").alias("summary"),
        F.to_json(F.struct("job_id", "attempts")).alias("details_json"),
        F.lit("system").alias("created_by"),
        F.lit("ops").alias("created_by_role"),
        F.col("updated_at").alias("created_at"),
    )
    ok, _ = jl.normalize_annotations(raw)
    return ok


def decisions(spark, d):
    j = jobs(spark, d)
    allowed = F.col("status") != "dead_letter"
    return j.select(
        F.col("job_id").alias("decision_id"),
        F.lower(F.trim(F.col("job_type"))).alias("decision_type"),
        allowed.cast("int").alias("allowed"),
        F.when(allowed, 200).otherwise(503).alias("status_code"),
        F.to_json(F.struct("status", "attempts")).alias("payload_json"),
        F.lit("system").alias("created_by"),
        F.lit("ops").alias("created_by_role"),
        F.col("updated_at").alias("created_at"),
    )


register(
    "incident_log",
    O.with_ctes(J, "SELECT * FROM (SELECT job_id AS annotation_id, "
                   "CASE WHEN lower(trim(job_type)) = '' THEN 'rollout' ELSE lower(trim(job_type)) END AS scope, "
                   "trim(coalesce(error, '')) AS summary, json_object('job_id', job_id, 'attempts', attempts)::varchar AS details_json, "
                   "'system' AS created_by, 'ops' AS created_by_role, updated_at AS created_at FROM job) "
                   "WHERE summary <> '' AND scope = 'type_1' ORDER BY created_at DESC, annotation_id DESC LIMIT 500"),
)(lambda spark, d: jl.list_log(annotations(spark, d), "scope", " TYPE_1", 500))


register(
    "gate_decisions_log",
    O.with_ctes(J, "SELECT * FROM (SELECT job_id AS decision_id, lower(trim(job_type)) AS decision_type, "
                   "CASE WHEN status <> 'dead_letter' THEN 1 ELSE 0 END AS allowed, "
                   "CASE WHEN status <> 'dead_letter' THEN 200 ELSE 503 END AS status_code, "
                   "json_object('status', status, 'attempts', attempts)::varchar AS payload_json, "
                   "'system' AS created_by, 'ops' AS created_by_role, updated_at AS created_at FROM job) "
                   "WHERE decision_type = 'type_2' ORDER BY created_at DESC, decision_id DESC LIMIT 500"),
)(lambda spark, d: jl.list_log(decisions(spark, d), "decision_type", "type_2", 500))


# the log after a sweep (stale recovery, cancelation, retention), each step a
# version of the table in id buckets
def swept(spark, d):
    table = jl.job_table(spark, new_table_path(spark))
    table.write(jobs(spark, d), 0)
    jl.sweep(table, AS_OF, 300.0, cancel=True, older_than_seconds=86400.0)
    return table.read()


_STALE = f"status = 'running' AND updated_at <= {O.ts(jl.shifted(AS_OF, -300))}"
register(
    "job_log_swept",
    O.with_ctes(J + [f"""
recovered AS (
  SELECT * REPLACE (
    CASE WHEN {_STALE} THEN CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'dead_letter' END ELSE status END AS status,
    CASE WHEN {_STALE} THEN CASE WHEN attempts < max_attempts THEN {O.q(STALE_REQUEUED)} ELSE {O.q(STALE_EXHAUSTED)} END ELSE error END AS error,
    CASE WHEN {_STALE} THEN CASE WHEN attempts < max_attempts THEN {A} END ELSE next_attempt_at END AS next_attempt_at,
    CASE WHEN {_STALE} THEN {A} ELSE updated_at END AS updated_at) FROM job
)""", f"""
canceled AS (
  SELECT * REPLACE (CASE WHEN status = 'queued' THEN 'canceled' ELSE status END AS status,
    CASE WHEN status = 'queued' THEN NULL ELSE next_attempt_at END AS next_attempt_at,
    CASE WHEN status = 'queued' THEN {A} ELSE updated_at END AS updated_at) FROM recovered
)"""], f"SELECT * FROM canceled WHERE NOT (status IN ({', '.join(O.q(x) for x in TERMINAL_STATUSES)}) AND updated_at <= {O.ts(jl.shifted(AS_OF, -86400))})"),
)(swept)


# payloads as they come: every eleventh is cut off, every seventh nests its field
def mixed_payloads(df):
    i = F.substring_index("job_id", "_", -1).cast("bigint")
    p = F.col("payload_json")
    return df.withColumn("payload_json", F.when(i % 11 == 0, F.substring(p, 1, 5)).when(i % 7 == 0, F.concat(F.lit('{"steps": ['), p, F.lit("]}"))).otherwise(p))


@register(
    "job_payload_fields",
    O.with_ctes(
        J + ["""
mixed AS (
  SELECT job_id, CASE WHEN n % 11 = 0 THEN substr(payload_json, 1, 5) WHEN n % 7 = 0 THEN concat('{"steps": [', payload_json, ']}')
                      ELSE payload_json END AS p
  FROM (SELECT *, cast(split_part(job_id, '_', 2) AS bigint) AS n FROM job)
)"""],
        "SELECT job_id, json_valid(p) AS payload_json_valid, CASE WHEN json_valid(p) THEN try_cast(json_extract_string(p, '$.k') AS bigint) END AS k, "
        "CASE WHEN json_valid(p) THEN try_cast(json_extract_string(p, '$.steps[0].k') AS bigint) END AS first_k FROM mixed",
    ),
)
def q_job_payload_fields(spark, d):
    rows = decode_fields(mixed_payloads(jobs(spark, d)), "payload_json", {"k": ("$.k", "bigint"), "first_k": ("$.steps[0].k", "bigint")})
    return rows.select("job_id", "payload_json_valid", "k", "first_k")
