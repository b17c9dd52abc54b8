"""Queries: alert signals, remediation, gates, rollout, policy matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ...operators import job_log as jl, ops_gate as og
from ...schema import (
    ALL_CLEAR_REASON,
    NO_ACTION,
    POLICY_PRESETS,
    PROFILE_ACTIONS,
    PROFILE_READINESS,
    REMEDIATION_CLEAR,
    REMEDIATION_PENDING_SUFFIX,
    SIGNAL_ENDPOINT,
    SIGNAL_PRIORITY,
    SIGNAL_RECOMMENDATION,
)

from .common import AS_OF, J, jobs, register


SIG_BAL = J + O.signals_sql(og.BALANCED, AS_OF, jl.shifted)
SIG_ALL = J + O.signals_sql(POLICY_PRESETS, AS_OF, jl.shifted)
SL = O.signal_rows(SIGNAL_RECOMMENDATION, SIGNAL_PRIORITY)
SNAP_SQL = "SELECT job_type, policy, " + ", ".join(og.SNAPSHOT_COLUMNS) + " FROM sig"


def sig(spark, d, presets=None):
    return og.signals(jobs(spark, d), AS_OF, presets or og.BALANCED)


SUMMARY_COLS = ["job_type", "policy", "severity", "breached", "failing_count", "total_actions", "critical_actions",
                "warning_actions", "top_priority_signal", "deployment_allowed", "recommended_status_code", "summary"]


GATE_COLS = ["job_type", "policy", "severity", "breached", "failing_count", "healthy", "healthy_strict", "relaxed_pass",
             "strict_pass", "relaxed_status_code", "strict_status_code", "recommended_mode", "deployment_allowed",
             "recommended_status_code", "reasons"]


_REASONS = (
    "CASE WHEN failing_count = 0 THEN " + O.q(ALL_CLEAR_REASON) + " ELSE concat_ws(' | ', "
    + ", ".join(f"CASE WHEN {flag} THEN {O.q(name + ': ' + SIGNAL_RECOMMENDATION[name])} END"
                for name, flag in [("worker", "worker_breached"), ("queue_age", "queue_age_breached"),
                                   ("dead_letter_rate", "dead_letter_rate_breached")])
    + ") END"
)


ROLLOUT_COLS = ["job_type", "policy", "severity", "prod_pass", "staging_pass", "dev_pass", "recommended_profile",
                "next_profile", "recommended_action", "promotion_path", "highest_eligible_profile", "release_readiness",
                "blocking_profiles", "eligible_stages", "blocked_stages", "total_stages", "suppression_active", "suppressed",
                "deployment_allowed", "recommended_status_code"]


SUPPRESS_UNTIL = "2024-01-31T06:00:00Z"


def rollout_sql(suppress_active: bool) -> str:
    prof = "CASE WHEN severity = 'ok' THEN 'prod' WHEN severity <> 'critical' THEN 'staging' ELSE 'block' END"
    act = "true" if suppress_active else "false"
    return (
        f"SELECT *, allowed OR suppressed AS deployment_allowed, "
        "CASE WHEN allowed OR suppressed THEN 200 ELSE 503 END AS recommended_status_code FROM ("
        "SELECT job_type, policy, severity, severity = 'ok' AS prod_pass, severity <> 'critical' AS staging_pass, "
        f"severity <> 'critical' AS dev_pass, {prof} AS recommended_profile, "
        f"CASE WHEN {prof} <> 'block' THEN {prof} END AS next_profile, "
        f"CASE {prof} " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in PROFILE_ACTIONS.items()) + " END AS recommended_action, "
        f"CASE {prof} WHEN 'prod' THEN 'dev>staging>prod' WHEN 'staging' THEN 'dev>staging' WHEN 'dev' THEN 'dev' ELSE '' END AS promotion_path, "
        f"CASE WHEN {prof} <> 'block' THEN {prof} END AS highest_eligible_profile, "
        f"CASE {prof} " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in PROFILE_READINESS.items()) + " END AS release_readiness, "
        "concat_ws(',', CASE WHEN severity = 'critical' THEN 'dev' END, CASE WHEN severity = 'critical' THEN 'staging' END, "
        "CASE WHEN severity <> 'ok' THEN 'prod' END) AS blocking_profiles, "
        "cast(severity = 'ok' AS int) + 2 * cast(severity <> 'critical' AS int) AS eligible_stages, "
        "3 - (cast(severity = 'ok' AS int) + 2 * cast(severity <> 'critical' AS int)) AS blocked_stages, 3 AS total_stages, "
        f"{act} AS suppression_active, {act} AND severity = 'warning' AS suppressed, {prof} <> 'block' AS allowed FROM sig)"
    )


MATRIX_COLS = ["job_type", "policy", "queue_age_threshold_seconds", "dead_letter_window_seconds",
               "dead_letter_threshold_per_minute", "severity", "breached", "failing_count", "recent_dead_letter",
               "dead_letter_rate_per_minute", "recommended_profile", "release_readiness", "deployment_allowed",
               "recommended_status_code"]


def family(suffix: str, one: list[str], every: list[str], sig, presets, as_of: str) -> None:
    """The gate queries over one view: ``one`` policy, and ``every`` policy for the matrix."""
    register(f"ops_signals{suffix}", O.with_ctes(one, SNAP_SQL))(lambda spark, d: og.snapshot(sig(spark, d)))

    register(
        f"ops_failing{suffix}",
        O.with_ctes(
            one + [SL],
            "SELECT job_type, policy, severity, breached, cast(failing_count AS int) AS failing_count, 3 AS total_signals, "
            "cast(row_number() OVER (PARTITION BY job_type, policy ORDER BY pos0) - 1 AS int) AS position, signal, signal_status, "
            "recommendation FROM sl WHERE b "
            "UNION ALL SELECT job_type, policy, severity, breached, cast(failing_count AS int), 3, 0, cast(NULL AS varchar), 'ok', "
            f"{O.q(NO_ACTION)} FROM sig WHERE failing_count = 0",
        ),
    )(lambda spark, d: og.failing_signals(sig(spark, d)))

    register(
        f"ops_remediation{suffix}",
        O.with_ctes(
            one + [SL],
            "SELECT job_type, policy, severity, cast(row_number() OVER (PARTITION BY job_type, policy ORDER BY priority) - 1 AS int) "
            "AS position, signal, signal_status AS status, priority, recommendation AS action, "
            + "CASE signal " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in SIGNAL_ENDPOINT.items())
            + " END AS endpoint_hint FROM sl WHERE b",
        ),
    )(lambda spark, d: og.remediation_actions(sig(spark, d)))

    register(
        f"ops_remediation_summary{suffix}",
        O.with_ctes(
            one,
            "SELECT job_type, policy, severity, breached, cast(failing_count AS int) AS failing_count, "
            "cast(failing_count AS int) AS total_actions, "
            "cast(worker_breached AS int) + cast(dead_letter_rate_breached AS int) AS critical_actions, "
            "cast(queue_age_breached AS int) AS warning_actions, "
            "CASE WHEN worker_breached THEN 'worker' WHEN dead_letter_rate_breached THEN 'dead_letter_rate' "
            "WHEN queue_age_breached THEN 'queue_age' END AS top_priority_signal, NOT breached AS deployment_allowed, "
            "CASE WHEN breached THEN 503 ELSE 200 END AS recommended_status_code, "
            f"CASE WHEN failing_count > 0 THEN concat(cast(failing_count AS varchar), {O.q(REMEDIATION_PENDING_SUFFIX)}) "
            f"ELSE {O.q(REMEDIATION_CLEAR)} END AS summary FROM sig",
        ),
    )(lambda spark, d: og.remediation_summary(sig(spark, d)).select(*SUMMARY_COLS))

    register(
        f"ops_gate{suffix}",
        O.with_ctes(
            one,
            "SELECT job_type, policy, severity, breached, cast(failing_count AS int) AS failing_count, "
            "severity <> 'critical' AS healthy, severity = 'ok' AS healthy_strict, severity <> 'critical' AS relaxed_pass, "
            "severity = 'ok' AS strict_pass, CASE WHEN severity <> 'critical' THEN 200 ELSE 503 END AS relaxed_status_code, "
            "CASE WHEN severity = 'ok' THEN 200 ELSE 503 END AS strict_status_code, "
            "CASE WHEN severity = 'ok' THEN 'strict' WHEN severity <> 'critical' THEN 'relaxed' ELSE 'block' END AS recommended_mode, "
            "severity <> 'critical' AS deployment_allowed, CASE WHEN severity <> 'critical' THEN 200 ELSE 503 END AS recommended_status_code, "
            f"{_REASONS} AS reasons FROM sig",
        ),
    )(lambda spark, d: og.gate(sig(spark, d)).select(*GATE_COLS))

    register(
        f"ops_rollout{suffix}",
        O.with_ctes(one, "SELECT " + ", ".join(ROLLOUT_COLS) + f" FROM ({rollout_sql(True)})"),
    )(lambda spark, d: og.rollout(sig(spark, d), SUPPRESS_UNTIL, as_of).select(*ROLLOUT_COLS))

    register(
        f"ops_policy_matrix{suffix}",
        O.with_ctes(
            every,
            "SELECT r.job_type, r.policy, queue_age_threshold_seconds, dead_letter_window_seconds, dead_letter_threshold_per_minute, "
            "r.severity, breached, cast(failing_count AS int) AS failing_count, recent_dead_letter, dead_letter_rate_per_minute, "
            "recommended_profile, release_readiness, deployment_allowed, recommended_status_code "
            f"FROM ({rollout_sql(False)}) r JOIN sig ON r.job_type = sig.job_type AND r.policy = sig.policy",
        ),
    )(lambda spark, d: og.rollout(og.with_failing(sig(spark, d, presets)).drop("_failing")).select(*MATRIX_COLS))


family("", SIG_BAL, SIG_ALL, sig, POLICY_PRESETS, AS_OF)


# -- the same signals per queue, in the middle of the log: of the jobs of the last half day,
# some queues hold a waiting job, some a fresh dead letter, some have a silent
# worker, some neither, so every severity and every signal occurs

QUEUES = 600
QUEUE_AS_OF = "2024-01-20 12:00:00"
HORIZON = 43200.0
QUEUE_PRESETS = [("balanced", 300.0, 7200.0, 0.004), ("patient", 14400.0, 3600.0, 0.01), ("lenient", 36000.0, 3600.0, 0.5)]


def queue_jobs(spark, d):
    j = jobs(spark, d)
    recent = F.col("created_at").between(jl.ts_lit(jl.shifted(QUEUE_AS_OF, -HORIZON)), jl.ts_lit(QUEUE_AS_OF))
    number = F.substring_index("job_id", "_", -1).cast("bigint") % QUEUES
    return j.where(recent).withColumn("job_type", F.concat(F.lit("queue_"), number.cast("string")))


def heartbeats(rows):
    """A worker counts as alive if its queue moved in the last nine hours; a queue whose last change was a cancelation is paused."""
    last = F.max(F.struct("updated_at", "job_id", "status")).alias("last")
    beat = rows.groupBy("job_type").agg(last)
    return beat.select("job_type", (F.col("last.updated_at") >= jl.ts_lit(jl.shifted(QUEUE_AS_OF, -32400.0))).alias("worker_alive"),
                       (F.col("last.status") == "canceled").alias("paused"))


def queue_sig(spark, d, presets=None):
    rows = queue_jobs(spark, d)
    return og.signals(rows, QUEUE_AS_OF, presets or QUEUE_PRESETS[:1], heartbeat=heartbeats(rows))


_QUEUE_CTES = [J[0].replace("job AS (", "every_job AS (", 1)] + [f"""
job AS (
  SELECT * REPLACE (concat('queue_', cast(cast(split_part(job_id, '_', 2) AS bigint) % {QUEUES} AS varchar)) AS job_type) FROM every_job
  WHERE created_at BETWEEN {O.ts(jl.shifted(QUEUE_AS_OF, -HORIZON))} AND {O.ts(QUEUE_AS_OF)}
)""", f"""
beat AS (
  SELECT job_type AS beat_type, max(updated_at) >= {O.ts(jl.shifted(QUEUE_AS_OF, -32400.0))} AS worker_alive,
         arg_max(status, (updated_at, job_id)) = 'canceled' AS paused FROM job GROUP BY job_type
)"""]


def _queue_sql(presets) -> list[str]:
    made = O.signals_sql(presets, QUEUE_AS_OF, jl.shifted)
    plain = "SELECT g.*, p.*, true AS worker_alive, false AS paused, false AS worker_breached,"
    joined = [c.replace(plain, "SELECT g.*, p.*, beat.worker_alive, beat.paused, NOT beat.worker_alive AS worker_breached,")
              .replace("FROM g CROSS JOIN", "FROM g JOIN beat ON g.job_type = beat.beat_type CROSS JOIN") for c in made]
    assert joined != made
    return _QUEUE_CTES + joined


EVAL_COLS = ["job_type", "policy", "severity", "breached", "mode", "pass_gate", "deployment_allowed", "recommended_status_code",
             "reasons", "effective_fail_on_warning", "recommended_mode"]
_EVAL = """
judged AS (
  SELECT job_type, policy, severity, severity <> 'ok' AS breached, mode, CASE WHEN severity = 'ok' THEN true WHEN severity = 'warning' THEN mode <> 'strict'
         ELSE false END AS pass_gate, %s AS reasons
  FROM (SELECT *, cast(worker_breached AS int) + cast(queue_age_breached AS int) + cast(dead_letter_rate_breached AS int) AS failing_count
        FROM sig) CROSS JOIN (VALUES ('strict'), ('relaxed'), ('advice')) m(mode)
)""" % _REASONS
_EVAL_ROWS = """SELECT job_type, policy, severity, breached, mode, pass_gate, pass_gate AS deployment_allowed,
       CASE WHEN pass_gate THEN 200 ELSE 503 END AS recommended_status_code, reasons,
       CASE mode WHEN 'strict' THEN true WHEN 'relaxed' THEN false END AS effective_fail_on_warning,
       CASE WHEN mode <> 'advice' THEN mode WHEN severity = 'ok' THEN 'strict' WHEN severity = 'warning' THEN 'relaxed' ELSE 'block' END
         AS recommended_mode FROM judged"""


register("ops_gate_evaluation", O.with_ctes(_queue_sql(QUEUE_PRESETS) + [_EVAL], _EVAL_ROWS))(
    lambda spark, d: og.gate_evaluation(queue_sig(spark, d, QUEUE_PRESETS), (" Strict", "relaxed", "ADVICE")).select(*EVAL_COLS))


register(
    "ops_profile_stages",
    O.with_ctes(
        _queue_sql(QUEUE_PRESETS) + [_EVAL],
        f"SELECT stage, profile, profile_mode, e.* FROM ({_EVAL_ROWS}) e JOIN (VALUES (0, 'dev', 'relaxed'), (1, 'staging', 'advice'), "
        "(2, 'prod', 'strict')) s(stage, profile, profile_mode) ON e.mode = s.profile_mode",
    ),
)(lambda spark, d: og.profile_evaluation(queue_sig(spark, d, QUEUE_PRESETS)).select("stage", "profile", "profile_mode", *EVAL_COLS))


family("_queues", _queue_sql(QUEUE_PRESETS[:1]), _queue_sql(QUEUE_PRESETS), queue_sig, QUEUE_PRESETS, QUEUE_AS_OF)
