"""Alert signals, remediation, release gates and rollout decisions.

Re-aimed from one service to a table: one row per monitored group (by
default ``job_type``) and threshold preset. All counters come from ONE
conditional aggregate over the job log (a pass per preset is never
needed: each distinct dead-letter window is one extra conditional count);
the presets (literal configuration) are attached to each aggregated row by
exploding a literal array, and every later decision is a column expression
on that signal table.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, literal_map
from ..schema import (
    ALL_CLEAR_REASON,
    NO_ACTION,
    POLICY_PRESETS,
    PROFILE_ACTIONS,
    PROFILE_MODES,
    PROFILE_READINESS,
    REMEDIATION_CLEAR,
    REMEDIATION_PENDING_SUFFIX,
    SIGNAL_ENDPOINT,
    SIGNAL_PRIORITY,
    SIGNAL_RECOMMENDATION,
)
from .job_log import seconds_between, shifted, ts_lit

BALANCED = [p for p in POLICY_PRESETS if p[0] == "balanced"]


def _wcol(w: float) -> str:
    return f"_recent_{int(round(w * 1000))}"


def signals(jobs: DataFrame, as_of: str, presets=None, group_cols: list[str] | None = None,
            heartbeat: DataFrame | None = None) -> DataFrame:
    """One row per (group, policy) with the three signals and overall severity."""
    group_cols = ["job_type"] if group_cols is None else group_cols
    presets = presets or BALANCED
    windows = sorted({max(1.0, float(p[2])) for p in presets})
    st, upd = F.col("status"), F.col("updated_at")
    dead = st == "dead_letter"
    agg = jobs.groupBy(*group_cols).agg(
        count_if(st == "queued").alias("queued"),
        count_if(st == "running").alias("running"),
        F.min(F.when(st == "queued", F.col("created_at"))).alias("oldest_queued_at"),
        count_if(dead).alias("total_dead_letter"),
        *[count_if(dead & (upd >= ts_lit(shifted(as_of, -w)))).alias(_wcol(w)) for w in windows],
    )
    if heartbeat is not None:
        agg = agg.join(heartbeat.select(*group_cols, "worker_alive", "paused"), group_cols, "left")
        agg = agg.withColumn("worker_alive", F.coalesce(F.col("worker_alive"), F.lit(True))).withColumn(
            "paused", F.coalesce(F.col("paused"), F.lit(False))
        )
    else:
        agg = agg.withColumn("worker_alive", F.lit(True)).withColumn("paused", F.lit(False))
    # the presets are literal configuration: one exploded literal array
    # attaches them to each aggregated group row (groups x presets, no join)
    preset_items = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(float(a)).alias("queue_age_threshold_seconds"),
                 F.lit(float(w)).alias("dead_letter_window_seconds"), F.lit(float(t)).alias("dead_letter_threshold_per_minute"))
        for p, a, w, t in presets
    ])
    out = agg.withColumn("_preset", F.explode(preset_items)).select("*", "_preset.*").drop("_preset")
    qa_thr = F.greatest(F.col("queue_age_threshold_seconds"), F.lit(0.0))
    window = F.greatest(F.col("dead_letter_window_seconds"), F.lit(1.0))
    dl_thr = F.greatest(F.col("dead_letter_threshold_per_minute"), F.lit(0.0))
    recent = F.lit(None).cast("bigint")
    for w in windows:
        recent = F.when(window == F.lit(w), F.col(_wcol(w))).otherwise(recent)
    age = F.when(
        F.col("oldest_queued_at").isNotNull(),
        F.greatest(seconds_between(F.col("oldest_queued_at"), ts_lit(as_of)), F.lit(0.0)),
    )
    out = (
        out.withColumn("oldest_queued_age_seconds", age)
        .withColumn("queue_age_breached", F.coalesce(F.col("oldest_queued_age_seconds") >= qa_thr, F.lit(False)))
        .withColumn("recent_dead_letter", recent)
        .withColumn("dead_letter_rate_per_minute", F.col("recent_dead_letter") / (window / F.lit(60.0)))
        .withColumn("dead_letter_rate_breached", F.col("dead_letter_rate_per_minute") >= dl_thr)
        .withColumn("worker_breached", ~F.col("worker_alive"))
    )
    severity = (
        F.when(F.col("worker_breached") | F.col("dead_letter_rate_breached"), "critical")
        .when(F.col("queue_age_breached"), "warning")
        .otherwise("ok")
    )
    out = out.withColumn("severity", severity).withColumn("breached", F.col("severity") != "ok")
    return out.drop(*[_wcol(w) for w in windows])


SNAPSHOT_COLUMNS = [
    "severity", "breached", "worker_alive", "paused", "queued", "running", "queue_age_breached",
    "dead_letter_rate_breached", "oldest_queued_at", "oldest_queued_age_seconds", "recent_dead_letter",
    "total_dead_letter", "dead_letter_rate_per_minute",
]


def snapshot(sig: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    group_cols = ["job_type"] if group_cols is None else group_cols
    return sig.select(*group_cols, "policy", *SNAPSHOT_COLUMNS)


def _signal_items() -> Column:
    """array<struct> of the three signals in their fixed order."""
    def item(name, status_if_breached, breached):
        return F.struct(
            F.lit(name).alias("signal"),
            F.when(breached, status_if_breached).otherwise("ok").alias("status"),
            breached.alias("breached"),
            F.lit(SIGNAL_PRIORITY[name]).alias("priority"),
            F.lit(SIGNAL_RECOMMENDATION[name]).alias("recommendation"),
            F.lit(SIGNAL_ENDPOINT[name]).alias("endpoint_hint"),
        )
    return F.array(
        item("worker", "critical", F.col("worker_breached")),
        item("queue_age", "warning", F.col("queue_age_breached")),
        item("dead_letter_rate", "critical", F.col("dead_letter_rate_breached")),
    )


def with_failing(sig: DataFrame) -> DataFrame:
    failing = F.filter(_signal_items(), lambda s: s["breached"])
    return sig.withColumn("_failing", failing).withColumn("failing_count", F.size("_failing")).withColumn(
        "total_signals", F.lit(3)
    )


def failing_signals(sig: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Long form: one row per failing signal, or one 'no action' row per healthy group."""
    group_cols = ["job_type"] if group_cols is None else group_cols
    f = with_failing(sig)
    none = F.array(F.struct(
        F.lit(None).cast("string").alias("signal"), F.lit("ok").alias("status"), F.lit(False).alias("breached"),
        F.lit(None).cast("int").alias("priority"), F.lit(NO_ACTION).alias("recommendation"),
        F.lit(None).cast("string").alias("endpoint_hint"),
    ))
    rows = F.when(F.size("_failing") == 0, none).otherwise(F.col("_failing"))
    return f.select(*group_cols, "policy", "severity", "breached", "failing_count", "total_signals",
                    F.posexplode(rows).alias("position", "s")).select(
        *group_cols, "policy", "severity", "breached", "failing_count", "total_signals", "position",
        F.col("s.signal").alias("signal"), F.col("s.status").alias("signal_status"),
        F.col("s.recommendation").alias("recommendation"),
    )


def remediation_actions(sig: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Failing signals as actions ordered by priority (worker, dead letters, queue age)."""
    group_cols = ["job_type"] if group_cols is None else group_cols
    f = with_failing(sig)
    ordered = F.array_sort(f["_failing"], lambda a, b: (a["priority"] - b["priority"]).cast("int"))
    return f.select(*group_cols, "policy", "severity", F.posexplode(ordered).alias("position", "s")).select(
        *group_cols, "policy", "severity", "position",
        F.col("s.signal").alias("signal"), F.col("s.status").alias("status"), F.col("s.priority").alias("priority"),
        F.col("s.recommendation").alias("action"), F.col("s.endpoint_hint").alias("endpoint_hint"),
    )


def remediation_summary(sig: DataFrame) -> DataFrame:
    f = with_failing(sig)
    fl = F.col("_failing")
    top = F.when(F.size(fl) > 0, F.array_min(F.transform(fl, lambda s: F.struct(s["priority"].alias("p"), s["signal"].alias("n"))))["n"])
    allowed = ~F.col("breached")
    return (
        f.withColumn("total_actions", F.size(fl))
        .withColumn("critical_actions", F.size(F.filter(fl, lambda s: s["status"] == "critical")))
        .withColumn("warning_actions", F.size(F.filter(fl, lambda s: s["status"] == "warning")))
        .withColumn("top_priority_signal", top)
        .withColumn("deployment_allowed", allowed)
        .withColumn("recommended_status_code", F.when(allowed, 200).otherwise(503))
        .withColumn(
            "summary",
            F.when(F.size(fl) > 0, F.concat(F.size(fl).cast("string"), F.lit(REMEDIATION_PENDING_SUFFIX)))
            .otherwise(REMEDIATION_CLEAR),
        )
        .drop("_failing")
    )


def _reasons(fl: Column) -> Column:
    joined = F.array_join(F.transform(fl, lambda s: F.concat(s["signal"], F.lit(": "), s["recommendation"])), " | ")
    return F.when(F.size(fl) > 0, joined).otherwise(F.lit(ALL_CLEAR_REASON))


def gate(sig: DataFrame) -> DataFrame:
    """Health, relaxed/strict gate results, advice mode and reasons (reasons joined by ' | ')."""
    f = with_failing(sig)
    sev = F.col("severity")
    relaxed, strict = sev != "critical", sev == "ok"
    mode = F.when(strict, "strict").when(relaxed, "relaxed").otherwise("block")
    allowed = relaxed
    return (
        f.withColumn("healthy", relaxed)
        .withColumn("healthy_strict", strict)
        .withColumn("relaxed_pass", relaxed)
        .withColumn("strict_pass", strict)
        .withColumn("relaxed_status_code", F.when(relaxed, 200).otherwise(503))
        .withColumn("strict_status_code", F.when(strict, 200).otherwise(503))
        .withColumn("recommended_mode", mode)
        .withColumn("deployment_allowed", allowed)
        .withColumn("recommended_status_code", F.when(allowed, 200).otherwise(503))
        .withColumn("reasons", _reasons(F.col("_failing")))
        .drop("_failing")
    )


GATE_MODES = ("strict", "relaxed", "advice")


def gate_evaluation(sig: DataFrame, modes=("advice",)) -> DataFrame:
    """One row per signal row and gate mode asked for.

    'strict' lets only a healthy group pass, 'relaxed' a warning too, 'advice'
    what the advice of ``gate`` allows. Any other mode is a ValueError.
    """
    asked = [m.strip().lower() for m in modes]
    if not asked or set(asked) - set(GATE_MODES):
        raise ValueError(f"mode must be one of: {', '.join(GATE_MODES)}")
    rows = gate(sig).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in asked])))
    mode, advised = F.col("mode"), F.col("mode") == "advice"
    passed = F.when(mode == "strict", F.col("strict_pass")).when(mode == "relaxed", F.col("relaxed_pass")).otherwise(F.col("deployment_allowed"))
    return (
        rows.withColumn("pass_gate", passed)
        .withColumn("deployment_allowed", passed)
        .withColumn("recommended_status_code", F.when(passed, 200).otherwise(503))
        .withColumn("effective_fail_on_warning", F.when(~advised, mode == "strict"))
        .withColumn("recommended_mode", F.when(advised, F.col("recommended_mode")).otherwise(mode))
    )


def profile_evaluation(sig: DataFrame, profiles=("dev", "staging", "prod")) -> DataFrame:
    """The gate of each release profile in the mode fixed for it: one row per signal row
    and profile, numbered by ``stage`` in the order given (the default is the
    order of promotion). An unknown profile is a ValueError."""
    mode_of = dict(PROFILE_MODES)
    asked = [p.strip().lower() for p in profiles]
    if not asked or set(asked) - set(mode_of):
        raise ValueError(f"profile must be one of: {', '.join(mode_of)}")
    stages = [F.struct(F.lit(i).alias("stage"), F.lit(p).alias("profile"), F.lit(mode_of[p]).alias("profile_mode")) for i, p in enumerate(asked)]
    judged = gate_evaluation(sig, sorted({mode_of[p] for p in asked}))
    rows = judged.withColumn("_s", F.explode(F.filter(F.array(*stages), lambda s: s["profile_mode"] == F.col("mode"))))
    return rows.select("*", "_s.*").drop("_s")


def suppression_active(until: str | None, as_of: str | None) -> bool:
    """Whether ``as_of`` (UTC wall clock) is not after the ISO-8601 ``until``
    ('Z', an offset, or naive = UTC). Both are parameters, so this is decided
    when the plan is built."""
    if not until or not until.strip() or as_of is None:
        return False
    parsed = datetime.fromisoformat(until.strip().replace("Z", "+00:00"))
    if parsed.tzinfo is not None:
        parsed = parsed.astimezone(timezone.utc).replace(tzinfo=None)
    return datetime.fromisoformat(as_of) <= parsed


def rollout(sig: DataFrame, suppress_warning_until: str | None = None, as_of: str | None = None) -> DataFrame:
    """Profile gates (prod=strict, staging=advice, dev=relaxed) and the rollout decision.

    A warning (never a critical) can be suppressed until an instant given
    as ISO text ('Z' or naive = UTC).
    """
    sev = F.col("severity")
    prod_pass, relaxed = sev == "ok", sev != "critical"
    staging_pass, dev_pass = prod_pass | relaxed, relaxed
    profile = F.when(prod_pass, "prod").when(staging_pass, "staging").when(dev_pass, "dev").otherwise("block")
    allowed = profile != "block"
    path = (
        F.when(profile == "prod", F.lit("dev>staging>prod"))
        .when(profile == "staging", F.lit("dev>staging"))
        .when(profile == "dev", F.lit("dev"))
        .otherwise(F.lit(""))
    )
    blocking = F.concat_ws(
        ",", F.when(~dev_pass, F.lit("dev")), F.when(~staging_pass, F.lit("staging")), F.when(~prod_pass, F.lit("prod"))
    )
    eligible = prod_pass.cast("int") + staging_pass.cast("int") + dev_pass.cast("int")
    active = F.lit(suppression_active(suppress_warning_until, as_of))
    suppressed = active & (sev == "warning")
    return (
        sig.withColumn("prod_pass", prod_pass)
        .withColumn("staging_pass", staging_pass)
        .withColumn("dev_pass", dev_pass)
        .withColumn("recommended_profile", profile)
        .withColumn("next_profile", F.when(allowed, profile))
        .withColumn("recommended_action", literal_map(PROFILE_ACTIONS)[profile])
        .withColumn("promotion_path", path)
        .withColumn("highest_eligible_profile", F.when(allowed, profile))
        .withColumn("release_readiness", literal_map(PROFILE_READINESS)[profile])
        .withColumn("blocking_profiles", blocking)
        .withColumn("eligible_stages", eligible)
        .withColumn("blocked_stages", F.lit(3) - eligible)
        .withColumn("total_stages", F.lit(3))
        .withColumn("suppression_active", active)
        .withColumn("suppressed", suppressed)
        .withColumn("deployment_allowed", allowed | suppressed)
        .withColumn("recommended_status_code", F.when(allowed | suppressed, 200).otherwise(503))
    )
