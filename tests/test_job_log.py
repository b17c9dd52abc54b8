"""Job-log operators on small fixtures: age, rate, trend, recovery, requeue, gates."""

from datetime import datetime

from creditloom.operators import job_log as jl
from creditloom.operators import ops_gate as og
from creditloom.schema import NO_ACTION
from creditloom.schema import JOB_SCHEMA, STALE_EXHAUSTED, STALE_REQUEUED

AS_OF = "2026-01-01 00:00:00"


def job(job_id, status, created, updated=None, job_type="t", error=None, attempts=0, max_attempts=3, next_at=None):
    return (job_id, job_type, status, "{}", None, error, attempts, max_attempts, 60.0, next_at, created, updated or created)


def frame(spark, rows):
    return spark.createDataFrame(rows, JOB_SCHEMA)


D2000, D2001, D2099 = datetime(2000, 1, 1), datetime(2001, 1, 1), datetime(2099, 1, 1)


def test_queue_age_breach_and_oldest_first(spark):
    jobs = frame(spark, [job("a", "queued", D2001), job("b", "queued", D2000)])
    r = jl.queue_age(jobs, AS_OF, 1).first()
    assert r.breached and r.queued == 2 and r.oldest_queued_at == D2000
    assert [x.job_id for x in jl.oldest_queued(jobs, 10).collect()] == ["b", "a"]


def test_queue_age_empty_not_breached(spark):
    r = jl.queue_age(frame(spark, [job("a", "running", D2000)]), AS_OF, 0).first()
    assert r.queued == 0 and not r.breached


def test_dead_letter_rate_thresholds(spark):
    jobs = frame(spark, [job("a", "dead_letter", D2000, datetime(2025, 12, 31, 23, 59, 30))])
    assert jl.dead_letter_rate(jobs, AS_OF, 60, 0.01).first().breached
    assert not jl.dead_letter_rate(jobs, AS_OF, 60, 1000).first().breached


def test_top_types_errors_recent(spark):
    jobs = frame(spark, [
        job("1", "dead_letter", D2000, job_type="a", error="timeout"),
        job("2", "dead_letter", D2000, D2001, job_type="a", error="timeout"),
        job("3", "dead_letter", D2000, job_type="b", error="validation"),
        job("4", "dead_letter", D2000, job_type="b", error="  "),
    ])
    assert [(r.job_type, r.dead_letter) for r in jl.dead_letter_top_types(jobs).collect()] == [("a", 2), ("b", 2)]
    errs = [(r.error_message, r.dead_letter) for r in jl.dead_letter_errors(jobs).collect()]
    assert errs == [("timeout", 2), ("(no error message)", 1), ("validation", 1)]
    assert jl.recent_dead_letters(jobs, 1).first().job_id == "2"


def test_trend_up(spark):
    jobs = frame(spark, [job("1", "dead_letter", D2000), job("2", "dead_letter", D2099), job("3", "dead_letter", D2099)])
    r = jl.dead_letter_trend(jobs, AS_OF, 3600).first()
    assert (r.recent_count, r.previous_count, r.delta, r.direction) == (2, 0, 2, "up")


def test_stale_recovery(spark):
    jobs = frame(spark, [job("a", "running", D2000, attempts=1, max_attempts=3),
                         job("b", "running", D2000, attempts=2, max_attempts=2)])
    got = {r.job_id: (r.status, r.error) for r in jl.stale_recovery(jobs, AS_OF, 300).collect()}
    assert got == {"a": ("queued", STALE_REQUEUED), "b": ("dead_letter", STALE_EXHAUSTED)}


def test_requeue_limit_and_known_types(spark):
    jobs = frame(spark, [job("a", "dead_letter", D2000), job("b", "dead_letter", D2001),
                         job("c", "dead_letter", D2000, job_type="unknown")])
    known = spark.createDataFrame([("t",)], "job_type string")
    assert jl.requeue_candidates(jobs, known, AS_OF, limit=1).count() == 1
    assert jl.requeue_candidates(jobs, known, AS_OF, limit=10).count() == 2


def test_retry_backoff(spark):
    fails = frame(spark, [job("a", "running", D2000, attempts=2, max_attempts=3, error="boom"),
                          job("b", "running", D2000, attempts=3, max_attempts=3, error="boom")])
    got = {r.job_id: (r.status, r.next_attempt_at) for r in jl.retry_transition(fails, AS_OF, 0.2).collect()}
    assert got["a"] == ("queued", datetime(2026, 1, 1, 0, 0, 0, 400000))
    assert got["b"] == ("dead_letter", None)


def test_signals_severity_and_suppression(spark):
    warn = frame(spark, [job("a", "queued", D2000)])
    s = og.signals(warn, AS_OF)
    r = og.rollout(s, "2999-01-01T00:00:00Z", AS_OF).first()
    assert r.severity == "warning" and r.suppressed and r.deployment_allowed and r.recommended_status_code == 200
    hb = spark.createDataFrame([("t", False, False)], "job_type string, worker_alive boolean, paused boolean")
    crit = og.signals(warn, AS_OF, heartbeat=hb)
    r = og.rollout(crit, "2999-01-01T00:00:00Z", AS_OF).first()
    assert r.severity == "critical" and not r.suppressed and not r.deployment_allowed and r.recommended_status_code == 503
    g = og.gate(crit).first()
    assert g.recommended_mode == "block" and g.reasons.startswith("worker: ")
    acts = [(a.signal, a.priority) for a in og.remediation_actions(crit).orderBy("position").collect()]
    assert acts == [("worker", 1), ("queue_age", 3)]


def test_ok_group_has_no_action_row(spark):
    s = og.signals(frame(spark, [job("a", "succeeded", D2000)]), AS_OF)
    rows = og.failing_signals(s).collect()
    assert len(rows) == 1 and rows[0].signal is None and rows[0].recommendation == NO_ACTION
    assert og.rollout(s).first().recommended_profile == "prod"


def test_retention_and_cancel(spark):
    jobs = frame(spark, [job("a", "succeeded", D2000), job("b", "queued", D2000), job("c", "queued", D2001)])
    assert sorted(r.job_id for r in jl.retention_keep(jobs, AS_OF).collect()) == ["b", "c"]
    assert [r.job_id for r in jl.cancel_candidates(jobs, AS_OF, limit=1).collect()] == ["b"]
    assert jl.cancel_candidates(jobs, AS_OF).count() == 2


def test_next_state_overlay_and_lookup(spark):
    jobs = frame(spark, [job("a", "running", D2000, attempts=1), job("b", "queued", D2001)])
    changes = jl.stale_recovery(jobs, AS_OF, 300)
    merged = jl.apply_next_state(jobs, changes)
    got = {r.job_id: (r.status, r.error) for r in merged.collect()}
    assert got == {"a": ("queued", STALE_REQUEUED), "b": ("queued", None)}
    assert merged.columns == jobs.columns
    assert jl.job_by_id(merged, "a").first().status == "queued"


def test_annotation_log_normalized_and_listed(spark):
    raw = spark.createDataFrame(
        [("1", " Rollout ", " deploy paused ", '{"k": 1}', "u", "ops", D2000),
         ("2", "", "  ", "{}", "u", "ops", D2001),
         ("3", "", "note", "{}", "u", "ops", D2099)],
        "annotation_id string, scope string, summary string, details_json string, created_by string, "
        "created_by_role string, created_at timestamp_ntz",
    )
    ok, rejected = jl.normalize_annotations(raw)
    assert rejected.count() == 1
    listed = [(r.annotation_id, r.scope, r.summary) for r in jl.list_log(ok, "scope", "ROLLOUT").collect()]
    assert listed == [("3", "rollout", "note"), ("1", "rollout", "deploy paused")]
    from creditloom.sources.files import decode_json

    assert decode_json(ok, "details_json", "k int").filter("annotation_id = '1'").first().details.k == 1


def test_policy_presets_differ_on_dead_letter_rate(spark):
    # 8 dead letters in the last 20 minutes: 0.13/min over 1 h, 0.27/min over 30 min
    dead = [job(f"d{i}", "dead_letter", D2000, datetime(2025, 12, 31, 23, 40 + 2 * i)) for i in range(8)]
    sig = og.signals(frame(spark, dead), AS_OF, presets=None)
    from creditloom.schema import POLICY_PRESETS

    allp = {r.policy: r for r in og.signals(frame(spark, dead), AS_OF, presets=POLICY_PRESETS).collect()}
    assert allp["strict-prod"].dead_letter_rate_breached and allp["strict-prod"].severity == "critical"
    assert not allp["balanced"].dead_letter_rate_breached and allp["balanced"].severity == "ok"
    assert allp["conservative"].recent_dead_letter == 8
    assert sig.first().policy == "balanced"
    roll = {r.policy: r.recommended_profile for r in og.rollout(og.signals(frame(spark, dead), AS_OF, POLICY_PRESETS)).collect()}
    assert roll == {"strict-prod": "block", "balanced": "prod", "conservative": "prod"}


def test_suppression_window_parsing():
    assert og.suppression_active("2999-01-01T00:00:00Z", AS_OF)
    assert og.suppression_active("2026-01-01T05:00:00+05:00", AS_OF)  # = 00:00 UTC, inclusive
    assert not og.suppression_active("2025-12-31T23:59:59", AS_OF)
    assert not og.suppression_active("  ", AS_OF) and not og.suppression_active(None, AS_OF)
