"""Job-log analytics: lists, counters, age/rate/trend signals, next-state tables.

The job log is a table with one row per job. "State changes" produce the
next version of the affected rows (to be merged/overwritten by job_id);
nothing is updated in place. Every time predicate is relative to an
explicit ``as_of`` instant so results are reproducible.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if
from ..session import cut_lineage
from ..sources.bucketed import BucketedTable
from ..schema import NO_ERROR_MESSAGE, STALE_EXHAUSTED, STALE_REQUEUED, TERMINAL_STATUSES

JOB_COLUMNS = [
    "job_id", "job_type", "status", "result_json", "error", "created_at", "updated_at", "attempts",
    "max_attempts", "timeout_seconds",
]


def ts_lit(value: str | datetime) -> Column:
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def shifted(as_of: str, seconds: float) -> str:
    """``as_of`` + ``seconds`` as timestamp text (a plan-time constant)."""
    base = datetime.fromisoformat(as_of)
    return (base + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S.%f")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(1e6)


def at_least_one(n: int) -> int:
    """The caller's limit; a list never has a silent upper bound of its own."""
    return max(1, int(n))


# ---------------------------------------------------------------------------
# lists
# ---------------------------------------------------------------------------


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id).select(*JOB_COLUMNS)


def jobs_by_status(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    out = jobs.filter(F.col("status") == status.strip().lower()) if status else jobs
    return out.orderBy(F.col("updated_at").desc(), F.col("job_id").desc()).select(*JOB_COLUMNS).limit(at_least_one(limit))


def jobs_due(jobs: DataFrame, as_of: str) -> DataFrame:
    """Queued jobs eligible to run now, in claim order (retry time, then age)."""
    due = (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= ts_lit(as_of)))
    return jobs.filter(due).orderBy(F.col("next_attempt_at").asc_nulls_first(), F.col("created_at"), F.col("job_id"))


def active_latest_by_type(jobs: DataFrame) -> DataFrame:
    """Newest queued/running job per job type (the duplicate-submission check)."""
    active = jobs.filter(F.col("status").isin("queued", "running"))
    best = active.groupBy("job_type").agg(
        F.max(F.struct("updated_at", "job_id", "status", "created_at", "attempts")).alias("m")
    )
    return best.select("job_type", *[F.col(f"m.{c}").alias(c) for c in ["job_id", "status", "created_at", "updated_at", "attempts"]])


def oldest_queued(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return (
        jobs.filter(F.col("status") == "queued")
        .orderBy(F.col("created_at"), F.col("job_id"))
        .select(*JOB_COLUMNS)
        .limit(at_least_one(limit))
    )


def recent_dead_letters(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return (
        jobs.filter(F.col("status") == "dead_letter")
        .orderBy(F.col("updated_at").desc(), F.col("job_id").desc())
        .select(*JOB_COLUMNS)
        .limit(at_least_one(limit))
    )


# ---------------------------------------------------------------------------
# counters
# ---------------------------------------------------------------------------


def job_stats(jobs: DataFrame, paused: bool = False, max_queued: int = 500) -> DataFrame:
    """Counts per status, oldest per active status, drain and capacity flags (one row)."""
    st = F.col("status")
    out = jobs.agg(
        count_if(st == "queued").alias("queued"),
        count_if(st == "running").alias("running"),
        count_if(st == "succeeded").alias("succeeded"),
        count_if(st == "dead_letter").alias("dead_letter"),
        count_if(st == "canceled").alias("canceled"),
        F.count(F.lit(1)).alias("total"),
        F.min(F.when(st == "queued", F.col("created_at"))).alias("oldest_queued"),
        F.min(F.when(st == "running", F.col("created_at"))).alias("oldest_running"),
        F.min(F.when(st == "dead_letter", F.col("created_at"))).alias("oldest_dead_letter"),
    )
    return (
        out.withColumn("paused", F.lit(paused))
        .withColumn("drained", F.lit(paused) & (F.col("running") == 0))
        .withColumn("capacity_exceeded", F.col("queued") >= F.lit(max_queued))
    )


def job_type_stats(jobs: DataFrame, limit: int = 50) -> DataFrame:
    st = F.col("status")
    out = jobs.groupBy("job_type").agg(
        count_if(st == "queued").alias("queued"),
        count_if(st == "running").alias("running"),
        count_if(st == "dead_letter").alias("dead_letter"),
        F.count(F.lit(1)).alias("total"),
    )
    return out.orderBy(F.col("total").desc(), F.col("job_type")).limit(at_least_one(limit))


def queue_age(jobs: DataFrame, as_of: str, threshold_seconds: float = 300.0) -> DataFrame:
    thr = max(0.0, float(threshold_seconds))
    q = jobs.filter(F.col("status") == "queued").agg(
        F.count(F.lit(1)).alias("queued"), F.min("created_at").alias("oldest_queued_at")
    )
    age = F.when(
        F.col("oldest_queued_at").isNotNull(),
        F.greatest(seconds_between(F.col("oldest_queued_at"), ts_lit(as_of)), F.lit(0.0)),
    )
    return (
        q.withColumn("oldest_queued_age_seconds", age)
        .withColumn("threshold_seconds", F.lit(thr))
        .withColumn("breached", F.coalesce(F.col("oldest_queued_age_seconds") >= F.lit(thr), F.lit(False)))
    )


def dead_letter_rate(jobs: DataFrame, as_of: str, window_seconds: float = 3600.0, threshold_per_minute: float = 1.0) -> DataFrame:
    window = max(1.0, float(window_seconds))
    thr = max(0.0, float(threshold_per_minute))
    dead = F.col("status") == "dead_letter"
    out = jobs.agg(
        count_if(dead & (F.col("updated_at") >= ts_lit(shifted(as_of, -window)))).alias("recent_dead_letter"),
        count_if(dead).alias("total_dead_letter"),
    )
    rate = F.col("recent_dead_letter") / F.lit(window / 60.0)
    return (
        out.withColumn("window_seconds", F.lit(window))
        .withColumn("threshold_per_minute", F.lit(thr))
        .withColumn("rate_per_minute", rate)
        .withColumn("breached", F.col("rate_per_minute") >= F.lit(thr))
    )


def dead_letter_top_types(jobs: DataFrame, limit: int = 10) -> DataFrame:
    out = jobs.filter(F.col("status") == "dead_letter").groupBy("job_type").agg(F.count(F.lit(1)).alias("dead_letter"))
    return out.orderBy(F.col("dead_letter").desc(), F.col("job_type")).limit(at_least_one(limit))


def dead_letter_trend(jobs: DataFrame, as_of: str, window_seconds: float = 3600.0) -> DataFrame:
    """Recent window vs the window before it, in one conditional aggregate."""
    window = max(1.0, float(window_seconds))
    recent_cut, prev_cut = ts_lit(shifted(as_of, -window)), ts_lit(shifted(as_of, -2 * window))
    dead = F.col("status") == "dead_letter"
    u = F.col("updated_at")
    out = jobs.agg(
        count_if(dead & (u >= recent_cut)).alias("recent_count"),
        count_if(dead & (u >= prev_cut) & (u < recent_cut)).alias("previous_count"),
    )
    delta = F.col("recent_count") - F.col("previous_count")
    return (
        out.withColumn("window_seconds", F.lit(window))
        .withColumn("delta", delta)
        .withColumn("direction", F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat"))
    )


def dead_letter_errors(jobs: DataFrame, limit: int = 10) -> DataFrame:
    msg = F.coalesce(F.when(F.trim(F.col("error")) != "", F.trim(F.col("error"))), F.lit(NO_ERROR_MESSAGE))
    out = jobs.filter(F.col("status") == "dead_letter").groupBy(msg.alias("error_message")).agg(
        F.count(F.lit(1)).alias("dead_letter")
    )
    return out.orderBy(F.col("dead_letter").desc(), F.col("error_message")).limit(at_least_one(limit))


# ---------------------------------------------------------------------------
# next-state tables
# ---------------------------------------------------------------------------


def stale_recovery(jobs: DataFrame, as_of: str, stale_after_seconds: float = 300.0) -> DataFrame:
    """Running jobs not updated for ``stale_after_seconds``: requeue or dead-letter."""
    stale = max(1.0, float(stale_after_seconds))
    rows = jobs.filter((F.col("status") == "running") & (F.col("updated_at") <= ts_lit(shifted(as_of, -stale))))
    retry = F.col("attempts") < F.col("max_attempts")
    return rows.select(
        "job_id",
        "job_type",
        F.when(retry, "queued").otherwise("dead_letter").alias("status"),
        F.when(retry, STALE_REQUEUED).otherwise(STALE_EXHAUSTED).alias("error"),
        "attempts",
        "max_attempts",
        F.when(retry, ts_lit(as_of)).alias("next_attempt_at"),
        ts_lit(as_of).alias("updated_at"),
    )


def retry_transition(failures: DataFrame, as_of: str, backoff_seconds: float = 0.2) -> DataFrame:
    """Failed attempts: retry after ``backoff * attempts`` seconds, else dead letter."""
    retry = F.col("attempts") < F.col("max_attempts")
    micros = (F.col("attempts").cast("double") * F.lit(backoff_seconds * 1e6)).cast("bigint")
    retry_at = F.timestamp_add("MICROSECOND", micros, ts_lit(as_of))
    return failures.select(
        "job_id",
        "job_type",
        F.when(retry, "queued").otherwise("dead_letter").alias("status"),
        F.lit(None).cast("string").alias("result_json"),
        F.col("error"),
        "attempts",
        "max_attempts",
        F.when(retry, retry_at).alias("next_attempt_at"),
        ts_lit(as_of).alias("updated_at"),
    )


def requeue_candidates(jobs: DataFrame, known_types: DataFrame, as_of: str, job_type: str | None = None,
                       limit: int = 100) -> DataFrame:
    """Next state of the oldest ``limit`` dead letters whose type has a handler.

    The limit applies before the handler check (rows of unknown types are
    skipped, not replaced). ``known_types`` is the registered handler list;
    Spark chooses the join by its size. A dry run is ``count()``.
    """
    dead = jobs.filter(F.col("status") == "dead_letter")
    if job_type:
        dead = dead.filter(F.col("job_type") == job_type)
    first = dead.orderBy(F.col("updated_at"), F.col("job_id")).limit(at_least_one(limit))
    chosen = first.join(known_types, "job_type", "left_semi")
    now = ts_lit(as_of)
    return chosen.select(
        "job_id",
        "job_type",
        F.lit("queued").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("result_json"),
        F.lit(None).cast("string").alias("error"),
        now.alias("next_attempt_at"),
        now.alias("updated_at"),
    )


def cancel_candidates(jobs: DataFrame, as_of: str, job_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Next state of queued jobs to cancel: all, or the oldest ``limit``."""
    q = jobs.filter(F.col("status") == "queued")
    if job_type:
        q = q.filter(F.col("job_type") == job_type)
    if limit is not None:
        q = q.orderBy(F.col("created_at"), F.col("job_id")).limit(at_least_one(limit))
    return q.select(
        "job_id",
        "job_type",
        F.lit("canceled").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("next_attempt_at"),
        ts_lit(as_of).alias("updated_at"),
    )


def retention_keep(jobs: DataFrame, as_of: str, older_than_seconds: float = 86400.0) -> DataFrame:
    """Rows kept after dropping terminal jobs not updated since the cutoff."""
    cutoff = ts_lit(shifted(as_of, -max(0.0, float(older_than_seconds))))
    drop = F.col("status").isin(*TERMINAL_STATUSES) & (F.col("updated_at") <= cutoff)
    return jobs.filter(~drop)


def apply_next_state(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Overlay next-state rows on the log by job_id (what a MERGE would do)."""
    keep = jobs.join(changes.select("job_id"), "job_id", "left_anti")
    aligned = changes.join(jobs.drop(*[c for c in changes.columns if c != "job_id"]), "job_id", "inner")
    return keep.unionByName(aligned.select(*jobs.columns))


def remove_jobs(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    return jobs.join(gone.select("job_id"), "job_id", "left_anti")


def job_table(spark, path: str, buckets: int = 64) -> BucketedTable:
    """The job log as a table in id buckets: a change rewrites the buckets of its jobs only."""
    return BucketedTable(spark, path, "job_id", buckets)


def sweep(table: BucketedTable, as_of: str, stale_after_seconds: float = 300.0, cancel: bool = False,
          older_than_seconds: float | None = 86400.0) -> int:
    """Recover stale jobs, cancel what is queued (if asked), drop expired terminal jobs; the new version number.

    Each step is a version of its own that reads the one before it. A step's
    changes are stored first: they come from the table that the step changes.
    """
    version = table.versions()[-1]
    steps = [(lambda jobs: stale_recovery(jobs, as_of, stale_after_seconds), apply_next_state)]
    if cancel:
        steps.append((lambda jobs: cancel_candidates(jobs, as_of), apply_next_state))
    if older_than_seconds is not None:
        steps.append((lambda jobs: remove_jobs(jobs, retention_keep(jobs, as_of, older_than_seconds)), remove_jobs))
    for changes_of, combine in steps:
        version += 1
        table.change(cut_lineage(changes_of(table.read())), combine, version)
    return version


# ---------------------------------------------------------------------------
# audit logs (incident annotations, gate decisions)
# ---------------------------------------------------------------------------


def normalize_annotations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): scope lower-cased (blank -> rollout), summary trimmed, blank rejected."""
    scope = F.lower(F.trim(F.coalesce(F.col("scope"), F.lit(""))))
    out = raw.withColumn("scope", F.when(scope == "", "rollout").otherwise(scope)).withColumn(
        "summary", F.trim(F.coalesce(F.col("summary"), F.lit("")))
    )
    ok = F.col("summary") != ""
    return out.filter(ok), out.filter(~ok)


def list_log(log: DataFrame, key_col: str, key: str | None, limit: int = 50) -> DataFrame:
    out = log.filter(F.col(key_col) == key.strip().lower()) if key else log
    return out.orderBy(F.col("created_at").desc(), F.col(out.columns[0]).desc()).limit(at_least_one(limit))
