"""Streaming forms equal their batch forms on the same events."""

import random
import tempfile
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from creditloom.operators import request_log as rl
from creditloom.sources import views as V
from creditloom.streaming import streams as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events_stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def _run_to_memory(df, mode):
    name = "q_" + uuid.uuid4().hex[:8]
    ck = tempfile.mkdtemp(prefix="creditloom-stream-")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ck).trigger(
        availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dead_letter_windows_stream_equals_batch(spark, events_stream):
    stream = S.dead_letters_per_window(V.jobs_from_events(events_stream))
    batch = S.dead_letters_per_window(V.job_view(spark, SF))
    cols = ["window_start", "window_end", "job_type", "dead_letter"]
    assert _rows(_run_to_memory(stream, "complete"), cols) == _rows(batch, cols)


def test_request_windows_stream_equals_batch(spark, events_stream):
    stream = S.requests_per_window(V.requests_from_events(events_stream))
    batch = S.requests_per_window(V.request_view(spark, SF))
    cols = batch.columns
    assert _rows(_run_to_memory(stream, "complete"), cols) == _rows(batch, cols)


def _attempts(spark, tmp_path, files):
    """A stream of one micro-batch for each list of (event_id, client_key, second)."""
    t0 = datetime(2026, 1, 1)
    for i, rows in enumerate(files):
        data = [(e, k, t0 + timedelta(seconds=s)) for e, k, s in rows]
        spark.createDataFrame(data, "event_id long, client_key string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    return spark.readStream.schema("event_id long, client_key string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_admission_stream_in_any_order_equals_batch(spark, tmp_path):
    """Attempts come up to two minutes late, over six micro-batches; the far last one moves the watermark past all."""
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", i * 0.7 + rnd.choice([0, 0, 0.25])) for i in range(600)]
    by_arrival = sorted(rows, key=lambda r: r[2] + rnd.uniform(0, 100))
    files = [by_arrival[i:i + 100] for i in range(0, 600, 100)]
    assert by_arrival != rows
    stream = _attempts(spark, tmp_path, [*files, [(9999, "end", 100_000.0)]])
    decided = _run_to_memory(S.admission_stream(stream, limit=4, window_seconds=30, lateness_seconds=130, bucket_seconds=5), "append").collect()
    t0 = datetime(2026, 1, 1)
    batch = spark.createDataFrame([(e, k, t0 + timedelta(seconds=s)) for e, k, s in rows], "event_id long, client_key string, ts timestamp_ntz")
    expected = {r.event_id: (r.client_key, r.admitted) for r in rl.rate_limit_admission(batch, 4, 30).collect()}
    assert {r.event_id: (r.client_key, r.admitted) for r in decided} == expected
    assert len(decided) == 600 and 0 < sum(r.admitted for r in decided) < 600
    assert {r.event_id: r.ts for r in decided} == {e: t0 + timedelta(seconds=s) for e, _, s in rows}


def test_admission_stream_of_the_request_log_equals_batch(spark, events_stream):
    stream = S.admission_stream(V.requests_from_events(events_stream), limit=2, window_seconds=3600, bucket_seconds=600)
    got = {r.event_id: r.admitted for r in _run_to_memory(stream, "append").collect()}
    requests = V.request_view(spark, SF)
    exp = {r.event_id: r.admitted for r in rl.rate_limit_admission(requests, 2, 3600).collect()}
    # undecided: the last hour, which may still get late attempts, up to a whole bucket
    last = requests.agg(F.max("ts")).first()[0]
    open_ = {r.event_id for r in requests.where(F.col("ts") > F.lit(last - timedelta(seconds=3600 + 600))).collect()}
    assert set(exp) - set(got) <= open_ and len(got) > 900
    assert all(exp[e] == admitted for e, admitted in got.items())


def test_feedback_ingest_stream(spark, events_stream):
    base = tempfile.mkdtemp(prefix="creditloom-fb-")
    src = V.feedback_from_events(events_stream)
    # blank the account of some rows so the reject path is exercised
    src = src.withColumn("AccountId", F.when(F.col("event_id") % 250 == 0, F.lit("  ")).otherwise(F.col("AccountId")))
    q = S.feedback_ingest(src, f"{base}/log", f"{base}/latest", f"{base}/ck",
                          "2024-01-31T00:00:00Z", "2024-01-31", rejected_path=f"{base}/rejected")
    q.awaitTermination(300)
    log = spark.read.parquet(f"{base}/log")
    from creditloom.sources.files import canonicalize_feedback
    raw = V.feedback_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    raw = raw.withColumn("AccountId", F.when(F.col("event_id") % 250 == 0, F.lit("  ")).otherwise(F.col("AccountId")))
    batch, rejected = canonicalize_feedback(raw, "2024-01-31T00:00:00Z", "2024-01-31")
    assert spark.read.parquet(f"{base}/rejected").count() == rejected.count() == 4
    log_cols = list(log.columns)
    assert log.count() == batch.count()
    latest = S.read_latest(spark, f"{base}/latest")
    assert latest.count() == batch.select("AccountId").distinct().count()
    from creditloom.operators.collections_plan import latest_feedback

    expected = latest_feedback(log)
    cols = ["AccountId", "Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes", "RecordedAt"]
    assert sorted(tuple(r[c] for c in cols) for r in latest.collect()) == sorted(
        tuple(r[c] for c in cols) for r in expected.collect())
    assert set(log_cols) >= {"AccountId", "RecordedAt", "Outcome"}


def test_dead_letter_windows_append_mode_emits_closed_windows(spark, events_stream):
    """Append mode emits a window once the watermark passes its end; every
    emitted window equals the batch count, and only the still-open tail of
    windows is missing."""
    stream = S.dead_letters_per_window(V.jobs_from_events(events_stream), watermark="1 hour")
    got = _rows(_run_to_memory(stream, "append"), ["window_start", "window_end", "job_type", "dead_letter"])
    batch = S.dead_letters_per_window(V.job_view(spark, SF))
    exp = {tuple(r[c] for c in ["window_start", "window_end", "job_type", "dead_letter"]) for r in batch.collect()}
    assert got and set(got) <= exp
    latest_end = max(r[1] for r in exp)
    missing = exp - set(got)
    # windows not emitted are the ones still open at the final watermark (max event time - 1 hour)
    assert all(m[1] > latest_end - timedelta(hours=2) for m in missing)


def test_feedback_ingest_of_two_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src_dir = str(tmp_path / "src")
    events.filter("event_id < 500").coalesce(1).write.parquet(f"{src_dir}/part_a")
    events.filter("event_id >= 500").coalesce(1).write.parquet(f"{src_dir}/part_b")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src_dir))
    base = str(tmp_path / "out")
    q = S.feedback_ingest(V.feedback_from_events(stream), f"{base}/log", f"{base}/latest", f"{base}/ck",
                          "2024-01-31T00:00:00Z", "2024-01-31")
    q.awaitTermination(300)
    log = spark.read.parquet(f"{base}/log")
    assert log.select("batch_id").distinct().count() == 2
    assert S._latest_table(spark, f"{base}/latest").versions() == [0, 1]
    from creditloom.operators.collections_plan import latest_feedback

    cols = ["AccountId", "Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes", "RecordedAt"]
    got = sorted(tuple(r[c] for c in cols) for r in S.read_latest(spark, f"{base}/latest").collect())
    exp = sorted(tuple(r[c] for c in cols) for r in latest_feedback(log).collect())
    assert got == exp
