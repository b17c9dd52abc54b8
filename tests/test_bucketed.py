"""Tables in key buckets: only touched buckets are written, readers keep their version."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from creditloom.operators import collections_plan as cp
from creditloom.operators import job_log as jl
from creditloom.sources import views as V
from creditloom.sources.bucketed import BucketedTable
from creditloom.streaming import streams as S

SF = "/root/testdata/sf0.001"
FEEDBACK = "AccountId string, RecordedAt string, Outcome string, PromiseStatus string, SupervisorEscalation string, PromisedAmount string, FieldNotes string"


def put(current, changes):
    return current.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/v=*/bucket=*/*.parquet")}


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=8)
    table.write(spark.range(200).select("id", F.lit("old").alias("v")), 0)
    before = files_of(table.path)
    change = spark.createDataFrame([(5, "new"), (1000, "more")], "id long, v string")
    touched = table.change(change, put, 1)
    assert 1 <= len(touched) <= 2
    after = files_of(table.path)
    assert {f: t for f, t in after.items() if f in before} == before
    assert {f.split("/bucket=")[1].split("/")[0] for f in set(after) - set(before)} == {str(b) for b in touched}
    expected = sorted([(i, "old") for i in range(200) if i != 5] + [(5, "new"), (1000, "more")])
    assert rows_of(table.read()) == expected
    assert rows_of(table.read(0)) == [(i, "old") for i in range(200)]


def test_a_replayed_version_replaces_itself(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=4)
    table.write(spark.range(20).select("id", F.lit(0).alias("v")), 0)
    for _ in range(2):
        table.change(spark.createDataFrame([(3, 1)], "id long, v int"), lambda now, new: put(now, new).withColumn("v", F.col("v") + 1), 1)
    assert table.versions() == [0, 1]
    assert {r.id: r.v for r in table.read().collect()}[3] == 2


def test_old_versions_go_and_readers_of_a_kept_one_stay(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=4, keep=2)
    table.write(spark.range(40).select("id", F.lit(0).alias("v")), 0)
    reader = None
    for version in range(1, 5):
        if version == 4:
            reader = table.read()
        table.change(spark.createDataFrame([(7, version)], "id long, v int"), put, version)
    assert table.versions() == [3, 4]
    assert {r.id: r.v for r in reader.collect()}[7] == 3 and table.read().count() == 40
    assert not glob.glob(f"{table.path}/v=1/bucket=*") and not glob.glob(f"{table.path}/v=2/bucket=*")
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_emptied_buckets_null_keys_and_no_change(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.createDataFrame([(1, "a"), (None, "n")], "id long, v string"), 0)
    gone = spark.createDataFrame([(1,)], "id long")
    table.change(gone, lambda now, ids: now.join(ids, "id", "left_anti"), 1)
    assert rows_of(table.read()) == [(None, "n")]
    assert table.change(gone.limit(0), put, 2) == [] and rows_of(table.read()) == [(None, "n")]
    empty = BucketedTable(spark, str(tmp_path / "e"), "id")
    empty.write(spark.createDataFrame([], "id long, v string"), 0)
    assert empty.read().count() == 0


def test_a_sweep_of_the_job_log_equals_the_plain_overlay(spark, tmp_path):
    as_of = "2024-01-31T00:00:00"
    jobs = V.job_view(spark, SF)
    table = jl.job_table(spark, str(tmp_path / "jobs"), buckets=8)
    table.write(jobs, 0)
    assert jl.sweep(table, as_of, 300.0, cancel=True, older_than_seconds=86400.0) == 3
    plain = jl.apply_next_state(jobs, jl.stale_recovery(jobs, as_of, 300.0))
    plain = jl.apply_next_state(plain, jl.cancel_candidates(plain, as_of))
    plain = jl.retention_keep(plain, as_of, 86400.0)
    assert sorted(map(str, table.read().select(*jobs.columns).collect())) == sorted(map(str, plain.collect()))
    assert 0 < plain.count() < jobs.count()


def test_feedback_that_differs_in_any_column_is_kept(spark, tmp_path):
    base = str(tmp_path)
    rows = [("A1", "2024-02-01T00:00:00Z", "Visited", "None", "No", "10", "n"), ("A1", "2024-02-01T00:00:00Z", "Visited", "None", "Yes", "500", "n"),
            ("A2", None, "Visited", "None", "No", "1", ""), ("A2", None, "Visited", "None", "No", "2", "")]
    spark.createDataFrame(rows + rows[:1], FEEDBACK).coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(FEEDBACK).parquet(f"{base}/in")
    S.feedback_ingest(stream, f"{base}/log", f"{base}/latest", f"{base}/ck", "2024-03-01T00:00:00Z", "2024-03-01").awaitTermination(300)
    log = S.read_log(spark, f"{base}/log")
    assert sorted((r.AccountId, r.SupervisorEscalation, r.PromisedAmount) for r in log.collect()) == [
        ("A1", "No", 10.0), ("A1", "Yes", 500.0), ("A2", "No", 1.0), ("A2", "No", 2.0)]
    assert S.read_latest(spark, f"{base}/latest").count() == 2


def test_each_batch_rewrites_the_buckets_of_its_accounts(spark, tmp_path):
    base = str(tmp_path)
    accounts = [f"A{i}" for i in range(60)]
    batches = [[(a, "2024-02-01T00:00:00Z", "Visited", "None", "No", "1", "") for a in accounts],
               [("A1", "2024-02-02T00:00:00Z", "Paid", "Kept", "No", "1", "")], [("A2", "2024-01-01T00:00:00Z", "Old", "None", "No", "1", "")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FEEDBACK).coalesce(1).write.parquet(f"{base}/in/{i}")
    stream = spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    S.feedback_ingest(stream, f"{base}/log", f"{base}/latest", f"{base}/ck", "2024-03-01T00:00:00Z", "2024-03-01", buckets=16).awaitTermination(300)
    table = S._latest_table(spark, f"{base}/latest", 16)
    assert table.versions() == [1, 2]
    written = {v: {f.split("/bucket=")[1].split("/")[0] for f in files_of(f"{base}/latest") if f"/v={v}/" in f} for v in (0, 1, 2)}
    assert len(written[1]) == 1 and len(written[2]) == 1 and len(written[0]) > 8
    latest = {r.AccountId: r.Outcome for r in S.read_latest(spark, f"{base}/latest").collect()}
    assert latest == {a: "Paid" if a == "A1" else "Visited" for a in accounts}
    assert rows_of(cp.latest_feedback(S.read_log(spark, f"{base}/log"))) == rows_of(table.read())


def test_the_latest_feedback_does_not_depend_on_the_zone(spark):
    rows = [("A", "2024-03-10T02:30:00Z", "Visited"), ("A", "2024-03-10T03:15:00Z", "Paid"), ("B", "2024-11-03T01:30:00", "first"), ("B", "2024-11-03T01:45:00", "second")]
    feedback = spark.createDataFrame(rows, "AccountId string, RecordedAt string, Outcome string").selectExpr(
        "*", "'None' PromiseStatus", "'No' SupervisorEscalation", "'' FieldNotes")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {r.AccountId: r.Outcome for r in cp.latest_feedback(feedback).collect()} == {"A": "Paid", "B": "second"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
