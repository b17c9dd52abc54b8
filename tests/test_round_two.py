"""Caller limits, stamp forms, an empty branch column, late feedback, lazy cleaning."""

from pyspark.sql import functions as F

from creditloom.functions.exprs import parse_stamp
from creditloom.operators import collections_plan as cp
from creditloom.operators import job_log as jl
from creditloom.operators.quality import clean
from creditloom.streaming import streams as S

STAMP = "timestamp_ntz'2024-01-01 00:00:00'"


def test_lists_honour_the_callers_limit(spark):
    jobs = spark.range(1200).select(
        F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"), F.lit("dead_letter").alias("status"),
        *[F.expr(STAMP).alias(c) for c in ("created_at", "updated_at", "next_attempt_at", "started_at", "finished_at")],
        F.lit("t").alias("job_type"), F.lit("e").alias("error_message"))
    for c in set(jl.JOB_COLUMNS) - set(jobs.columns):
        jobs = jobs.withColumn(c, F.lit(None).cast("string"))
    assert jl.jobs_by_status(jobs, "dead_letter", 1000).count() == 1000
    assert jl.jobs_by_status(jobs, limit=0).count() == 1


def test_stamp_forms(spark):
    forms = {
        "2024-01-30T10:00:00.123Z": "2024-01-30 10:00:00.123000", "2024-01-30T10:00:00+06:00": "2024-01-30 04:00:00",
        "2024-01-30T10:00": "2024-01-30 10:00:00", "2024-01-30": "2024-01-30 00:00:00", " 2024-01-30 10:00:00 ": "2024-01-30 10:00:00",
        "2024-13-30T10:00:00Z": "None", "soon": "None", "2024-01-30T10:00:00-0530": "2024-01-30 15:30:00",
    }
    got = spark.createDataFrame([(k,) for k in forms], "s string").select("s", parse_stamp("s").alias("t")).collect()
    assert {r["s"]: str(r["t"]) for r in got} == forms


def test_branch_without_values_is_a_round_robin(spark):
    plain = spark.createDataFrame([(f"A{i}",) for i in range(6)], "AccountId string")
    empty = plain.withColumn("Branch", F.lit(None).cast("string"))
    officers = lambda df: sorted((r["AccountId"], r["OfficerId"]) for r in cp.assign_officers(df, pool=3).collect())
    assert officers(empty) == officers(plain) and len({o for _, o in officers(empty)}) == 3


def test_late_feedback_is_logged(spark, tmp_path):
    base = str(tmp_path)
    days = [("A1", "2024-02-01"), ("A2", "2024-02-20"), ("A3", "2024-01-01")]
    schema = "AccountId string, RecordedAt string, Outcome string"
    for i, (account, day) in enumerate(days):
        spark.createDataFrame([(account, f"{day}T00:00:0{k}Z", "Visited") for k in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in/{i}")
    spark.read.parquet(*[f"{base}/in/{i}" for i in range(3)])
    for i in range(3):
        stream = spark.readStream.schema(schema).parquet(f"{base}/in/{i}")
        S.feedback_ingest(stream, f"{base}/log{i}", f"{base}/latest{i}", f"{base}/ck{i}", "2024-03-01T00:00:00Z", "2024-03-01").awaitTermination(300)
        assert S.read_log(spark, f"{base}/log{i}").count() == 3
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    S.feedback_ingest(files, f"{base}/log", f"{base}/latest", f"{base}/ck", "2024-03-01T00:00:00Z", "2024-03-01").awaitTermination(300)
    assert S.read_log(spark, f"{base}/log").count() == 9


def test_clean_of_a_declared_key_is_lazy(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, " x "), ("b", None, None), ("c", 3.0, "y")], "AccountNo string, v double, t string")
    df.write.parquet(f"{tmp_path}/loans")
    out = clean(spark.read.parquet(f"{tmp_path}/loans"), materialize=False, unique_key="AccountNo")
    assert [tuple(r) for r in out.orderBy("AccountNo").collect()] == [("a", 1.0, "x"), ("b", 2.0, "Unknown"), ("c", 3.0, "y")]
    one = out.select("t")
    assert all(f"{tmp_path}/loans/" in f for f in one.inputFiles()) and one.inputFiles()
    assert "ReadSchema: struct<t:string>" in one._jdf.queryExecution().executedPlan().toString()
