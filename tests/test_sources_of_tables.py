"""JDBC options, job logs in every format, JSON fields, gate modes, sector map, small projections."""

import json

import pytest
from pyspark.sql import functions as F

from creditloom.operators import collections_plan as cp
from creditloom.operators import ops_gate as og
from creditloom.operators.features import engineer, share_map
from creditloom.operators.quality import required_status
from creditloom.schema import FEEDBACK_COLUMNS
from creditloom.sources import files


def test_jdbc_reads_in_slices():
    one = files.jdbc_options("jdbc:x:y", "loans", {"user": "u", "fetchsize": 5})
    assert one == {"fetchsize": "5", "user": "u", "url": "jdbc:x:y", "dbtable": "loans"}
    many = files.jdbc_options("jdbc:x:y", "loans", slices=files.Slices("id", 1, 10**9, 200))
    assert (many["partitionColumn"], many["lowerBound"], many["upperBound"], many["numPartitions"]) == ("id", "1", "1000000000", "200")
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x:y", "loans", slices=files.Slices("id", 1, 2, 0))


def test_jdbc_writes_bound_their_connections(spark):
    w = files.jdbc_write_options("jdbc:x:y", "plan", {"password": "p"}, connections=3)
    assert w == {"batchsize": "10000", "truncate": "true", "password": "p", "url": "jdbc:x:y", "dbtable": "plan", "numPartitions": "3"}
    with pytest.raises(ValueError):
        files.jdbc_write_options("jdbc:x:y", "plan", connections=0)
    with pytest.raises(ValueError, match="mode"):
        files.save_table(spark.range(1), "t", mode="ignore")


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_job_log_in_every_format(spark, tmp_path, fmt):
    rows = [("j1", "queued", 1, "2024-01-30T10:00:00Z"), ("j2", "running", 2, None)]
    df = spark.createDataFrame(rows, "job_id string, status string, attempts int, created_at string")
    path = f"{tmp_path}/log.{fmt}"
    assert not files.output_exists(spark, path)
    df.write.format(fmt).option("header", True).save(path)
    assert files.output_exists(spark, path)
    log = files.load_job_log(spark, path)
    assert dict(log.dtypes)["created_at"] == "timestamp_ntz" and dict(log.dtypes)["attempts"] == "int"
    got = log.orderBy("job_id").select("job_id", "attempts", F.col("created_at").cast("string")).collect()
    assert [tuple(r) for r in got] == [("j1", 1, "2024-01-30 10:00:00"), ("j2", 2, None)]


def test_json_fields_of_any_shape(spark):
    texts = [json.dumps({"k": 3}), json.dumps({"k": "3x", "a": [{"k": 9}]}), '{"k": 1', "", None, "[]", "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = files.decode_fields(df, "j", {"k": ("$.k", "int"), "a": ("$.a[0].k", "bigint")}).orderBy("i").collect()
    assert [(r.j_valid, r.k, r.a) for r in got] == [
        (True, 3, None), (True, None, 9), (False, None, None), (False, None, None), (None, None, None), (True, None, None), (True, None, None)]


def _signals(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "warning"), ("c", "critical")], "job_type string, severity string")
    return (df.withColumn("policy", F.lit("p")).withColumn("breached", F.col("severity") != "ok")
            .withColumn("worker_breached", F.lit(False)).withColumn("queue_age_breached", F.col("severity") == "warning")
            .withColumn("dead_letter_rate_breached", F.col("severity") == "critical"))


def test_gate_modes(spark):
    rows = og.gate_evaluation(_signals(spark), ["STRICT ", "relaxed", "advice"]).collect()
    assert {(r.severity, r.mode): (r.pass_gate, r.recommended_status_code, r.effective_fail_on_warning, r.recommended_mode) for r in rows} == {
        ("ok", "strict"): (True, 200, True, "strict"), ("ok", "relaxed"): (True, 200, False, "relaxed"), ("ok", "advice"): (True, 200, None, "strict"),
        ("warning", "strict"): (False, 503, True, "strict"), ("warning", "relaxed"): (True, 200, False, "relaxed"),
        ("warning", "advice"): (True, 200, None, "relaxed"), ("critical", "strict"): (False, 503, True, "strict"),
        ("critical", "relaxed"): (False, 503, False, "relaxed"), ("critical", "advice"): (False, 503, None, "block")}
    with pytest.raises(ValueError, match="mode must be one of"):
        og.gate_evaluation(_signals(spark), ["lenient"])


def test_gate_profiles(spark):
    rows = og.profile_evaluation(_signals(spark)).where("severity = 'warning'").orderBy("stage").collect()
    assert [(r.profile, r.profile_mode, r.pass_gate) for r in rows] == [("dev", "relaxed", True), ("staging", "advice", True), ("prod", "strict", False)]
    assert og.profile_evaluation(_signals(spark), [" Prod"]).count() == 3
    with pytest.raises(ValueError, match="profile must be one of"):
        og.profile_evaluation(_signals(spark), ["qa"])


def test_more_sectors_than_declared_are_an_error(spark):
    df = spark.range(40).select((F.col("id") % 8).cast("string").alias("Sector"))
    assert df.select(share_map(df, 8)["3"].alias("s")).first().s == 0.125
    with pytest.raises(Exception, match="more than 7 sectors"):
        df.select(share_map(df, 7)["3"].alias("s")).collect()


def test_lazy_features_equal_joined_ones(spark):
    from creditloom.plans import catalog as C
    from creditloom.sources.views import loan_view

    book = C.cleaned(spark, "/root/testdata/sf0.001")
    assert not any(loan_view(spark, "/root/testdata/sf0.001").schema[c].nullable for c in ("PrincipalOS", "AgeDays", "InterestArrear"))
    a, b = engineer(book, few_sectors=True), engineer(book)
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert "ubquery" not in a.select("Branch")._jdf.queryExecution().optimizedPlan().toString()


def test_present_and_missing_columns(spark):
    df = spark.createDataFrame([("x",)], "Sector string")
    assert required_status(df, ["Sector", "AgeDays"]) == (["Sector"], ["AgeDays"])
    assert list(files.empty_feedback(spark).columns) == FEEDBACK_COLUMNS


def test_plan_of_a_book_without_branch(spark):
    df = spark.createDataFrame([("1", "High Risk", 90, 5.0)], "AccountNo string, RuleRiskCategory string, AgeDays int, PrincipalOS double")
    row = cp.visit_plan(df.withColumn("RuleScore", F.lit(80)), "2024-01-31").first()
    assert row.Branch == "UNKNOWN"


def test_broadcasts_are_bounded_by_bytes(spark):
    from creditloom.functions.exprs import join_small, row_bytes

    notes = spark.range(50).select("id", F.repeat(F.lit("x"), 2000).alias("note"), F.array(F.lit(1)).alias("a"))
    assert notes.select(row_bytes(notes).alias("b")).first().b == 8 + 2000 + len('{"a":[1]}')
    big = spark.range(100)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide, small = join_small(big, notes, "id", max_bytes=50_000), join_small(big, notes, "id")
    assert hinted(small) and not hinted(wide) and not hinted(join_small(big, notes, "id", max_rows=49))
    assert wide.count() == small.count() == 50
    assert join_small(big, notes.limit(0), "id", "left").count() == 100
