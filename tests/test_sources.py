"""Sources and sinks: CSV tokens, header trim, format dispatch, feedback log, catalog seeding."""

import os
import tempfile

import pytest

from creditloom.schema import FEEDBACK_COLUMNS
from creditloom.sources import files


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_scan_tokens_and_header_trim(spark):
    d = tempfile.mkdtemp(prefix="creditloom-src-")
    p = os.path.join(d, "loans.csv")
    _write(p, " CLStatusCode ,AgeDays,PrincipalOS,Sector,Extra\nSTD,12,NA,TRADE,x\nWCH,None,1.5,null,y\n")
    df = files.load_table(spark, p)
    assert df.columns == ["CLStatusCode", "AgeDays", "PrincipalOS", "Sector", "Extra"]
    rows = df.orderBy("CLStatusCode").collect()
    assert rows[0].PrincipalOS is None and rows[0].AgeDays == 12
    assert rows[1].AgeDays is None and rows[1].Sector is None and rows[1].PrincipalOS == 1.5
    assert dict(df.dtypes)["Extra"] == "string"


def test_unknown_format_and_missing_file(spark):
    with pytest.raises(ValueError, match="Unsupported file format"):
        files.load_table(spark, "/tmp/x.xlsx")
    with pytest.raises(FileNotFoundError):
        files.load_table(spark, "/tmp/definitely-missing-creditloom.csv")


def test_feedback_scan_missing_and_partial(spark):
    assert files.load_feedback(spark, "/tmp/no-such-feedback-creditloom.csv").count() == 0
    d = tempfile.mkdtemp(prefix="creditloom-fb-")
    p = os.path.join(d, "fb.csv")
    _write(p, "AccountId,Outcome,PromisedAmount\nACC_1,Paid,12.5\nACC_2,None,n/a\n")
    fb = files.load_feedback(spark, p)
    assert fb.columns == FEEDBACK_COLUMNS
    rows = {r.AccountId: r for r in fb.collect()}
    assert rows["ACC_1"].PromisedAmount == 12.5 and rows["ACC_1"].VisitStatus == ""
    assert rows["ACC_2"].Outcome is None and rows["ACC_2"].PromisedAmount is None


def test_canonical_feedback_defaults_and_rejects(spark):
    raw = spark.createDataFrame(
        [(" ACC_1 ", "", None, "x"), ("  ", "Paid", "3", "2026-01-01T00:00:00Z")],
        "AccountId string, Outcome string, PromisedAmount string, RecordedAt string",
    )
    ok, bad = files.canonicalize_feedback(raw, "2026-02-02T00:00:00Z", "2026-02-02")
    r = ok.first()
    assert (r.AccountId, r.Outcome, r.PromisedAmount, r.VisitStatus, r.RecordedBy) == ("ACC_1", "Contacted", 0.0, "Completed", "system")
    assert bad.count() == 1
    assert files.append_feedback(files.align_feedback(raw), ok).count() == 3


def test_seed_and_exists(spark):
    name = "creditloom_seed_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    seed = spark.createDataFrame([(1,)], "x int")
    assert files.seed_table_if_empty(spark, name, seed).count() == 1
    assert files.seed_table_if_empty(spark, name, spark.createDataFrame([(1,), (2,)], "x int")).count() == 1
    assert files.output_exists(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_assign_ids_without_id_column(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "Sector string")
    got = sorted((r.Sector, r.AccountNo) for r in files.assign_account_ids(df).collect())
    assert got == [("a", "ACC_0"), ("b", "ACC_1"), ("c", "ACC_2")]


def test_job_log_text_stamps(spark):
    df = spark.createDataFrame([("j", "2026-01-01T00:00:05Z")], "job_id string, created_at string")
    d = tempfile.mkdtemp(prefix="creditloom-jobs-")
    df.write.mode("overwrite").parquet(d + "/j")
    out = files.load_job_log(spark, d + "/j").first()
    assert str(out.created_at) == "2026-01-01 00:00:05"


def test_feedback_log_parquet(spark, tmp_path):
    p = str(tmp_path / "fb.parquet")
    spark.createDataFrame([("ACC_1", "Paid", 3.0)], "AccountId string, Outcome string, PromisedAmount double").write.parquet(p)
    fb = files.load_feedback(spark, p)
    assert fb.columns == FEEDBACK_COLUMNS and fb.first().PromisedAmount == 3.0


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_other_formats_dispatch_by_suffix(spark, tmp_path, fmt):
    path = str(tmp_path / f"loans.{fmt}")
    df = spark.createDataFrame([(" STD ", 12, 1.5)], "CLStatusCode string, AgeDays int, PrincipalOS double")
    df.write.format(fmt).save(path)
    got = files.load_table(spark, path).first()
    assert got.CLStatusCode == " STD " and got.AgeDays == 12 and got.PrincipalOS == 1.5


def test_resolve_source_prefers_active_file(spark, tmp_path):
    default = tmp_path / "default.csv"
    default.write_text("a\n1\n")
    active = tmp_path / "active.csv"
    assert files.resolve_source(spark, [str(active), str(default)]) == str(default)
    active.write_text("a\n2\n")
    assert files.resolve_source(spark, [str(active), str(default)]) == str(active)
    with pytest.raises(FileNotFoundError):
        files.resolve_source(spark, [str(tmp_path / "none.csv")])
