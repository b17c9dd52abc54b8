"""End-to-end batch scoring and feedback refresh over the sf0.001 driver tables."""

import tempfile

from pyspark.sql import functions as F

from creditloom.plans import pipeline
from creditloom.schema import KPI_COLUMNS, PLAN_COLUMNS
from creditloom.sources import views as V
from creditloom.sources.files import output_exists

SF = "/root/testdata/sf0.001"


def test_rule_pipeline_writes_outputs(spark):
    out = pipeline.run(V.loan_view(spark, SF), "2024-01-31", mode="rule", materialize=True)
    base = tempfile.mkdtemp(prefix="creditloom-out-")
    pipeline.write_outputs(out, base)
    assert output_exists(spark, f"{base}/scored_accounts")
    plan = spark.read.parquet(f"{base}/daily_visit_plan")
    assert set(plan.columns) == set(PLAN_COLUMNS)
    assert out.top_risky.count() == min(100, out.scored.count())
    kpi = spark.read.parquet(f"{base}/officer_kpis")
    assert kpi.columns == KPI_COLUMNS
    assert kpi.agg(F.sum("AssignedCases")).first()[0] == plan.count()
    # ranks are 1..n within every officer
    bad = plan.groupBy("OfficerId").agg(F.count("*").alias("n"), F.max("DailyVisitRank").alias("m"),
                                        F.countDistinct("DailyVisitRank").alias("d")).filter("n <> m OR n <> d")
    assert bad.count() == 0


def test_refresh_plan_from_feedback(spark):
    scored = pipeline.run(V.loan_view(spark, SF), "2024-01-31", mode="rule").scored
    plan, kpis = pipeline.refresh_plan(scored, V.feedback_view(spark, SF), "2024-01-31")
    paid = plan.filter(F.lower("Outcome").isin("paid", "resolved", "regularized")).count()
    assert paid == 0 and kpis.count() >= 1


def test_model_mode(spark):
    out = pipeline.run(V.loan_view(spark, "/root/testdata/sf0.01"), "2024-01-31", mode="auto")
    assert "PredDefaultProbability" in out.scored.columns
    m = out.metrics.first()
    assert 0.0 <= m.accuracy <= 1.0 and 0.5 < m.roc_auc <= 1.0
    assert 0.0 <= m.precision <= 1.0 and 0.0 <= m.recall <= 1.0
    probs = out.scored.agg(F.min("PredDefaultProbability").alias("lo"), F.max("PredDefaultProbability").alias("hi")).first()
    assert 0.0 <= probs.lo <= probs.hi <= 1.0
    assert out.visit_plan.count() > 0
    base = tempfile.mkdtemp(prefix="creditloom-model-")
    pipeline.write_outputs(out, base)
    assert spark.read.json(f"{base}/model_metrics").count() == 1


def test_score_and_refresh_jobs(spark, tmp_path):
    from creditloom.plans import jobs

    out = str(tmp_path / "out")
    counts = jobs.score_job(spark, SF, out, as_of="2024-01-31")
    assert counts["scored_accounts"] > 0 and counts["officer_kpis"] >= 1
    fb = tmp_path / "fb.csv"
    fb.write_text("AccountId,Outcome,RecordedAt\nACC_1,Paid,2024-01-30T00:00:00Z\n")
    r = jobs.refresh_job(spark, f"{out}/scored_accounts", str(fb), str(tmp_path / "refresh"), as_of="2024-01-31")
    assert r["feedback_rows"] == 1 and r["visit_plan_rows"] > 0


def test_score_of_a_book_without_ids(spark, tmp_path):
    from creditloom.plans import jobs
    from creditloom.schema import ID_CANDIDATES

    book = V.loan_view(spark, SF).drop(*ID_CANDIDATES)
    book.unionByName(book.limit(40)).write.parquet(str(tmp_path / "loans.parquet"))
    rows = jobs.score_job(spark, str(tmp_path / "loans.parquet"), str(tmp_path / "out"), as_of="2024-01-31")
    processed = spark.read.parquet(str(tmp_path / "out" / "loan_accounts_processed"))
    assert processed.count() == book.distinct().count() == processed.select("AccountNo").distinct().count()
    assert processed.where(~F.col("AccountNo").rlike("^ACC_[0-9]+$")).count() == 0
    plan = spark.read.parquet(str(tmp_path / "out" / "daily_visit_plan"))
    assert rows["daily_visit_plan"] == plan.count() == plan.select("AccountId").distinct().count() > 0


def test_model_save_and_reload(spark, tmp_path):
    from creditloom.operators import ml
    from creditloom.operators.logit import LogitModel
    from creditloom.plans import catalog as C

    scored = C.scored(spark, SF)
    model, _ = ml.train(scored)
    path = str(tmp_path / "model")
    model.save(spark, path)
    again = LogitModel.load(spark, path)
    assert again == model
    a = ml.score_regular(scored, model).select("AccountNo", "PredDefaultProbability")
    b = ml.score_regular(scored, again).select("AccountNo", "PredDefaultProbability")
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_the_split_stores_the_columns_of_the_model_alone(spark, monkeypatch):
    from creditloom.operators import ml, ordering
    from creditloom.plans import catalog as C

    stored = []
    keep = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: stored.append(set(df.columns)) or keep(df))
    book = C.scored(spark, SF)
    _, test = ml.train(book)
    own = {"AccountNo", ml.LABEL, *ml.MODEL_NUMERIC, *ml.MODEL_CATEGORICAL}
    assert own <= set(book.columns) and len(own) < len(book.columns)
    assert {c for c in stored[0] if not c.startswith("_")} == own and set(test.columns) == own | {"split"}
