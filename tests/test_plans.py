"""Plan shape: no row-at-a-time Python, pruned scans, size-checked broadcasts."""

import re

from creditloom.plans import catalog as C

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_loan_scan_is_pruned(spark):
    plan = _plan(C.loans(spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>\s]*)", plan)
    lineitem = [s for s in schemas if s.startswith("l_orderkey")][0]
    assert {x.split(":")[0] for x in lineitem.split(",")} == {
        "l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"}
    orders = [s for s in schemas if s.startswith("o_orderkey")][0]
    assert "o_orderdate" not in orders


def test_no_python_udfs_in_sql_queries(spark):
    for name in ["top_risky_rule", "visit_plan", "officer_kpis", "branch_risk", "ops_policy_matrix",
                 "trailing_attempts", "alt_reasons", "latest_feedback"]:
        plan = _plan(C.QUERIES[name](spark, SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_sector_join_is_broadcast(spark):
    plan = _plan(C.featured(spark, SF))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_filters_pushed_to_parquet(spark, tmp_path):
    from pyspark.sql import functions as F

    from creditloom.sources.files import load_table

    path = str(tmp_path / "loans.parquet")
    spark.createDataFrame([("STD", 12, 1.0)], "CLStatusCode string, AgeDays int, PrincipalOS double").write.parquet(path)
    plan = _plan(load_table(spark, path).filter(F.col("AgeDays") > 30).select("CLStatusCode"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(AgeDays,30\)", plan)
    assert "ReadSchema: struct<CLStatusCode:string,AgeDays:int>" in plan


def test_no_cross_joins(spark):
    for name in ["top_risky_rule", "visit_plan", "visit_plan_feedback", "officer_kpis", "risk_distribution",
                 "ranking_ratio", "scored_page", "ops_policy_matrix", "output_counts", "scan_clean_gaps"]:
        plan = _plan(C.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
