"""Queries: visit candidates, officers, plans, feedback log, KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O, pipeline
from ...operators import collections_plan as cp
from ...session import new_table_path
from ...sources import files
from .common import (
    feedback_raw,
    loans,
    NOW_TS,
    PLAN_CHAIN,
    PLAN_DATE,
    plan_rule,
    plan_with_feedback,
    register,
    std_scored,
)


@register(
    "visit_candidates",
    O.with_ctes(
        PLAN_CHAIN,
        "SELECT AccountNo, Branch, DaysOverdue, InstRiskNum AS InstallmentRisk, RiskBand, RiskCore, PriorityScore FROM cand",
    ),
)
def q_visit_candidates(spark, d):
    return cp.visit_candidates(std_scored(spark, d, stored=True)).select(
        "AccountNo", "Branch", "DaysOverdue", "InstallmentRisk", "RiskBand", "RiskCore", "PriorityScore"
    )


@register("officer_assignment", O.with_ctes(PLAN_CHAIN, "SELECT o_branch AS Branch, OfficerId FROM officers"))
def q_officer_assignment(spark, d):
    return cp.branch_officer_map(cp.visit_candidates(std_scored(spark, d, stored=True)))


@register(
    "officer_round_robin",
    O.with_ctes(
        PLAN_CHAIN,
        "SELECT AccountNo AS AccountId, concat('OFFICER_', cast((row_number() OVER (ORDER BY AccountNo) - 1) % 5 + 1 AS varchar)) "
        "AS OfficerId FROM cand",
    ),
)
def q_officer_round_robin(spark, d):
    cand = cp.visit_candidates(std_scored(spark, d, stored=True)).drop("Branch")
    cand = cand.withColumn("AccountId", F.col("AccountNo").cast("string"))
    return cp.assign_officers(cand).select("AccountId", "OfficerId")


register("visit_plan", O.with_ctes(PLAN_CHAIN, "SELECT * FROM plan"))(plan_rule)


register(
    "visit_plan_feedback",
    O.with_ctes(PLAN_CHAIN + [O.FEEDBACK, O.LATEST, O.PLAN_FB], "SELECT * FROM plan_fb"),
)(plan_with_feedback)


@register("officer_kpis", O.with_ctes(PLAN_CHAIN, O.kpis("plan")))
def q_officer_kpis(spark, d):
    # KPIs do not read the visit rank, so the plan is built without ranking
    return cp.officer_kpis(cp.visit_plan(std_scored(spark, d, stored=True), PLAN_DATE, ranked=False))


@register("latest_feedback", O.with_ctes([O.FEEDBACK, O.LATEST], "SELECT * FROM lf"))
def q_latest_feedback(spark, d):
    return cp.latest_feedback(feedback_raw(spark, d))


FB_CHAIN = [O.FEEDBACK, O.FB_ALIGNED]


def feedback_aligned(spark, d):
    return files.align_feedback(feedback_raw(spark, d))


def feedback_canonical(spark, d):
    ok, _rejected = files.canonicalize_feedback(feedback_raw(spark, d), NOW_TS, PLAN_DATE)
    return ok


register("feedback_scan", O.with_ctes(FB_CHAIN, "SELECT * FROM fba"))(feedback_aligned)


register(
    "feedback_canonical", O.with_ctes([O.FEEDBACK, O.FB_CANON], "SELECT * FROM fbc WHERE AccountId <> ''")
)(feedback_canonical)


@register(
    "feedback_union",
    O.with_ctes(
        [O.FEEDBACK, O.FB_ALIGNED, O.FB_CANON],
        "SELECT * FROM fba UNION ALL SELECT * FROM fbc WHERE AccountId <> ''",
    ),
)
def q_feedback_union(spark, d):
    return files.append_feedback(feedback_aligned(spark, d), feedback_canonical(spark, d))


@register(
    "recent_feedback",
    O.with_ctes(
        [O.FEEDBACK],
        "SELECT * EXCLUDE (event_id) REPLACE (coalesce(SupervisorEscalation, '') AS SupervisorEscalation), "
        "(SELECT count(*) FROM fb) AS total FROM fb "
        "ORDER BY RecordedAt DESC, event_id DESC LIMIT 100",
    ),
)
def q_recent_feedback(spark, d):
    page = files.record_page(feedback_raw(spark, d), 100, [F.col("RecordedAt").desc(), F.col("event_id").desc()])
    return page.drop("event_id")


@register(
    "scored_page",
    O.with_ctes(
        O.LOAN_CHAIN,
        "SELECT *, (SELECT count(*) FROM std) AS total FROM std ORDER BY RuleScore DESC, AccountNo LIMIT 200",
    ),
)
def q_scored_page(spark, d):
    return files.record_page(std_scored(spark, d), files.at_least_one(200),
                             [F.col("RuleScore").desc(), F.col("AccountNo")])


@register(
    "output_counts",
    O.with_ctes(
        PLAN_CHAIN,
        "SELECT (SELECT count(*) FROM std) AS scored_accounts, "
        "(SELECT count(*) FROM (SELECT * FROM std LIMIT 100)) AS top_risky_accounts, "
        "(SELECT count(*) FROM plan) AS visit_plan_rows, "
        "(SELECT count(DISTINCT OfficerId) FROM plan) AS officer_kpi_rows",
    ),
)
def q_output_counts(spark, d):
    out = pipeline.run(loans(spark, d), PLAN_DATE, mode="rule", materialize=True)
    rows = pipeline.write_outputs(out, new_table_path(spark))
    names = {"scored_accounts": "scored_accounts", "top_risky_accounts": "top_risky_accounts",
             "daily_visit_plan": "visit_plan_rows", "officer_kpis": "officer_kpi_rows"}
    return spark.createDataFrame([tuple(rows[n] for n in names)], ", ".join(f"{c} bigint" for c in names.values()))
