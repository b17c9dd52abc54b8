"""Golden 10-account book: derived features, rule scores, visit plan, KPIs."""

import pytest
from pyspark.sql import functions as F

from creditloom.operators import collections_plan as cp
from creditloom.operators.features import engineer
from creditloom.operators.quality import clean
from creditloom.operators.scoring import regular_accounts, rule_score
from creditloom.sources.files import apply_types, LOAN_TYPES

COLS = ["CLStatusCode", "AgeDays", "DefaultedInst", "PrincipalOS", "PrincipalArrear", "InterestArrear",
        "TotalAccruedInt", "SecurityValue", "Sector", "RepaymentFrequency", "TotalInstallments",
        "FutureStatusCode", "Branch"]
ROWS = [
    ("STD", 12, 0, 50000, 0, 0, 1200, 90000, "TRADE", "MONTHLY", 24, "STD", "Main Branch"),
    ("STD", 38, 1, 85000, 4000, 1300, 2450, 70000, "AGRICULTURE", "QUARTERLY", 36, "WCH", "North Branch"),
    ("STD", 95, 3, 120000, 18000, 5400, 6800, 100000, "MANUFACTURING", "MONTHLY", 48, "SUB", "East Branch"),
    ("STD", 142, 5, 68000, 12000, 3200, 5100, 55000, "SERVICES", "MONTHLY", 24, "DBT", "South Branch"),
    ("STD", 210, 7, 150000, 35000, 7800, 9800, 140000, "TRADE", "YEARLY", 60, "LOS", "West Branch"),
    ("WCH", 65, 2, 45000, 3000, 900, 1800, 60000, "TRADE", "MONTHLY", 30, "SUB", "Main Branch"),
    ("SUB", 180, 4, 98000, 22000, 6200, 7900, 85000, "AGRICULTURE", "QUARTERLY", 36, "DBT", "North Branch"),
    ("STD", 24, 0, 30000, 500, 120, 650, 40000, "SERVICES", "MONTHLY", 12, "STD", "East Branch"),
    ("STD", 58, 2, 76000, 8500, 2600, 4200, 65000, "MANUFACTURING", "MONTHLY", 36, "WCH", "South Branch"),
    ("STD", 305, 9, 200000, 50000, 15000, 16500, 175000, "TRADE", "YEARLY", 72, "LOS", "West Branch"),
]
# row: CLNum, ArrearRatio, LTVRatio, Bucket, Delinq, InstRisk, FreqFlag, SectorRisk, WillDefault, RuleScore, Category
EXPECTED = [
    (0, 0.0, 0.5555555555555556, "Low", 0, 0, 0, 0.6, 0, 20, "Low Risk"),
    (0, 0.06235294117647059, 1.2142857142857142, "Medium", 1, 1, 1, 0.8, 0, 85, "High Risk"),
    (0, 0.195, 1.2, "High", 2, 2, 0, 0.8, 1, 140, "High Risk"),
    (0, 0.2235294117647059, 1.2363636363636363, "High", 2, 2, 0, 0.8, 1, 140, "High Risk"),
    (0, 0.2853333333333333, 1.0714285714285714, "High", 3, 3, 0, 0.6, 1, 195, "High Risk"),
    (1, 0.08666666666666667, 0.75, "Medium", 1, 1, 0, 0.6, 1, 75, "High Risk"),
    (2, 0.28775510204081634, 1.1529411764705881, "High", 2, 2, 1, 0.8, 1, 140, "High Risk"),
    (0, 0.020666666666666667, 0.75, "Low", 0, 0, 0, 0.8, 0, 20, "Low Risk"),
    (0, 0.14605263157894738, 1.1692307692307693, "Medium", 1, 1, 0, 0.8, 0, 85, "High Risk"),
    (0, 0.325, 1.1428571428571428, "High", 3, 3, 0, 0.6, 1, 210, "High Risk"),
]


@pytest.fixture(scope="module")
def book(spark):
    rows = [(f"ACC_{i}",) + tuple(str(v) for v in r) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, ["AccountNo"] + COLS)
    return apply_types(df, LOAN_TYPES)


@pytest.fixture(scope="module")
def scored(book):
    return rule_score(engineer(clean(book)))


def test_features_and_rule_score(scored):
    got = {r.AccountNo: r for r in scored.collect()}
    for i, exp in enumerate(EXPECTED):
        r = got[f"ACC_{i}"]
        actual = (r.CLStatusNumeric, r.ArrearRatio, r.LTVRatio, r.AgeDaysBucket, r.DelinquencyScore,
                  r.InstallmentRisk, r.PaymentFrequencyRiskFlag, r.SectorRiskScore, r.WillDefault,
                  r.RuleScore, r.RuleRiskCategory)
        for a, e in zip(actual, exp):
            if isinstance(e, float):
                assert a == pytest.approx(e, abs=1e-12), (i, actual, exp)
            else:
                assert a == e, (i, actual, exp)


def test_visit_plan_rule_mode(scored):
    plan = cp.visit_plan(regular_accounts(scored), "2026-01-01")
    got = [(r.OfficerId, r.AccountId, r.DaysOverdue, r.PriorityScore, r.SuggestedNegotiation, r.DailyVisitRank,
            r.ContactChannel, r.VisitAction, r.EscalationFlag)
           for r in plan.orderBy("OfficerId", "DailyVisitRank").collect()]
    esc, part = "Escalate for supervised rescheduling", "Offer partial payment plus dated follow-up"
    expected = [
        ("OFFICER_1", "ACC_2", 95.0, 1.0, esc, 1),
        ("OFFICER_2", "ACC_1", 38.0, 0.6047619047619048, part, 1),
        ("OFFICER_3", "ACC_3", 142.0, 1.0, esc, 1),
        ("OFFICER_3", "ACC_8", 58.0, 0.6047619047619048, esc, 2),
        ("OFFICER_4", "ACC_9", 305.0, 1.0, esc, 1),
        ("OFFICER_4", "ACC_4", 210.0, 1.0, esc, 2),
    ]
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:3] == e[:3] and g[3] == pytest.approx(e[3], abs=1e-12) and g[4:6] == e[4:6]
        assert g[6:] == ("Call", "Field Visit", "Yes")
    assert plan.columns[-4:] == ["Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes"]


def test_officer_kpis(scored):
    kpi = cp.officer_kpis(cp.visit_plan(regular_accounts(scored), "2026-01-01")).collect()
    got = [(r.OfficerId, r.AssignedCases, r.HighRiskCases, r.AverageDaysOverdue, r.PctCurrent,
            r.RescheduleCandidateRate, r.EscalationCount) for r in kpi]
    assert got == [
        ("OFFICER_1", 1, 1, 95.0, 0.0, 1.0, 1),
        ("OFFICER_2", 1, 1, 38.0, 0.367, 0.0, 1),
        ("OFFICER_3", 2, 2, 100.0, 0.0, 1.0, 2),
        ("OFFICER_4", 2, 2, 257.5, 0.0, 1.0, 2),
    ]
    assert {r.CoachingTip for r in kpi} == {"Increase early reminders and same-day callbacks for new overdue cases."}


def test_feedback_adjustments(spark, scored):
    fb = spark.createDataFrame(
        [
            ("ACC_1", "2026-01-01T00:00:00Z", "Paid", "None", "No"),
            ("ACC_1", "2026-01-02T00:00:00Z", "Contacted", "Broken", "Yes"),
            ("ACC_3", "2026-01-02T00:00:00Z", "RESOLVED", "None", "No"),
            ("ACC_9", "not-a-date", "Paid", "None", "No"),
            ("ACC_777", "2026-01-02T00:00:00Z", "Paid", "None", "No"),
        ],
        ["AccountId", "RecordedAt", "Outcome", "PromiseStatus", "SupervisorEscalation"],
    ).withColumn("FieldNotes", F.lit("n"))
    plan = cp.visit_plan(regular_accounts(scored), "2026-01-01", fb)
    got = {r.AccountId: (r.OfficerId, r.PriorityScore, r.DailyVisitRank) for r in plan.collect()}
    assert set(got) == {"ACC_1", "ACC_2", "ACC_8", "ACC_4"}
    assert got["ACC_1"][1] == pytest.approx(0.6047619047619048 + 0.35)
    assert got["ACC_8"][2] == 1 and got["ACC_4"][2] == 1


def test_edge_rows(spark):
    rows = [
        ("E1", " std ", "30", "2", "100", "0", "0", "10", "0", "", None, "NA", "Main"),
        ("E2", "XYZ", "NA", "5", None, "1", "1", "0", "50", "TRADE", "Monthly", "STD", None),
        ("E2", "XYZ", "NA", "5", None, "1", "1", "0", "50", "TRADE", "Monthly", "STD", None),
    ]
    cols = ["AccountNo", "CLStatusCode", "AgeDays", "DefaultedInst", "PrincipalOS", "PrincipalArrear",
            "InterestArrear", "TotalAccruedInt", "SecurityValue", "Sector", "RepaymentFrequency",
            "FutureStatusCode", "Branch"]
    from creditloom.sources.files import null_na_tokens
    df = apply_types(null_na_tokens(spark.createDataFrame(rows, cols)), LOAN_TYPES)
    out = {r.AccountNo: r for r in rule_score(engineer(clean(df))).collect()}
    assert len(out) == 2  # exact duplicate removed
    e1, e2 = out["E1"], out["E2"]
    assert e1.CLStatusNumeric == 0 and e2.CLStatusNumeric == -1
    assert e1.LTVRatio == pytest.approx(100 / 1e-9)  # zero collateral -> 1e-9 denominator
    assert e2.AgeDays == 30.0  # median fill
    assert e2.PrincipalOS == 100.0
    assert e1.Sector == "UNKNOWN" and e1.RepaymentFrequency == "UNKNOWN"
    assert e1.AgeDaysBucket == "Low" and e1.DelinquencyScore == 0 and e1.InstallmentRisk == 1


def test_missing_required_column(spark):
    from creditloom.plans.pipeline import score_rules

    with pytest.raises(ValueError, match="Missing required columns"):
        score_rules(spark.createDataFrame([("STD",)], ["CLStatusCode"]))


def test_dedupe_with_and_without_unique_ids(spark):
    from creditloom.operators.quality import drop_duplicate_rows

    rows = [("A1", "x", 1), ("A2", "y", 2), ("A2", "y", 2), ("A3", None, None), ("A3", None, None), ("A4", "z", 3)]
    df = spark.createDataFrame(rows, "AccountNo string, t string, v int")
    assert drop_duplicate_rows(df).count() == 4
    unique = df.dropDuplicates()
    assert drop_duplicate_rows(unique).count() == 4
    no_id = df.drop("AccountNo")
    assert drop_duplicate_rows(no_id).count() == 4


def test_stable_officer_map_and_loan_officer(spark, scored):
    m = spark.createDataFrame([("East Branch", "OFF_E"), ("North Branch", "OFF_N")], "Branch string, OfficerId string")
    plan = cp.visit_plan(regular_accounts(scored), "2026-01-01", officer_map=m)
    got = {r.AccountId: r.OfficerId for r in plan.collect()}
    assert got["ACC_2"] == "OFF_E" and got["ACC_1"] == "OFF_N" and got["ACC_9"] is None
    with_lo = regular_accounts(scored).withColumn("LoanOfficer", F.when(F.col("AccountNo") == "ACC_2", " ").otherwise("LO_1"))
    got = {r.AccountId: r.OfficerId for r in cp.visit_plan(with_lo, "2026-01-01").collect()}
    assert got["ACC_2"] == "OFFICER_UNASSIGNED" and got["ACC_1"] == "LO_1"


def test_empty_book(spark, book):
    empty = book.limit(0)
    scored_empty = rule_score(engineer(clean(empty)))
    assert scored_empty.count() == 0
    plan = cp.visit_plan(regular_accounts(scored_empty), "2026-01-01")
    assert plan.count() == 0 and len(plan.columns) == 17
    assert cp.officer_kpis(plan).count() == 0


def test_clean_with_approx_medians(spark, book):
    from pyspark.sql import functions as F

    gappy = book.withColumn("AgeDays", F.when(F.col("AccountNo") == "ACC_0", F.lit(None)).otherwise(F.col("AgeDays")))
    exact = {r.AccountNo: r.AgeDays for r in clean(gappy).collect()}
    approx = {r.AccountNo: r.AgeDays for r in clean(gappy, approx=True).collect()}
    assert exact["ACC_0"] == 95.0  # median of the nine other ages
    assert abs(approx["ACC_0"] - exact["ACC_0"]) <= 40
