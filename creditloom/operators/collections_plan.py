"""Daily visit plan, field-feedback adjustments and officer KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, count_if, join_small, ntz_micros, parse_stamp, round_half_even, strip
from ..schema import (
    ACTION_FIELD,
    ACTION_REMOTE,
    BRANCH_UNKNOWN,
    CHANNEL_CALL,
    CHANNEL_SMS,
    FLAG_NO,
    FLAG_YES,
    HIGH,
    LOW,
    MEDIUM,
    NEGOTIATE_ESCALATE,
    NEGOTIATE_PARTIAL,
    NEGOTIATE_STANDARD,
    OFFICER_POOL_SIZE,
    OFFICER_UNASSIGNED,
    PLAN_COLUMNS,
    RESCHEDULE_MARK,
    RESOLVED_OUTCOMES,
    SCRIPT_DUE,
    SCRIPT_OVERDUE,
    SCRIPT_REGULARIZE,
    SCRIPT_URGENT,
    TIP_COMMIT,
    TIP_EARLY,
    TIP_REVIEW,
    TIP_STABLE,
)
from ..session import cut_lineage
from .ordering import global_row_index, rank_within_groups
from .scoring import id_column

# ---------------------------------------------------------------------------
# Candidates
# ---------------------------------------------------------------------------


def _numeric_or_zero(df: DataFrame, c: str) -> Column:
    if c not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))


def risk_band(df: DataFrame) -> Column:
    """Model band, else rule band, else every account Low (decided at plan time)."""
    for c in ("ModelRiskCategory", "RuleRiskCategory"):
        if c in df.columns:
            return F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return F.lit(LOW)


def with_risk_core(df: DataFrame) -> DataFrame:
    """RiskCore in [0, 1]: model probability, else RuleScore / max(max, 1)."""
    if "PredDefaultProbability" in df.columns:
        return df.withColumn("RiskCore", clip(F.col("PredDefaultProbability").cast("double"), 0.0, 1.0))
    if "RuleScore" in df.columns:
        mx = df.agg(F.greatest(F.coalesce(F.max(F.col("RuleScore").cast("double")), F.lit(1.0)), F.lit(1.0))).scalar()
        return df.withColumn("RiskCore", clip(F.col("RuleScore").cast("double") / mx, 0.0, 1.0))
    return df.withColumn("RiskCore", F.lit(0.0))


def prioritize(df: DataFrame) -> DataFrame:
    """DaysOverdue, InstallmentRisk (coerced), RiskBand, RiskCore, PriorityScore."""
    out = df.withColumn("DaysOverdue", _numeric_or_zero(df, "AgeDays"))
    out = out.withColumn("InstallmentRisk", _numeric_or_zero(df, "InstallmentRisk"))
    out = out.withColumn("RiskBand", risk_band(df))
    out = with_risk_core(out)
    score = (
        F.col("RiskCore")
        + F.when(F.col("DaysOverdue") > 15, 0.2).otherwise(0.0)
        + F.when(F.col("InstallmentRisk") >= 2, 0.15).otherwise(0.0)
    )
    return out.withColumn("PriorityScore", clip(score, 0.0, 1.0))


def visit_candidates(scored: DataFrame) -> DataFrame:
    """Medium/High accounts; when the book has none, accounts > 15 days late.

    "Has none" is a scalar subquery over the book, so the choice needs no
    driver round trip and no join, and is a single filter.
    """
    pri = prioritize(scored)
    mh = F.col("RiskBand").isin(MEDIUM, HIGH)
    any_mh = pri.agg(F.max(mh.cast("int"))).scalar()
    return pri.filter(F.when(any_mh == 1, mh).otherwise(F.col("DaysOverdue") > 15))


# ---------------------------------------------------------------------------
# Officers
# ---------------------------------------------------------------------------


def officer_label(ordinal: Column, pool: int) -> Column:
    return F.concat(F.lit("OFFICER_"), ((ordinal % pool) + 1).cast("string"))


def branch_officer_map(cand: DataFrame, pool: int = OFFICER_POOL_SIZE) -> DataFrame:
    """(Branch, OfficerId): sorted distinct branches numbered modulo ``pool``."""
    branches = cand.select(F.coalesce(F.col("Branch").cast("string"), F.lit("nan")).alias("Branch")).distinct()
    numbered = global_row_index(branches, [F.col("Branch").asc()], "_ord")
    return numbered.select("Branch", officer_label(F.col("_ord"), pool).alias("OfficerId"))


def assign_officers(cand: DataFrame, pool: int = OFFICER_POOL_SIZE, order_cols: list[Column] | None = None,
                    officer_map: DataFrame | None = None) -> DataFrame:
    """OfficerId: ``LoanOfficer`` when present; else a stable (Branch,
    OfficerId) table when given; else branches numbered in sorted order
    (the numbering depends on which branches have candidates); else a round
    robin over the accounts in id order."""
    if "LoanOfficer" in cand.columns:
        officer = F.coalesce(F.when(strip(F.col("LoanOfficer").cast("string")) != "", F.col("LoanOfficer").cast("string")),
                             F.lit(OFFICER_UNASSIGNED))
        return cand.withColumn("OfficerId", officer)
    # a Branch column without any value says nothing: the round robin below holds
    if officer_map is not None or ("Branch" in cand.columns and not cand.filter(F.col("Branch").isNotNull()).select("Branch").isEmpty()):
        mapping = officer_map.select("Branch", "OfficerId") if officer_map is not None else branch_officer_map(cand, pool)
        mapping = mapping.withColumnRenamed("Branch", "_branch_key")
        keyed = cand.withColumn("_branch_key", F.coalesce(F.col("Branch").cast("string"), F.lit("nan")))
        # one row per distinct branch: broadcast after a size check
        return join_small(keyed, mapping, "_branch_key", "left").drop("_branch_key")
    order = order_cols or [F.col("AccountId").asc()]
    idx = global_row_index(cand, order, "_row")
    return idx.withColumn("OfficerId", officer_label(F.col("_row"), pool)).drop("_row")


# ---------------------------------------------------------------------------
# Plan
# ---------------------------------------------------------------------------


def negotiation(days: Column, inst: Column) -> Column:
    return (
        F.when(days > 45, NEGOTIATE_ESCALATE)
        .when((days > 15) | (inst >= 2), NEGOTIATE_PARTIAL)
        .otherwise(NEGOTIATE_STANDARD)
    )


def contact_script(days: Column, band: Column) -> Column:
    return (
        F.when(days <= 7, SCRIPT_DUE)
        .when(days <= 30, SCRIPT_OVERDUE)
        .when(band == HIGH, SCRIPT_URGENT)
        .otherwise(SCRIPT_REGULARIZE)
    )


def rank_visits(plan: DataFrame, tie_cols: list[Column]) -> DataFrame:
    """DailyVisitRank: 1..n per officer by PriorityScore desc, then ties.

    Officers are few and one may hold a large share of the plan, so the
    rank is computed over range slices instead of a per-officer window.
    """
    order = [F.col("PriorityScore").desc()] + tie_cols + [F.col("AccountId").asc()]
    return rank_within_groups(plan, ["OfficerId"], order, "DailyVisitRank", few_groups=True)


def _tie_columns(df: DataFrame) -> list[str]:
    return [c for c in ("PredDefaultProbability", "RuleScore") if c in df.columns][:1]


def visit_plan(
    scored: DataFrame,
    as_of_date: str,
    feedback: DataFrame | None = None,
    pool: int = OFFICER_POOL_SIZE,
    officer_map: DataFrame | None = None,
    ranked: bool = True,
) -> DataFrame:
    """Ranked daily visit plan (fixed 17 columns; feedback columns null without feedback).

    ``ranked=False`` leaves ``DailyVisitRank`` null and skips the ranking
    shuffle - for consumers such as the KPIs that do not read it.
    """
    cand = visit_candidates(scored)
    cand = cand.withColumn("AccountId", F.col(id_column(cand)).cast("string"))
    cand = assign_officers(cand, pool, officer_map=officer_map)
    branch = F.col("Branch").cast("string") if "Branch" in cand.columns else F.lit(BRANCH_UNKNOWN)
    days, band = F.col("DaysOverdue"), F.col("RiskBand")
    ties = _tie_columns(cand)
    plan = cand.select(
        F.lit(as_of_date).alias("AsOfDate"),
        "OfficerId",
        "AccountId",
        F.coalesce(branch, F.lit("nan")).alias("Branch"),
        "DaysOverdue",
        "RiskBand",
        "PriorityScore",
        F.when(days <= 7, CHANNEL_SMS).otherwise(CHANNEL_CALL).alias("ContactChannel"),
        F.when(days > 15, ACTION_FIELD).otherwise(ACTION_REMOTE).alias("VisitAction"),
        negotiation(days, F.col("InstallmentRisk")).alias("SuggestedNegotiation"),
        contact_script(days, band).alias("SuggestedScript"),
        F.when((days > 45) | (band == HIGH), FLAG_YES).otherwise(FLAG_NO).alias("EscalationFlag"),
        *[F.col(c).alias(f"_tie_{c}") for c in ties],
    )
    tie_cols = [F.col(f"_tie_{c}").desc_nulls_last() for c in ties]
    if feedback is None:
        out = rank_visits(plan, tie_cols) if ranked else plan.withColumn("DailyVisitRank", F.lit(None).cast("bigint"))
        for c in ("Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes"):
            out = out.withColumn(c, F.lit(None).cast("string"))
        return out.select(*PLAN_COLUMNS)
    return apply_feedback(plan, feedback, tie_cols, ranked)


# ---------------------------------------------------------------------------
# Feedback
# ---------------------------------------------------------------------------

def parse_recorded_at(c: Column) -> Column:
    """ISO-8601 text to microseconds of its UTC time, whatever the session's zone; unparsable text becomes null."""
    return ntz_micros(parse_stamp(c))


def latest_feedback(feedback: DataFrame, tie_col: str | None = None) -> DataFrame:
    """Most recent feedback row per AccountId (unparsable stamps last).

    A grouped ``max`` over a struct whose leading fields are the ordering
    key: partial aggregation collapses each account map-side, so an account
    with a third of all rows is still combined in parallel.
    """
    tie = tie_col or ("event_id" if "event_id" in feedback.columns else None)
    ts = parse_recorded_at(F.col("RecordedAt"))
    payload = ["Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes", "RecordedAt"]
    key = [ts.isNotNull().alias("k0"), ts.alias("k1")]
    key.append((F.col(tie) if tie else F.col("RecordedAt").cast("string")).alias("k2"))
    fb = feedback.withColumn("AccountId", F.col("AccountId").cast("string"))
    best = fb.groupBy("AccountId").agg(
        F.max(F.struct(*key, *[F.col(c).cast("string").alias(c) for c in payload])).alias("m")
    )
    return best.select("AccountId", *[F.col(f"m.{c}").alias(c) for c in payload])


def apply_feedback(plan: DataFrame, feedback: DataFrame, tie_cols: list[Column] | None = None,
                   ranked: bool = True) -> DataFrame:
    """Re-score the plan with each account's latest outcome; drop paid/resolved."""
    # one row per account with feedback, aggregated once: the size check and
    # the join both read the materialised table
    latest = cut_lineage(
        latest_feedback(feedback).select("AccountId", "Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes")
    )
    base = plan.drop("DailyVisitRank", "Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes")
    # one row per account with feedback: broadcast only when the count allows
    merged = join_small(base, latest, "AccountId", "left")
    merged = (
        merged.withColumn("Outcome", F.coalesce(F.col("Outcome"), F.lit("")))
        .withColumn("PromiseStatus", F.coalesce(F.col("PromiseStatus"), F.lit("")))
        .withColumn("SupervisorEscalation", F.coalesce(F.col("SupervisorEscalation"), F.lit("No")))
    )
    paid = F.lower(F.col("Outcome")).isin(*RESOLVED_OUTCOMES)
    broken = F.lower(F.col("PromiseStatus")) == "broken"
    escalated = F.lower(F.col("SupervisorEscalation")) == "yes"
    score = (
        F.col("PriorityScore")
        + F.when(escalated, 0.2).otherwise(0.0)
        + F.when(broken, 0.15).otherwise(0.0)
        - F.when(paid, 0.3).otherwise(0.0)
    )
    merged = merged.withColumn("PriorityScore", clip(score, 0.0, 1.0)).filter(~paid)
    if tie_cols is None:
        tie_cols = [F.col(c).desc_nulls_last() for c in merged.columns if c.startswith("_tie_")]
    if not ranked:
        return merged.withColumn("DailyVisitRank", F.lit(None).cast("bigint")).select(*PLAN_COLUMNS)
    return rank_visits(merged, tie_cols).select(*PLAN_COLUMNS)


# ---------------------------------------------------------------------------
# KPIs
# ---------------------------------------------------------------------------


def coaching_tip(pct: Column, avg_days: Column, escalations: Column) -> Column:
    return (
        F.when(pct < 0.7, TIP_EARLY)
        .when(avg_days > 20, TIP_COMMIT)
        .when(escalations > 5, TIP_REVIEW)
        .otherwise(TIP_STABLE)
    )


def officer_kpis(plan: DataFrame) -> DataFrame:
    """Per-officer workload and quality indicators, ordered by officer.

    One grouped aggregate (partial + final), no Python.
    """
    resched = F.coalesce(F.lower(F.col("SuggestedNegotiation")).contains(RESCHEDULE_MARK), F.lit(False))
    kpi = plan.groupBy("OfficerId").agg(
        F.count("AccountId").alias("AssignedCases"),
        count_if(F.col("RiskBand") == HIGH).alias("HighRiskCases"),
        F.avg(F.col("DaysOverdue").cast("double")).alias("_avg"),
        F.avg(resched.cast("double")).alias("_resched"),
        count_if(F.col("EscalationFlag") == FLAG_YES).alias("EscalationCount"),
    )
    pct = clip(F.lit(1.0) - F.col("_avg") / F.lit(60.0), 0.0, 1.0)
    kpi = kpi.withColumn("_pct", pct)
    return kpi.select(
        "OfficerId",
        "AssignedCases",
        "HighRiskCases",
        round_half_even(F.col("_avg"), 2).alias("AverageDaysOverdue"),
        round_half_even(F.col("_resched"), 3).alias("RescheduleCandidateRate"),
        "EscalationCount",
        round_half_even(F.col("_pct"), 3).alias("PctCurrent"),
        coaching_tip(F.col("_pct"), F.col("_avg"), F.col("EscalationCount")).alias("CoachingTip"),
    ).orderBy("OfficerId")
