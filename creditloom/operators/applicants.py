"""Alternative-signal credit score for applicants (thin-file underwriting)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import literal_map
from ..schema import (
    APPROVE_SCORE,
    BAND_HIGH,
    BAND_LOW,
    BAND_MEDIUM,
    DECISION_APPROVE,
    DECISION_RESTRICT,
    DECISION_REVIEW,
    DEVICE_TENURE_POINTS,
    EMPLOYMENT_POINTS,
    MODE_AUTO,
    MODE_CONDITIONAL,
    MODE_MANUAL,
    REASON_GEO_HIGH,
    REASON_GEO_LOW,
    REASON_LOAN_HIGH,
    REASON_MERCHANT,
    REASON_MONEY_HIGH,
    REASON_MONEY_LOW,
    REASON_RECHARGE_HIGH,
    REASON_RECHARGE_LOW,
    REASON_SALARY,
    REASON_TENURE_ESTABLISHED,
    REASON_TENURE_NEW,
    REASON_UTILITY,
    RESTRICT_SCORE,
    UTILITY_POINTS,
)


def half_up(x: Column) -> Column:
    """Round half up (towards +inf), the browser's Math.round."""
    return F.floor(x + F.lit(0.5))


def alt_score(app: DataFrame) -> DataFrame:
    """Score 320..850, default probability, loan cap, band, decision, mode."""
    raw = (
        F.lit(500.0)
        + F.col("rechargeFrequency") * 5
        + F.col("mobileMoney") * F.lit(1.2)
        + F.col("geoConsistency") * F.lit(1.1)
        + literal_map(DEVICE_TENURE_POINTS)[F.col("deviceTenure")]
        + literal_map(EMPLOYMENT_POINTS)[F.col("employmentType")]
        + literal_map(UTILITY_POINTS)[F.col("utilityHistory")]
        - F.greatest(F.lit(0.0), (F.col("requestedLoan") - F.lit(15000.0)) / F.lit(500.0))
    )
    score = F.greatest(F.lit(320), F.least(F.lit(850), half_up(raw).cast("int")))
    out = app.withColumn("score", score)
    s = F.col("score")
    out = out.withColumn("pd", F.greatest(F.lit(0.04), F.least(F.lit(0.42), (F.lit(850) - s) / F.lit(950.0))))
    out = out.withColumn("loan_cap", F.greatest(F.lit(5000), half_up((s - 300) * F.lit(55.0)).cast("int")))
    hi, lo = s >= APPROVE_SCORE, s < RESTRICT_SCORE
    return (
        out.withColumn("risk_band", F.when(hi, BAND_LOW).when(lo, BAND_HIGH).otherwise(BAND_MEDIUM))
        .withColumn("decision", F.when(hi, DECISION_APPROVE).when(lo, DECISION_RESTRICT).otherwise(DECISION_REVIEW))
        .withColumn("approval_mode", F.when(hi, MODE_AUTO).when(lo, MODE_MANUAL).otherwise(MODE_CONDITIONAL))
    )


def alt_reasons(app: DataFrame, max_reasons: int = 4) -> DataFrame:
    """Ordered reason codes, at most ``max_reasons`` per applicant (long form)."""
    cands = F.array(
        F.when(F.col("rechargeFrequency") >= 16, REASON_RECHARGE_HIGH).otherwise(REASON_RECHARGE_LOW),
        F.when(F.col("mobileMoney") >= 65, REASON_MONEY_HIGH).otherwise(REASON_MONEY_LOW),
        F.when(F.col("geoConsistency") >= 70, REASON_GEO_HIGH).otherwise(REASON_GEO_LOW),
        F.when(F.col("deviceTenure") == "established", REASON_TENURE_ESTABLISHED).when(
            F.col("deviceTenure") == "new", REASON_TENURE_NEW
        ),
        F.when(F.col("employmentType") == "salary", REASON_SALARY).when(F.col("employmentType") == "merchant", REASON_MERCHANT),
        F.when(F.col("utilityHistory") == "strong", REASON_UTILITY),
        F.when(F.col("requestedLoan") > 30000, REASON_LOAN_HIGH),
    )
    kept = F.slice(F.filter(cands, lambda r: r.isNotNull()), 1, max_reasons)
    return app.select("applicant_id", F.posexplode(kept).alias("reason_rank", "reason")).withColumn(
        "reason_rank", F.col("reason_rank") + 1
    )
