"""Queries: alternative-signal applicant score and reasons."""

from __future__ import annotations

from .. import oracle as O
from ...operators import applicants as ap
from ...schema import (
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

from .common import applicants, register


AP = [O.APPLICANT]
_PTS = {"deviceTenure": DEVICE_TENURE_POINTS, "employmentType": EMPLOYMENT_POINTS, "utilityHistory": UTILITY_POINTS}


def _pts_sql(c):
    return "CASE " + c + " " + " ".join(f"WHEN {O.q(k)} THEN {v}" for k, v in _PTS[c].items()) + " END"


_RAW = (
    "cast(500 AS double) + rechargeFrequency * 5 + mobileMoney * cast(1.2 AS double) + geoConsistency * cast(1.1 AS double) + "
    + " + ".join(_pts_sql(c) for c in _PTS)
    + " - greatest(cast(0 AS double), (requestedLoan - cast(15000 AS double)) / cast(500 AS double))"
)


register(
    "alt_score",
    O.with_ctes(
        AP,
        "SELECT *, greatest(cast(0.04 AS double), least(cast(0.42 AS double), (850 - score) / cast(950 AS double))) AS pd, "
        "greatest(5000, cast(floor((score - 300) * cast(55 AS double) + cast(0.5 AS double)) AS int)) AS loan_cap, "
        + ", ".join(
            f"CASE WHEN score >= {APPROVE_SCORE} THEN {O.q(hi)} WHEN score < {RESTRICT_SCORE} THEN {O.q(lo)} ELSE {O.q(mid)} END AS {name}"
            for name, hi, lo, mid in [("risk_band", BAND_LOW, BAND_HIGH, BAND_MEDIUM),
                                      ("decision", DECISION_APPROVE, DECISION_RESTRICT, DECISION_REVIEW),
                                      ("approval_mode", MODE_AUTO, MODE_MANUAL, MODE_CONDITIONAL)]
        )
        + " "
        f"FROM (SELECT *, greatest(320, least(850, cast(floor(({_RAW}) + cast(0.5 AS double)) AS int))) AS score FROM app)",
    ),
)(lambda spark, d: ap.alt_score(applicants(spark, d)))


_REASON_CASES = [
    f"CASE WHEN rechargeFrequency >= 16 THEN {O.q(REASON_RECHARGE_HIGH)} ELSE {O.q(REASON_RECHARGE_LOW)} END",
    f"CASE WHEN mobileMoney >= 65 THEN {O.q(REASON_MONEY_HIGH)} ELSE {O.q(REASON_MONEY_LOW)} END",
    f"CASE WHEN geoConsistency >= 70 THEN {O.q(REASON_GEO_HIGH)} ELSE {O.q(REASON_GEO_LOW)} END",
    f"CASE WHEN deviceTenure = 'established' THEN {O.q(REASON_TENURE_ESTABLISHED)} WHEN deviceTenure = 'new' THEN {O.q(REASON_TENURE_NEW)} END",
    f"CASE WHEN employmentType = 'salary' THEN {O.q(REASON_SALARY)} WHEN employmentType = 'merchant' THEN {O.q(REASON_MERCHANT)} END",
    f"CASE WHEN utilityHistory = 'strong' THEN {O.q(REASON_UTILITY)} END",
    f"CASE WHEN requestedLoan > 30000 THEN {O.q(REASON_LOAN_HIGH)} END",
]


register(
    "alt_reasons",
    O.with_ctes(
        AP,
        "SELECT applicant_id, cast(rn AS int) AS reason_rank, reason FROM (SELECT applicant_id, reason, "
        "row_number() OVER (PARTITION BY applicant_id ORDER BY k) AS rn FROM ("
        + " UNION ALL ".join(f"SELECT applicant_id, {i} AS k, {c} AS reason FROM app" for i, c in enumerate(_REASON_CASES))
        + ") WHERE reason IS NOT NULL) WHERE rn <= 4",
    ),
)(lambda spark, d: ap.alt_reasons(applicants(spark, d)))
