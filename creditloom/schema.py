"""Schemas and fixed values of the credit-portfolio domain.

Everything under a "Fixed values" heading must equal the behaviour the
engine reproduces (status codes, band names, message texts, presets);
they are listed plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Loan status codes and their ordinal, default statuses.
# ---------------------------------------------------------------------------
STATUS_CODES = {"STD": 0, "WCH": 1, "SUB": 2, "DBT": 3, "LOS": 4}
DEFAULT_STATUSES = ["SUB", "DBT", "LOS"]

# Required and optional loan-account columns.
REQUIRED_COLUMNS = [
    "CLStatusCode",
    "AgeDays",
    "DefaultedInst",
    "PrincipalOS",
    "PrincipalArrear",
    "InterestArrear",
    "TotalAccruedInt",
    "SecurityValue",
    "Sector",
]

# Account-id candidate columns, first present wins.
ID_CANDIDATES = [
    "LoanAccountNo",
    "LoanAccountNumber",
    "AccountNo",
    "AccountNumber",
    "ClientID",
    "ClientId",
    "CustomerID",
]

# Searchable columns of the portfolio text search.
SEARCH_COLUMNS = [
    "account_id",
    "customer_id",
    "customer_name",
    "borrower_name",
    "officer_id",
    "AccountId",
    "AccountNo",
    "CustomerID",
    "AccountName",
    "OfficerId",
    "PSOCode",
]

# Tokens a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Risk bands.
HIGH, MEDIUM, LOW = "High Risk", "Medium Risk", "Low Risk"
BANDS = [HIGH, MEDIUM, LOW]

# Model feature set.
MODEL_NUMERIC = [
    "AgeDays",
    "DefaultedInst",
    "PrincipalOS",
    "PrincipalArrear",
    "InterestArrear",
    "TotalAccruedInt",
    "ArrearRatio",
    "LTVRatio",
    "InterestStress",
    "DefaultedInstRatio",
    "DelinquencyScore",
    "InstallmentRisk",
    "PaymentFrequencyRiskFlag",
    "SectorRiskScore",
]
MODEL_CATEGORICAL = ["Sector", "RepaymentFrequency"]

# ---------------------------------------------------------------------------
# Collections texts.
# ---------------------------------------------------------------------------
OFFICER_POOL_SIZE = 5
OFFICER_UNASSIGNED = "OFFICER_UNASSIGNED"

SCRIPT_DUE = "Friendly reminder: your installment is due. Please pay today to keep your account current."
SCRIPT_OVERDUE = "Your account is overdue. Please confirm your payment date today to avoid escalation."
SCRIPT_URGENT = "Urgent follow-up: your account needs immediate action. Let's agree on a payment plan today."
SCRIPT_REGULARIZE = "Please contact us today to regularize your account and avoid further recovery actions."

NEGOTIATE_ESCALATE = "Escalate for supervised rescheduling"
NEGOTIATE_PARTIAL = "Offer partial payment plus dated follow-up"
NEGOTIATE_STANDARD = "Standard reminder; no restructuring needed"

TIP_EARLY = "Increase early reminders and same-day callbacks for new overdue cases."
TIP_COMMIT = "Prioritize repayment-date commitments and shorter revisit cycles."
TIP_REVIEW = "Review negotiation quality and involve supervisor earlier on hard cases."
TIP_STABLE = "Performance stable. Continue proactive follow-up and documentation quality."

RESOLVED_OUTCOMES = ["paid", "resolved", "regularized"]

# Plan labels.
CHANNEL_SMS, CHANNEL_CALL = "SMS", "Call"
ACTION_FIELD, ACTION_REMOTE = "Field Visit", "Remote Follow-up"
FLAG_YES, FLAG_NO = "Yes", "No"
BRANCH_UNKNOWN = "UNKNOWN"
RESCHEDULE_MARK = "reschedul"

# Feedback log columns (order) and canonical defaults for blanks.
FEEDBACK_COLUMNS = [
    "AsOfDate",
    "OfficerId",
    "AccountId",
    "VisitStatus",
    "Outcome",
    "PromiseStatus",
    "PromiseToPayDate",
    "PromisedAmount",
    "ClientHardshipFlag",
    "DisputeFlag",
    "SupervisorEscalation",
    "NextAction",
    "FieldNotes",
    "RecordedBy",
    "RecordedAt",
]
FEEDBACK_DEFAULTS = {
    "VisitStatus": "Completed",
    "Outcome": "Contacted",
    "PromiseStatus": "None",
    "ClientHardshipFlag": "No",
    "DisputeFlag": "No",
    "SupervisorEscalation": "No",
    "NextAction": "Follow-up Call",
    "RecordedBy": "system",
}

FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c == "PromisedAmount" else T.StringType(), True)
        for c in FEEDBACK_COLUMNS
    ]
)

PLAN_COLUMNS = [
    "AsOfDate",
    "OfficerId",
    "AccountId",
    "Branch",
    "DaysOverdue",
    "RiskBand",
    "PriorityScore",
    "ContactChannel",
    "VisitAction",
    "SuggestedNegotiation",
    "SuggestedScript",
    "EscalationFlag",
    "DailyVisitRank",
    "Outcome",
    "PromiseStatus",
    "SupervisorEscalation",
    "FieldNotes",
]

KPI_COLUMNS = [
    "OfficerId",
    "AssignedCases",
    "HighRiskCases",
    "AverageDaysOverdue",
    "RescheduleCandidateRate",
    "EscalationCount",
    "PctCurrent",
    "CoachingTip",
]

# ---------------------------------------------------------------------------
# Job log.
# ---------------------------------------------------------------------------
TERMINAL_STATUSES = ["succeeded", "dead_letter", "canceled"]
NO_ERROR_MESSAGE = "(no error message)"
STALE_REQUEUED = "Recovered stale running job; requeued"
STALE_EXHAUSTED = "Recovered stale running job exceeded max attempts"

JOB_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("result_json", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("max_attempts", T.IntegerType()),
        T.StructField("timeout_seconds", T.DoubleType()),
        T.StructField("next_attempt_at", T.TimestampNTZType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

# Alert recommendations, remediation priority and endpoint hints.
SIGNAL_RECOMMENDATION = {
    "worker": "Run POST /api/v1/jobs/ensure-worker-alive; if still down, run POST /api/v1/jobs/restart-worker.",
    "queue_age": "Inspect GET /api/v1/jobs/queued-oldest and reduce backlog via cancel/requeue in controlled batches.",
    "dead_letter_rate": "Pause submissions, inspect recent failures, and use dead-letter dry-run before bulk requeue.",
}
SIGNAL_PRIORITY = {"worker": 1, "dead_letter_rate": 2, "queue_age": 3}
SIGNAL_ENDPOINT = {
    "worker": "POST /api/v1/jobs/ensure-worker-alive; POST /api/v1/jobs/restart-worker",
    "dead_letter_rate": "GET /api/v1/jobs/dead-letter-recent; POST /api/v1/jobs/requeue-dead-letter?dry_run=true",
    "queue_age": "GET /api/v1/jobs/queued-oldest; POST /api/v1/jobs/cancel-queued",
}
ALL_CLEAR_REASON = "All alert signals are within configured thresholds."
NO_ACTION = "No immediate action required; continue routine monitoring."
REMEDIATION_CLEAR = "Remediation clear for deployment."
REMEDIATION_PENDING_SUFFIX = " remediation action(s) pending before deployment."

# Threshold presets (queue age s, dead-letter window s, dead letters per minute).
POLICY_PRESETS = [
    ("strict-prod", 120.0, 1800.0, 0.2),
    ("balanced", 300.0, 3600.0, 1.0),
    ("conservative", 240.0, 3600.0, 0.5),
]
# Release profiles and the gate mode each uses.
PROFILE_MODES = [("prod", "strict"), ("staging", "advice"), ("dev", "relaxed")]
PROFILE_ACTIONS = {
    "prod": "promote_to_prod",
    "staging": "hold_in_staging",
    "dev": "continue_in_dev",
    "block": "block_release",
}
PROFILE_READINESS = {
    "prod": "ready_for_prod",
    "staging": "ready_for_staging",
    "dev": "dev_only",
    "block": "blocked",
}

# Request latency histogram upper bounds, ms (last is +Inf).
LATENCY_BUCKETS_MS = [50.0, 100.0, 250.0, 500.0, 1000.0]

# ---------------------------------------------------------------------------
# Alternative-signal applicant score.
# ---------------------------------------------------------------------------
DEVICE_TENURE_POINTS = {"new": -45, "mid": 0, "established": 38}
EMPLOYMENT_POINTS = {"variable": -18, "salary": 30, "merchant": 12}
UTILITY_POINTS = {"none": -28, "partial": 4, "strong": 24}

# Applicant bands (score >= 720, < 580, otherwise), decisions, modes.
APPROVE_SCORE, RESTRICT_SCORE = 720, 580
BAND_LOW, BAND_HIGH, BAND_MEDIUM = "Low risk", "High risk", "Medium risk"
DECISION_APPROVE, DECISION_RESTRICT, DECISION_REVIEW = "Approve", "Restrict", "Review manually"
MODE_AUTO, MODE_MANUAL, MODE_CONDITIONAL = "Auto-approve threshold", "Manual review or decline", "Conditional approval"

REASON_RECHARGE_HIGH = "Frequent airtime recharges indicate steady phone usage."
REASON_RECHARGE_LOW = "Recharge behavior is still light, so usage history is less predictive."
REASON_MONEY_HIGH = "Transaction activity supports stronger cash-flow confidence."
REASON_MONEY_LOW = "Transaction intensity is moderate and should be paired with policy controls."
REASON_GEO_HIGH = "Movement patterns look stable enough for relationship-based lending."
REASON_GEO_LOW = "Movement inconsistency increases uncertainty for thin-file underwriting."
REASON_TENURE_ESTABLISHED = "Longer device tenure improves identity and continuity confidence."
REASON_TENURE_NEW = "Very recent device tenure reduces continuity confidence."
REASON_SALARY = "Salary-backed income reduces volatility in repayment expectations."
REASON_MERCHANT = "Merchant cash cycles can be strong, but may need seasonal policy tuning."
REASON_UTILITY = "On-time utility behavior reinforces repayment discipline signals."
REASON_LOAN_HIGH = "Requested amount is high relative to observed alternative-signal confidence."
