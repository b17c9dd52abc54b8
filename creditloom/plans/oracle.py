"""Independent SQL (DuckDB dialect) for every registered query.

The CTEs below re-state each operator's semantics in plain SQL over the
pre-registered driver tables; they share no code with the Spark side.
"""

from __future__ import annotations

from ..schema import (
    HIGH,
    LOW,
    MEDIUM,
    NEGOTIATE_ESCALATE,
    NEGOTIATE_PARTIAL,
    NEGOTIATE_STANDARD,
    SCRIPT_DUE,
    SCRIPT_OVERDUE,
    SCRIPT_REGULARIZE,
    SCRIPT_URGENT,
    TIP_COMMIT,
    TIP_EARLY,
    TIP_REVIEW,
    TIP_STABLE,
)

AS_OF = "timestamp '2024-01-31 00:00:00'"
UNKNOWN = "'Unknown'"
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LOAN = """
li AS (
  SELECT l_orderkey,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN cast(l_extendedprice AS decimal(12,2)) ELSE 0 END) AS p_arr,
         sum(cast(l_extendedprice AS decimal(12,2)) * cast(l_discount AS decimal(4,2))) AS i_arr,
         sum(cast(l_extendedprice AS decimal(12,2)) * cast(l_tax AS decimal(4,2))) AS acc_int
  FROM lineitem GROUP BY l_orderkey
),
loan AS (
  SELECT concat('ACC_', cast(o_orderkey AS varchar(20))) AS AccountNo,
         o_custkey AS CustomerID, c_name AS AccountName, n_name AS Branch, c_mktsegment AS Sector,
         CASE WHEN o_orderstatus = 'O' THEN 'STD'
              WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN ' std '
              WHEN o_orderstatus = 'P' THEN 'WCH'
              WHEN o_orderkey % 3 = 0 THEN 'SUB'
              WHEN o_orderkey % 3 = 1 THEN 'DBT' ELSE 'LOS' END AS CLStatusCode,
         CASE WHEN n_ret >= 3 AND o_orderkey % 240 > 90 THEN 'SUB'
              WHEN o_orderkey % 17 = 0 THEN 'LOS'
              WHEN o_orderkey % 5 = 0 THEN 'WCH' ELSE 'STD' END AS FutureStatusCode,
         coalesce(cast(o_orderkey % 240 AS int), 0) AS AgeDays,
         coalesce(cast(n_ret AS int), 0) AS DefaultedInst,
         cast(n_lines AS int) AS TotalInstallments,
         coalesce(o_totalprice, 0) AS PrincipalOS,
         coalesce(cast(p_arr AS double), 0) AS PrincipalArrear,
         coalesce(cast(i_arr AS double), 0) AS InterestArrear,
         coalesce(cast(acc_int AS double), 0) AS TotalAccruedInt,
         CASE WHEN o_orderkey % 50 = 0 THEN cast(0 AS double)
              ELSE coalesce(o_totalprice, 0) * (cast(5 + o_orderkey % 11 AS double) / 10) END AS SecurityValue,
         CASE WHEN o_orderkey % 60 = 0 THEN cast(0 AS double) ELSE coalesce(o_totalprice, 0) * cast(1.25 AS double) END AS DisbAmount,
         CASE o_orderpriority WHEN '2-HIGH' THEN 'Quarterly' WHEN '3-MEDIUM' THEN 'Half Yearly'
              WHEN '4-NOT SPECIFIED' THEN 'Yearly' ELSE 'Monthly' END AS RepaymentFrequency
  FROM orders
  JOIN li ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""

_NUM = ["AgeDays", "DefaultedInst", "TotalInstallments", "PrincipalOS", "PrincipalArrear", "InterestArrear",
        "TotalAccruedInt", "SecurityValue", "DisbAmount"]
_TEXT = ["AccountNo", "AccountName", "Branch", "Sector", "CLStatusCode", "FutureStatusCode", "RepaymentFrequency"]

CLEAN = (
    """
dedup AS (SELECT DISTINCT * FROM loan),
med AS (SELECT """
    + ", ".join(f"median(cast({c} AS double)) AS m_{c}" for c in _NUM)
    + """ FROM dedup),
clean AS (
  SELECT """
    + ", ".join(
        [f"{strip(f'coalesce({c}, {UNKNOWN})')} AS {c}" for c in _TEXT]
        + ["CustomerID"]
        + [f"coalesce(cast({c} AS double), m_{c}) AS {c}" for c in _NUM]
    )
    + """
  FROM dedup CROSS JOIN med
)"""
)

_DIV = "{n} / coalesce(CASE WHEN cast({d} AS double) <> 0 THEN cast({d} AS double) END, cast(1e-9 AS double))"


def safe_div(n: str, d: str) -> str:
    return _DIV.format(n=n, d=d)


FEATURES = (
    """
f0 AS (
  SELECT * REPLACE (upper(""" + strip("CLStatusCode") + """) AS CLStatusCode,
                    upper(""" + strip("RepaymentFrequency") + """) AS RepaymentFrequency,
                    upper(""" + strip("Sector") + """) AS Sector)
  FROM clean
),
shares AS (
  SELECT Sector AS s_sector, cast(count(*) AS double) / cast(sum(count(*)) OVER () AS double) AS share
  FROM f0 GROUP BY Sector
),
features AS (
  SELECT f0.*,
         CASE CLStatusCode WHEN 'STD' THEN 0 WHEN 'WCH' THEN 1 WHEN 'SUB' THEN 2 WHEN 'DBT' THEN 3
              WHEN 'LOS' THEN 4 ELSE -1 END AS CLStatusNumeric,
         """ + safe_div("(PrincipalArrear + InterestArrear)", "PrincipalOS") + """ AS ArrearRatio,
         """ + safe_div("PrincipalOS", "SecurityValue") + """ AS LTVRatio,
         """ + safe_div("InterestArrear", "TotalAccruedInt") + """ AS InterestStress,
         """ + safe_div("cast(DefaultedInst AS double)", "TotalInstallments") + """ AS DefaultedInstRatio,
         CASE WHEN AgeDays <= 30 THEN 'Low' WHEN AgeDays <= 90 THEN 'Medium'
              WHEN AgeDays IS NOT NULL THEN 'High' END AS AgeDaysBucket,
         CASE WHEN AgeDays > 180 THEN 3 WHEN AgeDays > 90 THEN 2 WHEN AgeDays > 30 THEN 1 ELSE 0 END AS DelinquencyScore,
         CASE WHEN DefaultedInst > 5 THEN 3 WHEN DefaultedInst > 2 THEN 2 WHEN DefaultedInst > 0 THEN 1 ELSE 0 END
           AS InstallmentRisk,
         CASE WHEN RepaymentFrequency IN ('QUARTERLY', 'HALF YEARLY') THEN 1 ELSE 0 END AS PaymentFrequencyRiskFlag,
         coalesce(cast(1 AS double) - share, cast(0.5 AS double)) AS SectorRiskScore,
         CASE WHEN upper(""" + strip("FutureStatusCode") + """) IN ('SUB', 'DBT', 'LOS') THEN 1 ELSE 0 END AS WillDefault
  FROM f0 LEFT JOIN shares ON f0.Sector IS NOT DISTINCT FROM s_sector
)"""
)

SCORED = f"""
scored AS (
  SELECT *, CASE WHEN RuleScore >= 70 THEN {q(HIGH)} WHEN RuleScore >= 40 THEN {q(MEDIUM)} ELSE {q(LOW)} END
              AS RuleRiskCategory
  FROM (SELECT *, DelinquencyScore * 30 + InstallmentRisk * 25
                  + CASE WHEN LTVRatio > 0.8 THEN 20 ELSE 10 END
                  + CASE WHEN ArrearRatio > 0.3 THEN 25 ELSE 10 END AS RuleScore
        FROM features)
),
std AS (SELECT * FROM scored WHERE upper(CLStatusCode) = 'STD')"""

LOAN_CHAIN = [LOAN, CLEAN, FEATURES, SCORED]


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n" + body


def _f(x: float) -> str:
    return f"cast({x!r} AS double)"


def clip(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"least(greatest({x}, {_f(lo)}), {_f(hi)})"


def round_even(x: str, k: int) -> str:
    s = float(10**k)
    return f"(round_even(({x}) * {_f(s)}, 0) / {_f(s)})"


# -- visit plan, rule mode, from the regular (STD) accounts -------------------
PLAN = f"""
pri0 AS (
  SELECT *, coalesce(cast(AgeDays AS double), {_f(0.0)}) AS DaysOverdue,
         coalesce(cast(InstallmentRisk AS double), {_f(0.0)}) AS InstRiskNum,
         coalesce(RuleRiskCategory, 'nan') AS RiskBand,
         {clip('cast(RuleScore AS double) / mx')} AS RiskCore
  FROM std CROSS JOIN (SELECT greatest(coalesce(max(cast(RuleScore AS double)), {_f(1.0)}), {_f(1.0)}) AS mx FROM std)
),
pri AS (
  SELECT *, {clip(f"RiskCore + CASE WHEN DaysOverdue > 15 THEN {_f(0.2)} ELSE {_f(0.0)} END + CASE WHEN InstRiskNum >= 2 THEN {_f(0.15)} ELSE {_f(0.0)} END")} AS PriorityScore
  FROM pri0
),
cand AS (
  SELECT pri.* FROM pri CROSS JOIN (
    SELECT max(CASE WHEN RiskBand IN ({q(MEDIUM)}, {q(HIGH)}) THEN 1 ELSE 0 END) AS any_mh FROM pri)
  WHERE CASE WHEN any_mh = 1 THEN RiskBand IN ({q(MEDIUM)}, {q(HIGH)}) ELSE DaysOverdue > 15 END
),
officers AS (
  SELECT Branch AS o_branch,
         concat('OFFICER_', cast((row_number() OVER (ORDER BY Branch) - 1) % 5 + 1 AS varchar)) AS OfficerId
  FROM (SELECT DISTINCT Branch FROM cand)
),
plan0 AS (
  SELECT '2024-01-31' AS AsOfDate, OfficerId, cast(AccountNo AS varchar) AS AccountId, Branch, DaysOverdue, RiskBand,
         PriorityScore,
         CASE WHEN DaysOverdue <= 7 THEN 'SMS' ELSE 'Call' END AS ContactChannel,
         CASE WHEN DaysOverdue > 15 THEN 'Field Visit' ELSE 'Remote Follow-up' END AS VisitAction,
         CASE WHEN DaysOverdue > 45 THEN {q(NEGOTIATE_ESCALATE)}
              WHEN DaysOverdue > 15 OR InstRiskNum >= 2 THEN {q(NEGOTIATE_PARTIAL)}
              ELSE {q(NEGOTIATE_STANDARD)} END AS SuggestedNegotiation,
         CASE WHEN DaysOverdue <= 7 THEN {q(SCRIPT_DUE)}
              WHEN DaysOverdue <= 30 THEN {q(SCRIPT_OVERDUE)}
              WHEN RiskBand = {q(HIGH)} THEN {q(SCRIPT_URGENT)}
              ELSE {q(SCRIPT_REGULARIZE)} END AS SuggestedScript,
         CASE WHEN DaysOverdue > 45 OR RiskBand = {q(HIGH)} THEN 'Yes' ELSE 'No' END AS EscalationFlag,
         RuleScore AS tie
  FROM cand LEFT JOIN officers ON Branch = o_branch
),
plan AS (
  SELECT AsOfDate, OfficerId, AccountId, Branch, DaysOverdue, RiskBand, PriorityScore, ContactChannel, VisitAction,
         SuggestedNegotiation, SuggestedScript, EscalationFlag,
         row_number() OVER (PARTITION BY OfficerId ORDER BY PriorityScore DESC, tie DESC, AccountId) AS DailyVisitRank,
         cast(NULL AS varchar) AS Outcome, cast(NULL AS varchar) AS PromiseStatus,
         cast(NULL AS varchar) AS SupervisorEscalation, cast(NULL AS varchar) AS FieldNotes
  FROM plan0
)"""

# the same plan from model probabilities and bands
PLAN_MODEL = (
    PLAN.replace(f"coalesce(RuleRiskCategory, 'nan') AS RiskBand,\n         {clip('cast(RuleScore AS double) / mx')} AS RiskCore",
                 f"coalesce(ModelRiskCategory, 'nan') AS RiskBand, {clip('PredDefaultProbability')} AS RiskCore")
    .replace(f"FROM std CROSS JOIN (SELECT greatest(coalesce(max(cast(RuleScore AS double)), {_f(1.0)}), {_f(1.0)}) AS mx FROM std)", "FROM std_model")
    .replace("RuleScore AS tie", "PredDefaultProbability AS tie")
)

NEWTON_STEPS = 12


def model_ctes(numeric: list[str], categorical: list[str]) -> list[str]:
    """Fit and score the default model in SQL: imputation, scaling and one-hot
    columns as one vector a row, then Newton steps of the balanced, penalised logistic
    regression. Each step solves its normal equations by Gauss-Jordan elimination, one pivot a recursion."""
    both = ", ".join([f"median({c}) AS md_{c}" for c in numeric] + [
        f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS mo_{c}"
        for c in categorical])
    fill = {c: f"coalesce(cast({c} AS double), md_{c})" for c in numeric}
    means = ", ".join(f"avg({fill[c]}) AS mu_{c}" for c in numeric)
    spread = ", ".join(f"sqrt(avg(({fill[c]} - mu_{c}) * ({fill[c]} - mu_{c}))) AS sd_{c}" for c in numeric)
    levels = ", ".join(f"list_sort(list(DISTINCT coalesce({c}, mo_{c}))) AS lv_{c}" for c in categorical)
    scaled = ", ".join(f"({fill[c]} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END" for c in numeric)
    vector = f"[{scaled}]"
    for c in categorical:
        vector = f"list_concat({vector}, list_transform(lv_{c}, lambda l: CASE WHEN coalesce({c}, mo_{c}) = l THEN {_f(1.0)} ELSE {_f(0.0)} END))"
    vector = f"list_append({vector}, {_f(1.0)})"
    out = [
        "train AS MATERIALIZED (SELECT * FROM split_frame WHERE split = 'train')",
        "held AS (SELECT * FROM split_frame WHERE split = 'test')",
        f"filled AS MATERIALIZED (SELECT {both} FROM train)",
        f"mean AS MATERIALIZED (SELECT {means} FROM train, filled)",
        f"fitted AS MATERIALIZED (SELECT * FROM filled, mean, (SELECT {spread} FROM train, filled, mean), (SELECT {levels} FROM train, filled))",
        "share AS MATERIALIZED (SELECT WillDefault AS c, (SELECT count(*) FROM train) / (cast(2 AS double) * count(*)) AS s FROM train GROUP BY 1)",
        f"x AS MATERIALIZED (SELECT {vector} AS v, cast(WillDefault AS double) AS y, s FROM train JOIN share ON WillDefault = c, fitted)",
        f"b0 AS MATERIALIZED (SELECT list_transform(v, lambda a: {_f(0.0)}) AS b, len(v) AS k FROM (SELECT v FROM x LIMIT 1))",
    ]
    for t in range(1, NEWTON_STEPS + 1):
        out += [
            f"p{t} AS MATERIALIZED (SELECT v, y, s, 1 / (1 + exp(-list_dot_product(v, b))) AS p FROM x, b{t - 1})",
            f"h{t} AS (SELECT i, list(h ORDER BY j) AS r FROM (SELECT i, j, sum(s * p * (1 - p) * v[i] * v[j]) + "
            f"CASE WHEN i = j AND i < any_value(k) THEN 1 ELSE 0 END AS h FROM p{t}, b{t - 1}, (SELECT unnest(range(1, k + 1)) AS i FROM b0), "
            f"(SELECT unnest(range(1, k + 1)) AS j FROM b0) GROUP BY i, j) GROUP BY i)",
            f"g{t} AS (SELECT i, sum(s * (p - y) * v[i]) + CASE WHEN i < any_value(k) THEN any_value(b)[i] ELSE 0 END AS g "
            f"FROM p{t}, b{t - 1}, (SELECT unnest(range(1, k + 1)) AS i FROM b0) GROUP BY i)",
            f"m{t} AS MATERIALIZED (SELECT list(list_append(r, g) ORDER BY i) AS m FROM h{t} JOIN g{t} USING (i))",
            f"e{t} AS (SELECT 1 AS q, m FROM m{t} UNION ALL SELECT q + 1, list_transform(m, lambda r, i: CASE WHEN i = q THEN "
            f"list_transform(r, lambda a: a / m[q][q]) ELSE list_transform(r, lambda a, j: a - r[q] / m[q][q] * m[q][j]) END) FROM e{t} WHERE q <= len(m))",
            f"b{t} AS MATERIALIZED (SELECT list_transform(b, lambda a, i: a - m[i][k + 1]) AS b, k FROM b{t - 1}, (SELECT m FROM e{t} ORDER BY q DESC LIMIT 1))",
        ]
    probability = round_even(f"1 / (1 + exp(-list_dot_product({vector}, b)))", 6)
    out += [
        f"held_scored AS (SELECT {probability} AS p, WillDefault AS y FROM held, fitted, b{NEWTON_STEPS})",
        f"std_p AS (SELECT std.*, {probability} AS PredDefaultProbability FROM std, fitted, b{NEWTON_STEPS})",
        f"std_model AS (SELECT *, CASE WHEN PredDefaultProbability <= 0.4 THEN {q(LOW)} WHEN PredDefaultProbability <= 0.7 THEN {q(MEDIUM)} "
        f"ELSE {q(HIGH)} END AS ModelRiskCategory FROM std_p)",
    ]
    return out


FEEDBACK = """
fb AS (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS RecordedAt, props AS FieldNotes,
         concat('ACC_', cast(event_id * 7 % (SELECT max(o_orderkey) FROM orders) AS varchar(20))) AS AccountId,
         CASE event_type WHEN 'purchase' THEN 'Paid' WHEN 'view' THEN ' Resolved ' WHEN 'error' THEN 'No Contact'
              WHEN 'click' THEN 'Promise to Pay' ELSE '' END AS Outcome,
         CASE WHEN event_id % 9 = 0 THEN 'BROKEN' WHEN event_id % 9 = 1 THEN 'Kept' ELSE 'None' END AS PromiseStatus,
         CASE WHEN event_id % 13 = 0 THEN 'Yes' WHEN event_id % 13 = 1 THEN NULL ELSE 'No' END AS SupervisorEscalation,
         CASE WHEN event_id % 10 = 3 THEN 'n/a' ELSE cast(event_id % 1000 AS varchar(10)) END AS PromisedAmount,
         concat('officer_', cast(user_id % 6 AS varchar(4))) AS RecordedBy
  FROM events
)"""

TS_FORMATS = "['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']"

LATEST = f"""
lf AS (
  SELECT AccountId, Outcome, PromiseStatus, SupervisorEscalation, FieldNotes, RecordedAt FROM (
    SELECT *, row_number() OVER (PARTITION BY AccountId
                                 ORDER BY (p_ts IS NOT NULL) DESC, p_ts DESC, event_id DESC) AS rn
    FROM (SELECT *, try_strptime({strip('RecordedAt')}, {TS_FORMATS}) AS p_ts FROM fb))
  WHERE rn = 1
)"""

PLAN_FB = f"""
merged AS (
  SELECT p.* REPLACE (
           {clip(f"PriorityScore + CASE WHEN lower(coalesce(lf.SupervisorEscalation, 'No')) = 'yes' THEN {_f(0.2)} ELSE {_f(0.0)} END + CASE WHEN lower(coalesce(lf.PromiseStatus, '')) = 'broken' THEN {_f(0.15)} ELSE {_f(0.0)} END - CASE WHEN lower(coalesce(lf.Outcome, '')) IN ('paid', 'resolved', 'regularized') THEN {_f(0.3)} ELSE {_f(0.0)} END")} AS PriorityScore),
         coalesce(lf.Outcome, '') AS Outcome, coalesce(lf.PromiseStatus, '') AS PromiseStatus,
         coalesce(lf.SupervisorEscalation, 'No') AS SupervisorEscalation, lf.FieldNotes AS FieldNotes
  FROM plan0 p LEFT JOIN lf ON p.AccountId = lf.AccountId
  WHERE lower(coalesce(lf.Outcome, '')) NOT IN ('paid', 'resolved', 'regularized')
),
plan_fb AS (
  SELECT AsOfDate, OfficerId, AccountId, Branch, DaysOverdue, RiskBand, PriorityScore, ContactChannel, VisitAction,
         SuggestedNegotiation, SuggestedScript, EscalationFlag,
         row_number() OVER (PARTITION BY OfficerId ORDER BY PriorityScore DESC, tie DESC, AccountId) AS DailyVisitRank,
         Outcome, PromiseStatus, SupervisorEscalation, FieldNotes
  FROM merged
)"""


def kpis(plan: str) -> str:
    avg = "avg(cast(DaysOverdue AS double))"
    pct = clip(f"{_f(1.0)} - {avg} / {_f(60.0)}")
    return f"""
SELECT OfficerId,
       count(AccountId) AS AssignedCases,
       cast(sum(CASE WHEN RiskBand = {q(HIGH)} THEN 1 ELSE 0 END) AS bigint) AS HighRiskCases,
       {round_even(avg, 2)} AS AverageDaysOverdue,
       {round_even("avg(CASE WHEN coalesce(contains(lower(SuggestedNegotiation), 'reschedul'), false) THEN 1.0 ELSE 0.0 END)", 3)}
         AS RescheduleCandidateRate,
       cast(sum(CASE WHEN EscalationFlag = 'Yes' THEN 1 ELSE 0 END) AS bigint) AS EscalationCount,
       {round_even(pct, 3)} AS PctCurrent,
       CASE WHEN {pct} < 0.7 THEN {q(TIP_EARLY)}
            WHEN {avg} > 20 THEN {q(TIP_COMMIT)}
            WHEN sum(CASE WHEN EscalationFlag = 'Yes' THEN 1 ELSE 0 END) > 5 THEN {q(TIP_REVIEW)}
            ELSE {q(TIP_STABLE)} END AS CoachingTip
FROM {plan} GROUP BY OfficerId ORDER BY OfficerId"""


# -- portfolio frame over the regular accounts --------------------------------
PF = """
pf AS (
  SELECT * REPLACE (coalesce(cast(PrincipalOS AS double), cast(0 AS double)) AS PrincipalOS,
                    coalesce(cast(SecurityValue AS double), cast(0 AS double)) AS SecurityValue),
         coalesce(cast(PrincipalOS AS double) / CASE WHEN DisbAmount <> 0 THEN DisbAmount END * cast(100 AS double),
                  cast(0 AS double)) AS OutstandingPct
  FROM std
)"""

TOP_COLS = "AccountNo, AccountName, Branch, Sector, PrincipalOS, SecurityValue, OutstandingPct, RuleRiskCategory"


def label(c: str) -> str:
    s = strip(f"coalesce(cast({c} AS varchar), 'Unknown')")
    return f"CASE WHEN {s} = '' THEN 'Unknown' ELSE {s} END"


def breakdown(g: str, limit: int = 10) -> str:
    return f"""
SELECT *, coalesce(NonLowRisk / CASE WHEN TotalAccounts <> 0 THEN TotalAccounts END * cast(100 AS double),
                   cast(0 AS double)) AS NonLowRiskPct
FROM (
  SELECT *, "High Risk" + "Medium Risk" + "Low Risk" AS TotalAccounts, "High Risk" + "Medium Risk" AS NonLowRisk
  FROM (
    SELECT {label(g)} AS {g},
           cast(sum(CASE WHEN coalesce(RuleRiskCategory, 'Unknown') = {q(HIGH)} THEN 1 ELSE 0 END) AS bigint) AS "High Risk",
           cast(sum(CASE WHEN coalesce(RuleRiskCategory, 'Unknown') = {q(MEDIUM)} THEN 1 ELSE 0 END) AS bigint) AS "Medium Risk",
           cast(sum(CASE WHEN coalesce(RuleRiskCategory, 'Unknown') = {q(LOW)} THEN 1 ELSE 0 END) AS bigint) AS "Low Risk"
    FROM pf GROUP BY 1))
ORDER BY NonLowRisk DESC, TotalAccounts DESC, {g} LIMIT {limit}"""


# -- feedback log views --------------------------------------------------------
FB_ALIGNED = f"""
fba AS (
  SELECT '' AS AsOfDate, '' AS OfficerId, AccountId, '' AS VisitStatus, Outcome, PromiseStatus,
         '' AS PromiseToPayDate, try_cast({strip('PromisedAmount')} AS double) AS PromisedAmount,
         '' AS ClientHardshipFlag, '' AS DisputeFlag, SupervisorEscalation, '' AS NextAction, FieldNotes, RecordedBy,
         RecordedAt
  FROM fb
)"""


def _blank_default(c: str, d: str) -> str:
    s = strip(c)
    return f"coalesce(CASE WHEN {s} = '' THEN NULL ELSE {s} END, {q(d)})"


FB_CANON = f"""
fbc AS (
  SELECT '2024-01-31' AS AsOfDate, '' AS OfficerId, {strip("coalesce(AccountId, '')")} AS AccountId,
         'Completed' AS VisitStatus, {_blank_default('Outcome', 'Contacted')} AS Outcome,
         {_blank_default('PromiseStatus', 'None')} AS PromiseStatus, '' AS PromiseToPayDate,
         coalesce(try_cast({strip('PromisedAmount')} AS double), cast(0 AS double)) AS PromisedAmount,
         'No' AS ClientHardshipFlag, 'No' AS DisputeFlag,
         {_blank_default('SupervisorEscalation', 'No')} AS SupervisorEscalation, 'Follow-up Call' AS NextAction,
         {strip("coalesce(FieldNotes, '')")} AS FieldNotes, {_blank_default('RecordedBy', 'system')} AS RecordedBy,
         {_blank_default('RecordedAt', '2024-01-31T00:00:00Z')} AS RecordedAt
  FROM fb
)"""


# -- job log -------------------------------------------------------------------
JOB = """
job AS (
  SELECT concat('job_', cast(event_id AS varchar(20))) AS job_id,
         concat('type_', cast(user_id % 7 AS varchar(4))) AS job_type,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'succeeded'
              WHEN 'error' THEN 'dead_letter' ELSE 'canceled' END AS status,
         props AS payload_json, cast(NULL AS varchar) AS result_json,
         CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 4 = 0 THEN 'timeout'
              WHEN event_id % 4 = 1 THEN 'validation' WHEN event_id % 4 = 2 THEN '  ' END AS error,
         cast(event_id % 4 AS int) AS attempts, 3 AS max_attempts, cast(60 AS double) AS timeout_seconds,
         CASE WHEN event_type = 'signup' AND event_id % 3 > 0 THEN ts + INTERVAL 2 MINUTE END AS next_attempt_at,
         ts AS created_at, ts + INTERVAL 1 MINUTE AS updated_at
  FROM events
)"""

JOB_COLS = "job_id, job_type, status, result_json, error, created_at, updated_at, attempts, max_attempts, timeout_seconds"


def ts(text: str) -> str:
    return f"timestamp '{text}'"


def secs(start: str, end: str) -> str:
    return f"(cast(epoch_us({end}) - epoch_us({start}) AS double) / cast(1000000 AS double))"


def cnt(cond: str) -> str:
    return f"cast(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS bigint)"


# -- alert signals and gates ----------------------------------------------------
def signals_sql(presets, as_of: str, shift) -> list[str]:
    windows = sorted({max(1.0, float(p[2])) for p in presets})
    a = ts(as_of)
    dead = "status = 'dead_letter'"
    recent_cols = ", ".join(
        f"{cnt(f'{dead} AND updated_at >= {ts(shift(as_of, -w))}')} AS r_{int(w)}" for w in windows
    )
    values = ", ".join(f"({q(p)}, {_f(float(x))}, {_f(float(w))}, {_f(float(t))})" for p, x, w, t in presets)
    pick = " ".join(f"WHEN greatest(dead_letter_window_seconds, {_f(1.0)}) = {_f(w)} THEN r_{int(w)}" for w in windows)
    g = f"""
g AS (
  SELECT job_type, {cnt("status = 'queued'")} AS queued, {cnt("status = 'running'")} AS running,
         min(CASE WHEN status = 'queued' THEN created_at END) AS oldest_queued_at,
         {cnt(dead)} AS total_dead_letter, {recent_cols}
  FROM job GROUP BY job_type
)"""
    sig0 = f"""
sig0 AS (
  SELECT g.*, p.*, true AS worker_alive, false AS paused, false AS worker_breached,
         CASE WHEN oldest_queued_at IS NOT NULL THEN greatest({secs('oldest_queued_at', a)}, {_f(0.0)}) END
           AS oldest_queued_age_seconds,
         CASE {pick} END AS recent_dead_letter
  FROM g CROSS JOIN (VALUES {values}) p(policy, queue_age_threshold_seconds, dead_letter_window_seconds,
                                        dead_letter_threshold_per_minute)
)"""
    sig1 = f"""
sig1 AS (
  SELECT *, coalesce(oldest_queued_age_seconds >= greatest(queue_age_threshold_seconds, {_f(0.0)}), false) AS queue_age_breached,
         recent_dead_letter / (greatest(dead_letter_window_seconds, {_f(1.0)}) / {_f(60.0)}) AS dead_letter_rate_per_minute
  FROM sig0
)"""
    sig = f"""
sig AS (
  SELECT *, CASE WHEN worker_breached OR dead_letter_rate_breached THEN 'critical'
                 WHEN queue_age_breached THEN 'warning' ELSE 'ok' END AS severity,
         (worker_breached OR dead_letter_rate_breached OR queue_age_breached) AS breached,
         cast(worker_breached AS int) + cast(queue_age_breached AS int) + cast(dead_letter_rate_breached AS int) AS failing_count
  FROM (SELECT *, dead_letter_rate_per_minute >= greatest(dead_letter_threshold_per_minute, {_f(0.0)}) AS dead_letter_rate_breached
        FROM sig1)
)"""
    return [g, sig0, sig1, sig]


def signal_rows(recs: dict, prios: dict) -> str:
    parts = []
    for pos, (name, status, flag) in enumerate(
        [("worker", "critical", "worker_breached"), ("queue_age", "warning", "queue_age_breached"),
         ("dead_letter_rate", "critical", "dead_letter_rate_breached")]
    ):
        parts.append(
            f"SELECT job_type, policy, severity, breached, failing_count, {pos} AS pos0, {q(name)} AS signal, "
            f"CASE WHEN {flag} THEN {q(status)} ELSE 'ok' END AS signal_status, {flag} AS b, {prios[name]} AS priority, "
            f"{q(recs[name])} AS recommendation FROM sig"
        )
    return "\nsl AS (" + "\nUNION ALL\n".join(parts) + "\n)"


# -- request log and applicants ----------------------------------------------------
REQUEST = """
req AS (
  SELECT event_id, concat('/api/', event_type) AS route, concat('client_', cast(user_id AS varchar(10))) AS client_key, ts,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 503 ELSE 404 END
              WHEN event_id % 20 = 0 THEN 302 ELSE 200 END AS status_code,
         value * cast(10 AS double) AS duration_ms
  FROM events
)"""

APPLICANT = """
app AS (
  SELECT c_custkey AS applicant_id, cast(c_custkey % 31 AS int) AS rechargeFrequency,
         cast(c_custkey * 7 % 101 AS int) AS mobileMoney, cast(c_custkey * 13 % 101 AS int) AS geoConsistency,
         CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'mid' ELSE 'established' END AS deviceTenure,
         CASE c_custkey % 4 WHEN 0 THEN 'variable' WHEN 1 THEN 'salary' WHEN 2 THEN 'merchant' ELSE 'salary' END AS employmentType,
         CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'strong' END AS utilityHistory,
         cast(5000 + c_custkey * 37 % 45000 AS double) AS requestedLoan
  FROM customer
)"""


# -- the loan view with missing cells (median / Unknown fills) -----------------
LOAN_GAPS = LOAN + """,
loan_gaps AS (
  SELECT * REPLACE (
    CASE WHEN cast(regexp_extract(AccountNo, '(\\d+)$', 1) AS bigint) % 7 = 0 THEN NULL ELSE AgeDays END AS AgeDays,
    CASE WHEN CustomerID % 11 = 0 THEN NULL ELSE PrincipalOS END AS PrincipalOS,
    CASE WHEN cast(regexp_extract(AccountNo, '(\\d+)$', 1) AS bigint) % 13 = 0 THEN NULL ELSE Sector END AS Sector,
    CASE WHEN cast(regexp_extract(AccountNo, '(\\d+)$', 1) AS bigint) % 17 = 3 THEN NULL ELSE RepaymentFrequency END
      AS RepaymentFrequency)
  FROM loan
)"""
CLEAN_GAPS = CLEAN.replace("SELECT DISTINCT * FROM loan)", "SELECT DISTINCT * FROM loan_gaps)")

LOAN_COPIES = LOAN_GAPS + """,
loan_copies AS (
  SELECT * FROM loan_gaps
  UNION ALL SELECT * FROM loan_gaps WHERE cast(regexp_extract(AccountNo, '([0-9]+)$', 1) AS bigint) % 9 = 0
  UNION ALL SELECT * FROM loan_gaps WHERE cast(regexp_extract(AccountNo, '([0-9]+)$', 1) AS bigint) % 27 = 0
)"""
CLEAN_COPIES = CLEAN.replace("SELECT DISTINCT * FROM loan)", "SELECT DISTINCT * FROM loan_copies)")
