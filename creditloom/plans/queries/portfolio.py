"""Queries: portfolio filters, search, top-k, distributions, breakdowns."""

from __future__ import annotations

from .. import oracle as O
from ...operators import portfolio as pf
from ...schema import BANDS, HIGH, LOW, MEDIUM
from .common import register, std_scored


PF_CHAIN = O.LOAN_CHAIN + [O.PF]


TOP_COLS = ["AccountNo", "AccountName", "Branch", "Sector", "PrincipalOS", "SecurityValue", "OutstandingPct",
            "RuleRiskCategory"]


def pframe(spark, d):
    return pf.portfolio_frame(std_scored(spark, d))


@register(
    "prepared_table",
    O.with_ctes(
        PF_CHAIN,
        "SELECT AccountNo, AccountName, Branch, Sector, PrincipalOS, RuleScore, RuleRiskCategory FROM pf "
        "ORDER BY RuleScore DESC, AccountNo LIMIT 100",
    ),
)
def q_prepared_table(spark, d):
    view = pf.View(("AccountNo", "AccountName", "Branch", "Sector", "PrincipalOS", "RuleScore", "RuleRiskCategory"),
                   order=("PredDefaultProbability", "RuleScore"), ties=("AccountNo",), rows=100)
    return view.of(pframe(spark, d))


@register(
    "exact_filter",
    O.with_ctes(
        PF_CHAIN,
        f"SELECT {O.TOP_COLS} FROM pf WHERE lower({O.strip('Branch')}) = 'nation_15' "
        "AND lower(" + O.strip("RuleRiskCategory") + ") = 'high risk'",
    ),
)
def q_exact_filter(spark, d):
    f = pf.exact_filter(pframe(spark, d), ["BrCode", "Branch"], "  Nation_15 ")
    return pf.exact_filter(f, ["ModelRiskCategory", "RuleRiskCategory"], "High Risk").select(*TOP_COLS)


SEARCH_SQL = " OR ".join(
    f"regexp_matches(lower(cast({c} AS varchar)), 'acc_12[0-9]?$')" for c in ["AccountNo", "CustomerID", "AccountName"]
)


@register("text_search", O.with_ctes(PF_CHAIN, f"SELECT {O.TOP_COLS} FROM pf WHERE {SEARCH_SQL}"))
def q_text_search(spark, d):
    return pf.text_search(pframe(spark, d), " ACC_12[0-9]?$ ").select(*TOP_COLS)


@register(
    "risk_distribution",
    O.with_ctes(
        PF_CHAIN,
        f"SELECT RiskBand, Accounts, Accounts / greatest(sum(Accounts) OVER (), 1) * cast(100 AS double) AS SharePct "
        f"FROM (SELECT {O.label('RuleRiskCategory')} AS RiskBand, count(*) AS Accounts FROM pf GROUP BY 1)",
    ),
)
def q_risk_distribution(spark, d):
    return pf.risk_distribution(pframe(spark, d), "RuleRiskCategory")


register("branch_risk", O.with_ctes(PF_CHAIN, O.breakdown("Branch")))(
    lambda spark, d: pf.group_risk_breakdown(pframe(spark, d), "Branch", "RuleRiskCategory", 10)
)


register("sector_risk", O.with_ctes(PF_CHAIN, O.breakdown("Sector")))(
    lambda spark, d: pf.group_risk_breakdown(pframe(spark, d), "Sector", "RuleRiskCategory", 10)
)


@register(
    "stacked_risk",
    O.with_ctes(
        PF_CHAIN,
        "SELECT Branch, "
        + ", ".join(
            f"cast(sum(CASE WHEN RuleRiskCategory = {O.q(b)} THEN 1 ELSE 0 END) AS bigint) AS \"{b}\"" for b in BANDS
        )
        + ", count(*) AS Total FROM pf GROUP BY Branch ORDER BY Total DESC, Branch LIMIT 5",
    ),
)
def q_stacked_risk(spark, d):
    return pf.stacked_risk(pframe(spark, d), "Branch", "RuleRiskCategory", 5)


@register(
    "ranking_ratio",
    O.with_ctes(
        PF_CHAIN,
        "SELECT AccountNo, PrincipalOS, CASE WHEN max(PrincipalOS) OVER () = 0 THEN cast(0 AS double) "
        "ELSE PrincipalOS / max(PrincipalOS) OVER () END AS Ratio "
        "FROM (SELECT AccountNo, PrincipalOS FROM pf ORDER BY PrincipalOS DESC, AccountNo LIMIT 10)",
    ),
)
def q_ranking_ratio(spark, d):
    return pf.ranking_ratio(pframe(spark, d), "AccountNo", "PrincipalOS", 10)


RISK_TEXT = O.strip("coalesce(RuleRiskCategory, 'Unknown')")


@register(
    "band_counts",
    O.with_ctes(
        PF_CHAIN,
        "SELECT "
        + ", ".join(
            f"cast(sum(CASE WHEN {RISK_TEXT} {op} {O.q(b)} THEN 1 ELSE 0 END) AS bigint) AS {n}"
            for n, op, b in [
                ("LowRiskAccounts", "=", LOW),
                ("MediumRiskAccounts", "=", MEDIUM),
                ("HighRiskAccounts", "=", HIGH),
                ("NonStandardAccounts", "<>", LOW),
            ]
        )
        + ", count(*) AS SyncedAccounts FROM pf",
    ),
)
def q_band_counts(spark, d):
    return pf.band_counts(pframe(spark, d), "RuleRiskCategory")


@register(
    "unique_branches",
    O.with_ctes(
        PF_CHAIN,
        f"SELECT DISTINCT {O.strip('cast(Branch AS varchar)')} AS value FROM pf "
        f"WHERE Branch IS NOT NULL AND {O.strip('cast(Branch AS varchar)')} <> '' ORDER BY value",
    ),
)
def q_unique_branches(spark, d):
    return pf.options(pframe(spark, d), ["BrCode", "Branch"])


for _name, _col, _asc in [("top_outstanding", "PrincipalOS", False), ("low_outstanding_pct", "OutstandingPct", True),
                          ("low_security", "SecurityValue", True)]:
    register(
        _name,
        O.with_ctes(PF_CHAIN, f"SELECT {O.TOP_COLS} FROM pf ORDER BY {_col} {'ASC' if _asc else 'DESC'}, AccountNo LIMIT 10"),
    )(lambda spark, d, _c=_col, _a=_asc: pf.top_n(pframe(spark, d), _c, 10, _a, "AccountNo", TOP_COLS))
