"""Queries: loan ingest, cleaning, features, rule score, top list."""

from __future__ import annotations

from .. import oracle as O
from ...operators.features import engineer, sector_share
from ...operators.quality import clean
from ...operators.scoring import rule_score, top_by
from ...sources import views as V
from .common import cleaned, featured, register, scored, std_scored


register("scan_clean", O.with_ctes([O.LOAN, O.CLEAN], "SELECT * FROM clean"))(cleaned)
register("features", O.with_ctes([O.LOAN, O.CLEAN, O.FEATURES], "SELECT * FROM features"))(featured)
register("rule_score", O.with_ctes(O.LOAN_CHAIN, "SELECT * FROM scored"))(scored)
register("std_accounts", O.with_ctes(O.LOAN_CHAIN, "SELECT * FROM std"))(std_scored)


@register(
    "sector_share",
    O.with_ctes(
        [O.LOAN, O.CLEAN, O.FEATURES],
        "SELECT Sector, count(*) AS Accounts, cast(count(*) AS double) / cast(sum(count(*)) OVER () AS double) AS Share "
        "FROM f0 GROUP BY Sector",
    ),
)
def q_sector_share(spark, d):
    return sector_share(featured(spark, d))


@register(
    "top_risky_rule",
    O.with_ctes(O.LOAN_CHAIN, "SELECT * FROM std ORDER BY RuleScore DESC, AccountNo LIMIT 100"),
)
def q_top_risky_rule(spark, d):
    return top_by(std_scored(spark, d), "RuleScore", 100)


register("scan_clean_gaps", O.with_ctes([O.LOAN_GAPS, O.CLEAN_GAPS], "SELECT * FROM clean"))(
    lambda spark, d: clean(V.loan_view_with_gaps(spark, d))
)


register("scan_clean_copies", O.with_ctes([O.LOAN_COPIES, O.CLEAN_COPIES], "SELECT * FROM clean"))(
    lambda spark, d: clean(V.loan_view_with_copies(spark, d))
)


register(
    "rule_score_gaps",
    O.with_ctes([O.LOAN_GAPS, O.CLEAN_GAPS, O.FEATURES, O.SCORED.split(",\nstd AS")[0]],
                "SELECT AccountNo, AgeDays, PrincipalOS, Sector, RepaymentFrequency, ArrearRatio, LTVRatio, "
                "DelinquencyScore, SectorRiskScore, RuleScore, RuleRiskCategory FROM scored"),
)(lambda spark, d: rule_score(engineer(clean(V.loan_view_with_gaps(spark, d)))).select(
    "AccountNo", "AgeDays", "PrincipalOS", "Sector", "RepaymentFrequency", "ArrearRatio", "LTVRatio",
    "DelinquencyScore", "SectorRiskScore", "RuleScore", "RuleRiskCategory"))
