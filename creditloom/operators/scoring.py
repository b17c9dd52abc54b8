"""Rule score, risk category, regular-account filter and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_existing
from ..schema import HIGH, ID_CANDIDATES, LOW, MEDIUM


def rule_score(df: DataFrame) -> DataFrame:
    score = (
        F.col("DelinquencyScore") * 30
        + F.col("InstallmentRisk") * 25
        + F.when(F.col("LTVRatio") > 0.8, 20).otherwise(10)
        + F.when(F.col("ArrearRatio") > 0.3, 25).otherwise(10)
    ).cast("int")
    out = df.withColumn("RuleScore", score)
    return out.withColumn(
        "RuleRiskCategory",
        F.when(F.col("RuleScore") >= 70, HIGH).when(F.col("RuleScore") >= 40, MEDIUM).otherwise(LOW),
    )


def regular_accounts(df: DataFrame) -> DataFrame:
    """Accounts whose (upper-cased) status is STD."""
    return df.filter(F.upper(F.col("CLStatusCode")) == "STD")


def id_column(df: DataFrame) -> str:
    c = first_existing(df.columns, ID_CANDIDATES)
    if c is None:
        raise ValueError("No account id column; assign one at ingest (see assign_account_ids).")
    return c


def top_by(df: DataFrame, score_col: str, n: int = 100, ascending: bool = False, tie_cols: list[str] | None = None) -> DataFrame:
    """Top ``n`` rows by ``score_col`` with a deterministic tie-break.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own best ``n`` and only those reach the final merge.
    """
    key = F.col(score_col).asc_nulls_last() if ascending else F.col(score_col).desc_nulls_last()
    ties = [F.col(c).asc() for c in (tie_cols or [id_column(df)])]
    return df.orderBy(key, *ties).limit(n)


def top_risky_rule(scored: DataFrame, n: int = 100) -> DataFrame:
    return top_by(regular_accounts(scored), "RuleScore", n)
