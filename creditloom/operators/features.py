"""Delinquency, arrears, collateral and sector features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import join_small, literal_map, norm_code, safe_divide
from ..schema import DEFAULT_STATUSES, STATUS_CODES


def _text(c):
    """Value as text the way a string cast renders a missing cell."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def sector_share(df: DataFrame, sector_col: str = "Sector") -> DataFrame:
    """(Sector, Accounts, Share) with Share = accounts / all accounts.

    Aggregated with map-side combining, so a sector holding a third of the
    rows costs no more than any other; the total is a scalar subquery over
    the (sector-sized) result.
    """
    counts = df.groupBy(sector_col).agg(F.count(F.lit(1)).alias("Accounts"))
    total = counts.agg(F.sum("Accounts")).scalar()
    return counts.select(sector_col, "Accounts", (F.col("Accounts") / total).alias("Share"))


# Most sectors whose shares travel as one map (a lookup compares its keys one by one).
FEW_SECTORS = 1024


def share_map(df: DataFrame, most: int = FEW_SECTORS) -> Column:
    """{Sector: Share} as one scalar, read when the query runs and left out by the
    optimizer where nothing needs it. More than ``most`` sectors are an error:
    no more than ``most + 1`` rows are ever brought together."""
    counts = df.groupBy("Sector").agg(F.count(F.lit(1)).alias("Accounts")).limit(most + 1)
    many = F.when(F.count(F.lit(1)) > most, F.raise_error(F.lit(f"more than {most} sectors: call engineer(few_sectors=False)")))
    found = counts.agg(many.alias("many"), F.sum("Accounts").alias("total"), F.collect_list(F.struct("Sector", "Accounts")).alias("e"))
    shares = F.transform(F.col("e"), lambda x: F.struct(x["Sector"].alias("Sector"), (x["Accounts"] / F.col("total")).alias("Share")))
    return found.select(F.when(F.col("many").isNull(), F.map_from_entries(shares)).alias("m")).scalar()


def engineer(df: DataFrame, few_sectors: bool = False) -> DataFrame:
    """Add the derived feature columns of a cleaned loan table.

    The sector shares come back to the rows without a shuffle of the loan
    table on the low-cardinality, skewed sector key. By default they are a
    table of one row per sector, broadcast after a row-count check (a shuffle
    join beyond the limit); the check reads the book while the plan is built.
    ``few_sectors`` declares at most 1,024 sectors: then the shares are one
    map, and nothing is read before the query itself (see ``share_map``).
    """
    out = df.withColumn("CLStatusCode", norm_code(_text("CLStatusCode")))
    out = out.withColumn(
        "CLStatusNumeric",
        F.coalesce(literal_map(STATUS_CODES)[F.col("CLStatusCode")], F.lit(-1)).cast("int"),
    )
    out = out.withColumn("ArrearRatio", safe_divide(F.col("PrincipalArrear") + F.col("InterestArrear"), "PrincipalOS"))
    out = out.withColumn("LTVRatio", safe_divide("PrincipalOS", "SecurityValue"))
    out = out.withColumn("InterestStress", safe_divide("InterestArrear", "TotalAccruedInt"))
    if "TotalInstallments" in df.columns:
        out = out.withColumn("DefaultedInstRatio", safe_divide("DefaultedInst", "TotalInstallments"))
    else:
        out = out.withColumn("DefaultedInstRatio", F.col("DefaultedInst").cast("double"))

    age = F.col("AgeDays")
    out = out.withColumn(
        "AgeDaysBucket",
        F.when(age <= 30, "Low").when(age <= 90, "Medium").when(age.isNotNull(), "High"),
    )
    out = out.withColumn(
        "DelinquencyScore", F.when(age > 180, 3).when(age > 90, 2).when(age > 30, 1).otherwise(0).cast("int")
    )
    di = F.col("DefaultedInst")
    out = out.withColumn(
        "InstallmentRisk", F.when(di > 5, 3).when(di > 2, 2).when(di > 0, 1).otherwise(0).cast("int")
    )
    freq = _text("RepaymentFrequency") if "RepaymentFrequency" in df.columns else F.lit("Unknown")
    out = out.withColumn("RepaymentFrequency", norm_code(freq))
    out = out.withColumn(
        "PaymentFrequencyRiskFlag",
        F.col("RepaymentFrequency").isin("QUARTERLY", "HALF YEARLY").cast("int"),
    )
    out = out.withColumn("Sector", norm_code(_text("Sector")))
    if few_sectors:
        out = out.withColumn("_share", share_map(out)[F.col("Sector")])
    else:
        shares = sector_share(out).select(F.col("Sector").alias("_sec"), F.col("Share").alias("_share"))
        out = join_small(out, shares, out["Sector"].eqNullSafe(shares["_sec"]), "left")
    out = out.withColumn(
        "SectorRiskScore", F.coalesce(F.lit(1.0) - F.col("_share"), F.lit(0.5))
    ).drop("_sec", "_share")
    status_for_label = "FutureStatusCode" if "FutureStatusCode" in df.columns else "CLStatusCode"
    out = out.withColumn(
        "WillDefault", norm_code(_text(status_for_label)).isin(*DEFAULT_STATUSES).cast("int")
    )
    return out
