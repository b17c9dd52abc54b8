"""Domain views over the driver's TPC-H-ish parquet tables.

Each view is a lazy DataFrame; the matching SQL text (used by the DuckDB
oracle) lives in ``creditloom.plans.oracle`` and computes the same cells.
The loan view aggregates ``lineitem`` per order before joining, so the
aggregate's hash partitioning on the order key is reused by the join with
``orders``; ``nation`` is a 25-row dimension.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the evaluation instant every time predicate is relative to.
AS_OF = "2024-01-31 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _hundredths(c: str, precision: int) -> F.Column:
    """A money/rate column rounded to 2 decimals (as DECIMAL(p,2)), as an
    exact integer count of hundredths."""
    return (F.col(c).cast(f"decimal({precision},2)") * F.lit(100)).cast("bigint")


def _or_zero(c: Column, kind: str = "double") -> Column:
    return F.coalesce(c, F.lit(0).cast(kind))


def loan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan book of the given tables. It has no numeric gaps (a missing amount is 0,
    ``loan_view_with_gaps`` has some), and its schema says so: cleaning it reads nothing ahead."""
    # Money is summed exactly in integer hundredths (price) and ten-thousandths
    # (price x rate): 64-bit sums stay on Spark's fast path, unlike DECIMAL
    # sums wider than 18 digits; converting the exact integer with one IEEE
    # division gives the correctly rounded double of the decimal sum.
    price, disc, tax = _hundredths("l_extendedprice", 12), _hundredths("l_discount", 4), _hundredths("l_tax", 4)
    returned = F.col("l_returnflag") == "R"
    li = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.when(returned, 1).otherwise(0)).alias("n_ret"),
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(F.when(returned, price).otherwise(F.lit(0))).alias("p_arr_c"),
            F.sum(price * disc).alias("i_arr_c"),
            F.sum(price * tax).alias("acc_int_c"),
        )
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "O", "STD")
        .when((F.col("o_orderstatus") == "P") & (k % 2 == 0), " std ")
        .when(F.col("o_orderstatus") == "P", "WCH")
        .when(k % 3 == 0, "SUB")
        .when(k % 3 == 1, "DBT")
        .otherwise("LOS")
    )
    future = (
        F.when((F.col("n_ret") >= 3) & (k % 240 > 90), "SUB")
        .when(k % 17 == 0, "LOS")
        .when(k % 5 == 0, "WCH")
        .otherwise("STD")
    )
    freq = (
        F.when(F.col("o_orderpriority") == "2-HIGH", "Quarterly")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Half Yearly")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Yearly")
        .otherwise("Monthly")
    )
    joined = (
        orders.join(li, orders.o_orderkey == li.l_orderkey, "inner")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
    )
    return joined.select(
        F.concat(F.lit("ACC_"), k.cast("string")).alias("AccountNo"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("c_name").alias("AccountName"),
        F.col("n_name").alias("Branch"),
        F.col("c_mktsegment").alias("Sector"),
        status.alias("CLStatusCode"),
        future.alias("FutureStatusCode"),
        _or_zero((k % 240).cast("int"), "int").alias("AgeDays"),
        _or_zero(F.col("n_ret").cast("int"), "int").alias("DefaultedInst"),
        F.col("n_lines").cast("int").alias("TotalInstallments"),
        _or_zero(F.col("o_totalprice")).alias("PrincipalOS"),
        _or_zero(F.col("p_arr_c").cast("double") / F.lit(100.0)).alias("PrincipalArrear"),
        _or_zero(F.col("i_arr_c").cast("double") / F.lit(10000.0)).alias("InterestArrear"),
        _or_zero(F.col("acc_int_c").cast("double") / F.lit(10000.0)).alias("TotalAccruedInt"),
        _or_zero(F.when(k % 50 == 0, F.lit(0.0))
                 .otherwise(F.col("o_totalprice") * ((F.lit(5) + k % 11).cast("double") / F.lit(10))))
        .alias("SecurityValue"),
        _or_zero(F.when(k % 60 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") * F.lit(1.25))).alias("DisbAmount"),
        freq.alias("RepaymentFrequency"),
    )


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


def feedback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feedback log rows as written by officers (text, partly blank), on accounts of the whole book."""
    last = read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).scalar()
    return feedback_from_events(_events(spark, sf_dir), last)


def feedback_from_events(e: DataFrame, accounts: Column | int = 1500) -> DataFrame:
    """``accounts``: account numbers run below it."""
    i = F.col("event_id")
    outcome = (
        F.when(F.col("event_type") == "purchase", "Paid")
        .when(F.col("event_type") == "view", " Resolved ")
        .when(F.col("event_type") == "error", "No Contact")
        .when(F.col("event_type") == "click", "Promise to Pay")
        .otherwise("")
    )
    return e.select(
        i.alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("RecordedAt"),
        F.col("props").alias("FieldNotes"),
        F.concat(F.lit("ACC_"), (i * 7 % accounts).cast("string")).alias("AccountId"),
        outcome.alias("Outcome"),
        F.when(i % 9 == 0, "BROKEN").when(i % 9 == 1, "Kept").otherwise("None").alias("PromiseStatus"),
        F.when(i % 13 == 0, "Yes").when(i % 13 == 1, F.lit(None)).otherwise("No").alias("SupervisorEscalation"),
        F.when(i % 10 == 3, "n/a").otherwise((i % 1000).cast("string")).alias("PromisedAmount"),
        F.concat(F.lit("officer_"), (F.col("user_id") % 6).cast("string")).alias("RecordedBy"),
    )


def job_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_from_events(_events(spark, sf_dir))


def jobs_from_events(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    et = F.col("event_type")
    status = (
        F.when(et == "signup", "queued")
        .when(et == "click", "running")
        .when(et == "view", "succeeded")
        .when(et == "error", "dead_letter")
        .otherwise("canceled")
    )
    error = (
        F.when(et != "error", F.lit(None))
        .when(i % 4 == 0, "timeout")
        .when(i % 4 == 1, "validation")
        .when(i % 4 == 2, "  ")
    )
    return e.select(
        F.concat(F.lit("job_"), i.cast("string")).alias("job_id"),
        F.concat(F.lit("type_"), (F.col("user_id") % 7).cast("string")).alias("job_type"),
        status.alias("status"),
        F.col("props").alias("payload_json"),
        F.lit(None).cast("string").alias("result_json"),
        error.alias("error"),
        (i % 4).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.lit(60.0).alias("timeout_seconds"),
        F.when((et == "signup") & (i % 3 > 0), F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("next_attempt_at"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 1 MINUTES")).alias("updated_at"),
    )


def request_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(_events(spark, sf_dir))


def requests_from_events(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    code = (
        F.when(F.col("event_type") == "error", F.when(i % 2 == 0, 503).otherwise(404))
        .when(i % 20 == 0, 302)
        .otherwise(200)
    )
    return e.select(
        i.alias("event_id"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("route"),
        F.concat(F.lit("client_"), F.col("user_id").cast("string")).alias("client_key"),
        F.col("ts").alias("ts"),
        code.alias("status_code"),
        (F.col("value") * F.lit(10.0)).alias("duration_ms"),
    )


def applicant_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("applicant_id"),
        (k % 31).cast("int").alias("rechargeFrequency"),
        (k * 7 % 101).cast("int").alias("mobileMoney"),
        (k * 13 % 101).cast("int").alias("geoConsistency"),
        F.when(k % 3 == 0, "new").when(k % 3 == 1, "mid").otherwise("established").alias("deviceTenure"),
        F.when(k % 4 == 0, "variable")
        .when(k % 4 == 1, "salary")
        .when(k % 4 == 2, "merchant")
        .otherwise("salary")
        .alias("employmentType"),
        F.when(k % 5 == 0, "none").when(k % 5 == 1, "partial").otherwise("strong").alias("utilityHistory"),
        (F.lit(5000) + k * 37 % 45000).cast("double").alias("requestedLoan"),
    )


def loan_view_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan view with missing cells, as raw books have: a few numeric and
    text fields are blank by a rule on the keys (exercises the median and
    'Unknown' fills on whole tables)."""
    v = loan_view(spark, sf_dir)
    k = F.regexp_extract(F.col("AccountNo"), r"(\d+)$", 1).cast("bigint")
    return (
        v.withColumn("AgeDays", F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("AgeDays")))
        .withColumn("PrincipalOS", F.when(F.col("CustomerID") % 11 == 0, F.lit(None)).otherwise(F.col("PrincipalOS")))
        .withColumn("Sector", F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("Sector")))
        .withColumn("RepaymentFrequency", F.when(k % 17 == 3, F.lit(None)).otherwise(F.col("RepaymentFrequency")))
    )


def loan_view_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan view with gaps in which every ninth account is entered twice and
    every 27th three times (rows equal in every column)."""
    v = loan_view_with_gaps(spark, sf_dir)
    k = F.regexp_extract(F.col("AccountNo"), r"(\d+)$", 1).cast("bigint")
    times = F.when(k % 27 == 0, 3).when(k % 9 == 0, 2).otherwise(1)
    return v.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")
