"""Whole-row distinct that moves only possible copies, and counts taken from writes."""

import math

from pyspark.sql import functions as F

from creditloom.operators import quality
from creditloom.session import cut_lineage
from creditloom.sources import files

SCHEMA = "k string, a double, b string"
ROWS = [("x", 1.0, None), ("x", None, "1"), ("x", 1.0, None), ("y", math.nan, "q"), ("y", math.nan, "q"), ("z", 0.0, ""), ("z", -0.0, ""), (None, None, None), (None, None, None), ("", None, None)]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_equals_plain_distinct_with_nulls_nan_and_zeros(spark):
    df = cut_lineage(spark.createDataFrame(ROWS * 3, SCHEMA).repartition(4))
    got = quality.distinct_rows(df)
    assert got.columns == df.columns and got.count() == df.dropDuplicates().count() == 6
    assert rows_of(got.where("a <> 0 or a is null")) == rows_of(df.dropDuplicates().where("a <> 0 or a is null"))


def test_equal_digests_of_different_rows_keep_both(spark, monkeypatch):
    monkeypatch.setattr(quality, "row_digest", lambda df: F.lit(7).cast("bigint"))
    df = cut_lineage(spark.createDataFrame(ROWS, SCHEMA))
    assert quality.distinct_rows(df).count() == 6


def test_beyond_the_bound_and_without_copies(spark):
    df = cut_lineage(spark.createDataFrame(ROWS, SCHEMA))
    assert quality.distinct_rows(df, max_digests=1).count() == 6
    single = cut_lineage(spark.range(50).select("id", F.col("id").cast("string").alias("t")))
    assert quality.distinct_rows(single) is single


def test_rows_without_a_copy_are_not_shuffled(spark):
    df = cut_lineage(spark.range(2000).select("id", F.lit("text").alias("t")).unionByName(spark.range(3).select("id", F.lit("text").alias("t"))))
    got = quality.distinct_rows(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 2000
    # the one exchange of whole rows is that of the possible copies, behind the semi join
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_one_row_with_most_copies(spark):
    df = cut_lineage(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id")))
    assert quality.distinct_rows(df).count() == 2001


def test_clean_drops_copies_before_the_medians(spark):
    df = spark.createDataFrame([("1", 1.0), ("1", 1.0), ("1", 1.0), ("2", 5.0), ("3", None), ("4", 9.0)], "AccountNo string, v double")
    assert sorted((r.AccountNo, r.v) for r in quality.clean(df).collect()) == [("1", 1.0), ("2", 5.0), ("3", 5.0), ("4", 9.0)]


def test_a_write_counts_its_rows(spark, tmp_path):
    df = spark.range(37).select("id", (F.col("id") % 3).alias("p"))
    assert files.write_table(df, str(tmp_path / "a")) == 37
    assert files.write_table(df, str(tmp_path / "b"), partition_by=["p"]) == 37
    assert files.write_table(df.limit(0), str(tmp_path / "c")) == 0
