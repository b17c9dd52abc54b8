"""Distributed ranks / medians equal their single-task definitions."""

import statistics

from hypothesis import example, given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom.operators import ordering
from creditloom.operators.ordering import exact_medians, global_row_index, rank_within_groups


def test_rank_within_groups_matches_window(spark):
    df = spark.range(0, 5000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("s"))
    # one hot group: two thirds of the rows in g = 0
    df = df.withColumn("g", F.when(F.col("id") % 3 == 2, F.lit(1)).otherwise(F.lit(0)))
    r = rank_within_groups(df, ["g"], [F.col("s").desc(), F.col("id")], "rk")
    w = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc(), "id")))
    assert r.join(w.select("id", "rk2"), "id").filter("rk <> rk2").count() == 0
    assert r.count() == 5000


def test_global_row_index(spark):
    df = spark.range(0, 777).select((F.col("id") * 13 % 777).alias("v"))
    idx = sorted((r.v, r.i) for r in global_row_index(df, [F.col("v")], "i").collect())
    assert [i for _, i in idx] == list(range(777))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60))
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v, v) for v in values], "a int, b int")
    got = exact_medians(df, ["a", "b"]).collect()[0]
    present = [v for v in values if v is not None]
    exp = statistics.median(present) if present else None
    assert got.a == exp and got.b == exp


@settings(max_examples=4, deadline=None)
@example([0.0, -1.0, float("inf"), -0.0, 7.0])
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9).map(float), st.floats(allow_nan=False, width=32)), min_size=1, max_size=40))
def test_exact_median_by_rounds_of_brackets(spark, values):
    df = spark.createDataFrame([(v, -v if v is not None else None) for v in values], "a double, b double")
    got = exact_medians(df, ["a", "b"], bracket_rows=4).collect()[0]
    present = [v for v in values if v is not None]
    both = (present, [-v for v in present])
    for x, exp in zip(got, [statistics.median(p) if p else None for p in both]):
        assert x == exp or str(x) == str(exp)


def test_exact_median_of_hot_values(spark):
    # two values hold two thirds of all rows, the rest lies between and around them
    df = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).when(F.col("id") % 3 == 1, F.lit(9.0))
                                     .otherwise((F.col("id") * 7919 % 1000).cast("double") / 50).alias("v"))
    expected = statistics.median(r.v for r in df.collect())
    for rows in (1, 50, 5000, 1_000_000):
        assert exact_medians(df, ["v"], bracket_rows=rows).first().v == expected


def test_exact_median_with_nan_and_infinities(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, nan, inf, None), (2.0, nan, -inf, None), (nan, 3.0, 4.0, None), (nan, nan, None, None)],
                               "a double, b double, c double, d double")
    for rows in (1, 100):
        r = exact_medians(df, ["a", "b", "c", "d"], bracket_rows=rows).first()
        assert str(r.a) == "nan" and str(r.b) == "nan" and r.c == 4.0 and r.d is None
    empty = exact_medians(df.limit(0), ["a", "d"]).collect()
    assert [tuple(r) for r in empty] == [(None, None)]


def test_exact_median_shuffles_no_column(spark, tmp_path):
    spark.range(0, 40000).select((F.col("id") * 7919 % 39989).cast("double").alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    # 40,000 different values; the rows put in order are those of the last bracket alone
    assert exact_medians(df, ["v"], bracket_rows=100).first().v == statistics.median(r.v for r in df.collect())


def test_running_count_matches_window(spark):
    from creditloom.operators.ordering import running_count_within_groups

    df = spark.range(0, 4000).select("id", F.when(F.col("id") % 5 == 0, "cold").otherwise("hot").alias("g"),
                                     ((F.col("id") * 31) % 7 == 0).cast("int").alias("flag"))
    r = running_count_within_groups(df, ["g"], [F.col("id")], "flag", "rc")
    w = df.withColumn("rc2", F.sum("flag").over(Window.partitionBy("g").orderBy("id")
                                                 .rowsBetween(Window.unboundedPreceding, 0)))
    assert r.join(w.select("id", "rc2"), "id").filter("rc <> rc2").count() == 0


def test_approx_median_close_to_exact(spark):
    from creditloom.operators.ordering import approx_medians

    df = spark.range(0, 10001).select((F.col("id") * 7 % 10001).cast("double").alias("v"))
    exact = exact_medians(df, ["v"]).first().v
    approx = approx_medians(df, ["v"]).first().v
    assert exact == 5000.0 and abs(approx - exact) <= 1.0


def test_rank_independent_of_slice_count(spark):
    df = spark.range(0, 3000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 17 % 97).alias("s"))
    order = [F.col("s").desc(), F.col("id")]
    a = {r.id: r.rk for r in rank_within_groups(df, ["g"], order, "rk", partitions=3).collect()}
    b = {r.id: r.rk for r in rank_within_groups(df, ["g"], order, "rk").collect()}
    assert a == b and len(a) == 3000


def test_both_middle_ranks_share_a_sketch(spark, monkeypatch):
    asked = []
    plain = ordering.F.percentile_approx
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda v, shares, accuracy: asked.append(len(shares)) or plain(v, shares, accuracy))
    df = spark.range(200).select((F.col("id") * 7 % 200).cast("double").alias("a"), (F.col("id") % 5 - 0.0).alias("b"), F.when(F.col("id") < 101, F.col("id") / 3).alias("c"))
    got = exact_medians(df, ["a", "b", "c"], bracket_rows=4).first()
    assert (got.a, got.b, got.c) == (99.5, 2.0, statistics.median(i / 3 for i in range(101)))
    assert asked[:3] == [4, 4, 2]  # the first round: one sketch a column
