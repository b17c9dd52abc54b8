"""The classifier against plain numpy: preprocessing, the minimum, AUC and the split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import logit, ml

COLUMNS = "id long, a double, b double, c double, kind string, y int"


def sample(n=600, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.gauss(0, 1), rnd.gauss(5, 2)
        kind = rnd.choice(["x", "x", "x", "y", "z"])
        y = int(rnd.random() < 1 / (1 + np.exp(-(1.2 * a - 0.4 * (b - 5) + (kind == "y")))))
        rows.append((i, None if i % 11 == 0 else a, None if i % 13 == 0 else b, 7.0, None if i % 17 == 0 else kind, y))
    return rows


def features(rows, train):
    """By the rules: median, mean 0 and population deviation 1, most frequent value, one column a level."""
    cols = []
    for j in (1, 2, 3):
        known = [r[j] for r in train if r[j] is not None]
        fill = [np.median(known) if r[j] is None else r[j] for r in train]
        mean, dev = np.mean(fill), np.std(fill) or 1.0
        cols.append([((np.median(known) if r[j] is None else r[j]) - mean) / dev for r in rows])
    names = sorted({r[4] for r in train if r[4] is not None})
    mode = max(names, key=lambda v: sum(r[4] == v for r in train))
    return np.array(cols + [[float((mode if r[4] is None else r[4]) == v) for r in rows] for v in names] + [[1.0] * len(rows)]).T


@pytest.fixture(scope="module")
def fitted(spark):
    rows = sample()
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    return rows, df, logit.fit(df, "y", ["a", "b", "c"], ["kind"])


def test_the_gradient_at_the_coefficients_is_zero(fitted):
    rows, _, model = fitted
    x, y = features(rows, rows), np.array([r[5] for r in rows], float)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta = np.array([*model.coefficients, model.intercept])
    p = 1 / (1 + np.exp(-x @ beta))
    gradient = x.T @ (s * (p - y)) + np.array([*model.coefficients, 0.0])
    assert np.abs(gradient).max() < 1e-9 and model.gradient < 1e-9
    assert model.pre.modes == ["x"] and model.pre.levels == [["x", "y", "z"]] and model.pre.scales[2] == 1.0


def test_scores_follow_the_features_also_of_gaps_and_unseen_levels(spark, fitted):
    rows, _, model = fitted
    new = [(1, None, 4.0, 7.0, None, 0), (2, 3.0, None, None, "never seen", 1), (3, -50.0, 5.0, 7.0, "z", 0)]
    got = {r.id: r.PredDefaultProbability for r in model.transform(spark.createDataFrame(new, COLUMNS)).collect()}
    p = 1 / (1 + np.exp(-features(new, rows) @ np.array([*model.coefficients, model.intercept])))
    assert [got[i] for i in (1, 2, 3)] == pytest.approx(p.tolist(), abs=5.1e-7)


def test_partitions_do_not_change_the_scores(fitted):
    _, df, model = fitted
    other = logit.fit(df.coalesce(1), "y", ["a", "b", "c"], ["kind"])
    one, two = ([tuple(r) for r in m.transform(df).select("id", "PredDefaultProbability").orderBy("id").collect()] for m in (model, other))
    assert one == two


def test_one_class_and_too_many_levels_are_errors(spark):
    one = spark.createDataFrame([(1, 1.0, 1.0, 1.0, "x", 1)], COLUMNS)
    with pytest.raises(ValueError, match="two classes"):
        logit.fit(one, "y", ["a"], ["kind"])
    many = spark.range(logit.MAX_LEVELS + 1).select(F.col("id").cast("string").alias("kind"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("a"))
    with pytest.raises(ValueError, match="no category"):
        logit.fit(many, "y", ["a"], ["kind"])


def test_a_column_without_values_is_left_at_zero(spark):
    df = spark.createDataFrame([(i, None, float(i), 1.0, None, i % 2) for i in range(20)], COLUMNS)
    model = logit.fit(df, "y", ["a", "b"], ["kind"])
    assert model.pre.levels == [[]] and len(model.coefficients) == 2
    assert all(0 < r.PredDefaultProbability < 1 for r in model.transform(df).collect())


def test_auc_counts_ties_half(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 6) / 6, int(rnd.random() < 0.4)) for _ in range(300)]
    pairs = [(1.0 if p > q else 0.5 if p == q else 0.0) for p, y in rows if y for q, z in rows if not z]
    got = ml.auc(spark.createDataFrame(rows, "p double, y int"), "p", "y").first()[0]
    assert got == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)
    assert ml.auc(spark.createDataFrame([(0.5, 1)], "p double, y int"), "p", "y").first()[0] is None


def test_the_split_takes_the_exact_share_of_each_class(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1000)], "AccountNo long, WillDefault int")
    got = {(r.WillDefault, r.split): r["count"] for r in ml.stratified_split(df).groupBy("WillDefault", "split").count().collect()}
    ones = len(range(0, 1000, 7))
    assert got == {(1, "test"): round(ones * 0.3), (1, "train"): ones - round(ones * 0.3), (0, "test"): int((1000 - ones) * 0.3 + 0.5), (0, "train"): 1000 - ones - int((1000 - ones) * 0.3 + 0.5)}
    again = ml.stratified_split(df.repartition(7))
    assert ml.stratified_split(df).exceptAll(again).count() == 0
