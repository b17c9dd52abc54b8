"""Default-risk model: features, stratified split, fit (``logit``), metrics and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if
from ..session import cut_lineage
from ..schema import HIGH, LOW, MEDIUM, MODEL_CATEGORICAL, MODEL_NUMERIC
from . import logit
from .logit import LogitModel
from .ordering import rank_within_groups, running_count_within_groups
from .scoring import id_column, regular_accounts

LABEL = "WillDefault"
SEED = 42
TEST_FRACTION = 0.3


def check_features(df: DataFrame) -> None:
    missing = [c for c in MODEL_NUMERIC + MODEL_CATEGORICAL if c not in df.columns]
    if missing:
        raise ValueError(f"Missing feature columns for training: {missing}")


def label_classes(df: DataFrame) -> int:
    return int(df.agg(F.countDistinct(F.col(LABEL)).alias("n")).first()["n"])


def model_frame(df: DataFrame) -> DataFrame:
    """Labelled rows with the feature columns (numeric as double)."""
    check_features(df)
    out = df.dropna(subset=[LABEL]).withColumn(LABEL, F.col(LABEL).cast("int"))
    for c in MODEL_NUMERIC:
        out = out.withColumn(c, F.col(c).cast("double"))
    return out


def split_draw(key: F.Column, label: F.Column, seed: int = SEED) -> F.Column:
    """A uniform draw in [0, 1) from the seeded digest of (id, label): the
    first 32 bits of md5('<id>|<label>|<seed>') modulo 10^6, over 10^6."""
    text = F.concat_ws("|", key.cast("string"), label.cast("string"), F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (bits % F.lit(1_000_000)).cast("double") / F.lit(1e6)


def stratified_split(df: DataFrame, test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Deterministic stratified split: of each class, exactly the rounded share of
    ``test_fraction`` goes to test, the rows with the smallest seeded draws (of equal draws
    the smaller id).

    Ranks come from range slices, so a class with most of the rows is not
    sorted in one task; the class counts have one row a label.
    """
    key = id_column(df)
    drawn = df.withColumn("_draw", split_draw(F.col(key), F.col(LABEL), seed))
    ranked = rank_within_groups(drawn, [LABEL], [F.col("_draw"), F.col(key)], "_nth")
    counts = df.groupBy(F.col(LABEL).alias("_label")).agg(F.floor(F.count(F.lit(1)) * F.lit(test_fraction) + F.lit(0.5)).alias("_tests"))
    split = ranked.join(F.broadcast(counts), F.col(LABEL) == F.col("_label"))
    return split.withColumn("split", F.when(F.col("_nth") <= F.col("_tests"), "test").otherwise("train")).drop("_draw", "_nth", "_label", "_tests")


def train(df: DataFrame) -> tuple[LogitModel, DataFrame]:
    """Fit on the 70 % split; return the model and the held-out rows."""
    keep = [id_column(df), LABEL, *MODEL_NUMERIC, *MODEL_CATEGORICAL]
    # one reliable materialisation: statistics and every pass of the fit read
    # it instead of recomputing the scoring lineage; the split ranks and stores the model's columns alone
    frame = cut_lineage(stratified_split(model_frame(df).select(*keep)))
    model = logit.fit(frame.where(F.col("split") == "train"), LABEL, MODEL_NUMERIC, MODEL_CATEGORICAL)
    return model, frame.where(F.col("split") == "test")


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve (one row): the share of (1, 0) pairs in the right
    order, ties counting half. Rows are counted by score first; the counts of 0s
    below each score are running sums over range slices, so no task sees all scores."""
    counts = scored.groupBy(F.col(score).alias("p")).agg(count_if(F.col(label) == 1).alias("n1"), count_if(F.col(label) == 0).alias("n0"))
    below = running_count_within_groups(counts, [], [F.col("p")], "n0", "upto")
    pairs = F.sum(F.col("n1") * (2 * F.col("upto") - F.col("n0"))).cast("double")
    all_ = F.sum("n1").cast("double") * F.sum("n0").cast("double") * 2.0
    return below.agg((pairs / F.nullif(all_, F.lit(0.0))).alias("roc_auc"))


def metrics(model: LogitModel, test_df: DataFrame) -> DataFrame:
    """accuracy, precision, recall (0 if undefined), ROC AUC on the held-out rows (one row)."""
    pred = cut_lineage(model.transform(test_df, "p").select("p", LABEL))
    said, true = F.col("p") > 0.5, F.col(LABEL) == 1
    agg = pred.agg(
        F.avg(F.when(said == true, 1.0).otherwise(0.0)).alias("accuracy"),
        count_if(said & true).alias("tp"), count_if(said).alias("pp"), count_if(true).alias("ap"),
    )
    return agg.select(
        "accuracy",
        F.coalesce(F.col("tp") / F.when(F.col("pp") > 0, F.col("pp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.when(F.col("ap") > 0, F.col("ap")), F.lit(0.0)).alias("recall"),
        auc(pred, "p", LABEL).scalar().alias("roc_auc"),
    )


def model_band(p) -> F.Column:
    return F.when((p > -0.01) & (p <= 0.4), LOW).when((p > 0.4) & (p <= 0.7), MEDIUM).when((p > 0.7) & (p <= 1.0), HIGH)


def score_regular(scored: DataFrame, model: LogitModel) -> DataFrame:
    """Class-1 probability and model band for the regular (STD) accounts."""
    pred = model.transform(regular_accounts(scored))
    return pred.withColumn("ModelRiskCategory", model_band(F.col("PredDefaultProbability")))


def score_model(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    model, test_df = train(processed)
    return score_regular(processed, model), metrics(model, test_df)
