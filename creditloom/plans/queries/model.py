"""Queries: model frame, split, metrics and model-based outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ...operators.scoring import top_by
from ...operators import ml
from ...schema import MODEL_CATEGORICAL, MODEL_NUMERIC
from .. import pipeline
from .common import PLAN_DATE, feedback_raw, loans, register, scored


_MODEL_COLS = ", ".join(["AccountNo", "WillDefault"] + [f"cast({c} AS double) AS {c}" for c in MODEL_NUMERIC]
                       + MODEL_CATEGORICAL)


_MODEL_FRAME = f"model_frame AS (SELECT {_MODEL_COLS} FROM scored WHERE WillDefault IS NOT NULL)"


_DRAW = ("(cast(('0x' || substr(md5(concat_ws('|', cast(AccountNo AS varchar), cast(WillDefault AS varchar), '42')), 1, 8))"
         " AS BIGINT) % 1000000) / cast(1000000 AS double)")


_SPLIT = (f"split_frame AS (SELECT * EXCLUDE (nth, n), CASE WHEN nth <= floor(n * cast(0.3 AS double) + 0.5) THEN 'test' ELSE 'train' END AS split FROM ("
          f"SELECT *, row_number() OVER (PARTITION BY WillDefault ORDER BY {_DRAW}, AccountNo) AS nth, count(*) OVER (PARTITION BY WillDefault) AS n "
          "FROM model_frame))")


@register("model_features", O.with_ctes(O.LOAN_CHAIN + [_MODEL_FRAME], "SELECT * FROM model_frame"))
def q_model_features(spark, d):
    return ml.model_frame(scored(spark, d)).select("AccountNo", ml.LABEL, *ml.MODEL_NUMERIC, *ml.MODEL_CATEGORICAL)


@register(
    "model_split",
    O.with_ctes(
        O.LOAN_CHAIN + [_MODEL_FRAME, _SPLIT],
        "SELECT WillDefault, split, count(*) AS rows FROM split_frame GROUP BY 1, 2",
    ),
)
def q_model_split(spark, d):
    split = ml.stratified_split(ml.model_frame(scored(spark, d)))
    return split.groupBy(ml.LABEL, "split").agg(F.count(F.lit(1)).alias("rows"))


_MODEL_CTES = O.LOAN_CHAIN + [_MODEL_FRAME, _SPLIT] + O.model_ctes(MODEL_NUMERIC, MODEL_CATEGORICAL)


def _sql(body: str, more: list[str] | None = None) -> str:
    return O.with_ctes(_MODEL_CTES + (more or []), body).replace("WITH", "WITH RECURSIVE", 1)


_METRICS = """
SELECT (SELECT avg(CASE WHEN (p > 0.5) = (y = 1) THEN cast(1 AS double) ELSE cast(0 AS double) END) FROM held_scored) AS accuracy,
       (SELECT coalesce(count(*) FILTER (WHERE p > 0.5 AND y = 1) / nullif(cast(count(*) FILTER (WHERE p > 0.5) AS double), 0), 0) FROM held_scored) AS precision,
       (SELECT coalesce(count(*) FILTER (WHERE p > 0.5 AND y = 1) / nullif(cast(count(*) FILTER (WHERE y = 1) AS double), 0), 0) FROM held_scored) AS recall,
       (SELECT cast(sum(n1 * (2 * upto - n0)) AS double) / (cast(sum(n1) AS double) * cast(sum(n0) AS double) * cast(2 AS double)) FROM (
          SELECT n1, n0, sum(n0) OVER (ORDER BY p) AS upto FROM (
            SELECT p, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM held_scored GROUP BY p))) AS roc_auc"""


@register("model_metrics", _sql(_METRICS))
def q_model_metrics(spark, d):
    model, test_df = ml.train(scored(spark, d, stored=True))
    return ml.metrics(model, test_df)


_SCORED_MODEL = "SELECT AccountNo, RuleScore, RuleRiskCategory, PredDefaultProbability, ModelRiskCategory FROM std_model"


@register("scored_model", _sql(_SCORED_MODEL))
def q_scored_model(spark, d):
    book = scored(spark, d, stored=True)
    model, _ = ml.train(book)
    return ml.score_regular(book, model).select(
        "AccountNo", "RuleScore", "RuleRiskCategory", "PredDefaultProbability", "ModelRiskCategory"
    )


@register("top_risky_model", _sql(_SCORED_MODEL + " ORDER BY PredDefaultProbability DESC, AccountNo LIMIT 100"))
def q_top_risky_model(spark, d):
    return top_by(q_scored_model(spark, d), "PredDefaultProbability", 100)


# the default path: score with the model before planning
def plan_model(spark, d):
    out = pipeline.run(loans(spark, d), PLAN_DATE, feedback_raw(spark, d), mode="model")
    return out.visit_plan, out.officer_kpis


_PLAN_MODEL = [O.PLAN_MODEL, O.FEEDBACK, O.LATEST, O.PLAN_FB]
register("visit_plan_model", _sql("SELECT * FROM plan_fb", _PLAN_MODEL))(lambda spark, d: plan_model(spark, d)[0])
register("officer_kpis_model", _sql(O.kpis("plan_fb"), _PLAN_MODEL))(lambda spark, d: plan_model(spark, d)[1])
