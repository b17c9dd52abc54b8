"""End-to-end jobs: batch scoring (E1) and feedback refresh (E2).

Each function returns lazy DataFrames; writers are separate so the caller
decides where results land. The scored table is the one intermediate used
by several outputs; ``materialize=True`` writes it once into the shared
checkpoint folder (reliable, survives executor loss) instead of
recomputing it per output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import collections_plan as cp
from ..operators.features import engineer
from ..operators.quality import clean, validate_columns
from ..operators.scoring import regular_accounts, rule_score, top_by
from ..schema import REQUIRED_COLUMNS
from ..session import cut_lineage
from ..sources.files import write_table


def score_rules(loans: DataFrame, approx_medians: bool = False) -> DataFrame:
    validate_columns(loans, REQUIRED_COLUMNS)
    return rule_score(engineer(clean(loans, approx=approx_medians)))


@dataclass
class PipelineOutputs:
    processed: DataFrame
    scored: DataFrame
    top_risky: DataFrame
    visit_plan: DataFrame
    officer_kpis: DataFrame
    metrics: DataFrame | None = None


def run(
    loans: DataFrame,
    as_of_date: str,
    feedback: DataFrame | None = None,
    mode: str = "rule",
    materialize: bool = False,
    top_n: int = 100,
) -> PipelineOutputs:
    """Batch scoring. ``mode``: 'rule', 'model' or 'auto' (model when future
    status labels exist and have two classes; the check is a one-row
    aggregate)."""
    processed = score_rules(loans)
    if materialize:
        processed = cut_lineage(processed)
    metrics = None
    if mode == "auto":
        from ..operators.ml import label_classes

        # labels from current status (no FutureStatusCode) are not a real target
        has_future = "FutureStatusCode" in loans.columns
        mode = "model" if has_future and label_classes(processed) >= 2 else "rule"
    if mode == "model":
        from ..operators.ml import score_model

        # the fit and the scoring read the book, and the list, the plan and the KPIs the scores
        processed = processed if materialize else cut_lineage(processed)
        scored, metrics = score_model(processed)
        scored = cut_lineage(scored)
        top = top_by(scored, "PredDefaultProbability", top_n)
    else:
        scored = regular_accounts(processed)
        top = top_by(scored, "RuleScore", top_n)
    plan = cp.visit_plan(scored, as_of_date, feedback)
    kpis = cp.officer_kpis(plan)
    return PipelineOutputs(processed, scored, top, plan, kpis, metrics)


def refresh_plan(scored: DataFrame, feedback: DataFrame, as_of_date: str) -> tuple[DataFrame, DataFrame]:
    """E2: rebuild the plan and KPIs from stored scores and the feedback log."""
    plan = cp.visit_plan(scored, as_of_date, feedback)
    return plan, cp.officer_kpis(plan)


def write_outputs(out: PipelineOutputs, base: str) -> dict[str, int]:
    """Write every output; the rows of each, counted by the writes."""
    rows = {
        "loan_accounts_processed": write_table(out.processed, f"{base}/loan_accounts_processed"),
        "scored_accounts": write_table(out.scored, f"{base}/scored_accounts"),
        "top_risky_accounts": write_table(out.top_risky, f"{base}/top_risky_accounts"),
        "daily_visit_plan": write_table(out.visit_plan, f"{base}/daily_visit_plan", partition_by=["OfficerId"]),
    }
    # KPIs are sums over the plan: read it back instead of planning again
    plan = out.visit_plan.sparkSession.read.schema(out.visit_plan.schema).parquet(f"{base}/daily_visit_plan").select(*out.visit_plan.columns)
    rows["officer_kpis"] = write_table(cp.officer_kpis(plan), f"{base}/officer_kpis")
    if out.metrics is not None:
        out.metrics.coalesce(1).write.mode("overwrite").json(f"{base}/model_metrics")
    return rows
