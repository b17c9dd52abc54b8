"""Job entry points (what a scheduler submits with spark-submit).

    spark-submit -m creditloom.plans.jobs score --loans <path|sf_dir> --out <dir> [--feedback <csv>] [--mode rule|model|auto]
    spark-submit -m creditloom.plans.jobs refresh --scored <dir> --feedback <csv> --out <dir>

``--loans`` is a CSV/parquet/json/orc file (validated, NA tokens nulled) or a
folder of driver tables, from which the loan view is built.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import first_existing
from ..operators.quality import distinct_rows
from ..schema import ID_CANDIDATES
from ..session import cut_lineage, ensure_defaults
from ..sources import files
from ..sources.views import loan_view
from . import pipeline


def _loans(spark: SparkSession, source: str):
    if files.path_exists(spark, f"{source.rstrip('/')}/orders.parquet"):
        return loan_view(spark, source)
    return files.load_table(spark, source)


def identified(loans: DataFrame) -> DataFrame:
    """A book with an account id: its own, or ``ACC_<n>`` by position in the order of all
    columns. Copies go first, as they would differ in their ids afterwards."""
    if first_existing(loans.columns, ID_CANDIDATES) is not None:
        return loans
    return cut_lineage(files.assign_account_ids(distinct_rows(cut_lineage(loans))))


def score_job(spark: SparkSession, loans: str, out: str, feedback: str | None = None, mode: str = "rule",
              as_of: str | None = None) -> dict:
    as_of = as_of or dt.date.today().isoformat()
    fb = files.load_feedback(spark, feedback) if feedback else None
    result = pipeline.run(identified(_loans(spark, loans)), as_of, fb, mode=mode, materialize=True)
    written = pipeline.write_outputs(result, out)
    return {name: written[name] for name in ("scored_accounts", "top_risky_accounts", "daily_visit_plan", "officer_kpis")}


def refresh_job(spark: SparkSession, scored: str, feedback: str, out: str, as_of: str | None = None) -> dict:
    as_of = as_of or dt.date.today().isoformat()
    fb = files.load_feedback(spark, feedback)
    plan, kpis = pipeline.refresh_plan(spark.read.parquet(scored), fb, as_of)
    return {"visit_plan_rows": files.write_table(plan, f"{out}/daily_visit_plan", partition_by=["OfficerId"]),
            "officer_kpi_rows": files.write_table(kpis, f"{out}/officer_kpis"),
            "feedback_rows": fb.count()}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="creditloom")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("score")
    s.add_argument("--loans", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--feedback")
    s.add_argument("--mode", default="rule", choices=["rule", "model", "auto"])
    s.add_argument("--as-of")
    r = sub.add_parser("refresh")
    r.add_argument("--scored", required=True)
    r.add_argument("--feedback", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--as-of")
    args = ap.parse_args(argv)
    spark = ensure_defaults(SparkSession.builder.appName("creditloom").getOrCreate())
    if args.cmd == "score":
        print(score_job(spark, args.loans, args.out, args.feedback, args.mode, args.as_of))
    else:
        print(refresh_job(spark, args.scored, args.feedback, args.out, args.as_of))


if __name__ == "__main__":
    main()
