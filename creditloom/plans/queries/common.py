"""Registry and the inputs shared by the query families."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession

from .. import oracle as O
from ...operators import collections_plan as cp
from ...operators.features import engineer
from ...operators.quality import clean
from ...operators.scoring import regular_accounts, rule_score
from ...sources import views as V


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PLAN_DATE = "2024-01-31"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def loans(spark, d):
    return V.loan_view(spark, d)


def cleaned(spark, d, stored=False):
    """The account number is the loan view's key. ``stored`` writes the book
    once, for plans that read it many times."""
    return clean(loans(spark, d), materialize=stored, unique_key="AccountNo")


def featured(spark, d, stored=False):
    return engineer(cleaned(spark, d, stored), few_sectors=True)


def scored(spark, d, stored=False):
    return rule_score(featured(spark, d, stored))


def std_scored(spark, d, stored=False):
    return regular_accounts(scored(spark, d, stored))


PLAN_CHAIN = O.LOAN_CHAIN + [O.PLAN]
NOW_TS = "2024-01-31T00:00:00Z"


def plan_rule(spark, d):
    return cp.visit_plan(std_scored(spark, d, stored=True), PLAN_DATE)


def feedback_raw(spark, d):
    return V.feedback_view(spark, d)


def plan_with_feedback(spark, d):
    return cp.visit_plan(std_scored(spark, d, stored=True), PLAN_DATE, feedback_raw(spark, d))


AS_OF = V.AS_OF
A = f"timestamp '{AS_OF}'"
J = [O.JOB]


def jobs(spark, d):
    return V.job_view(spark, d)


R = [O.REQUEST]


def requests(spark, d):
    return V.request_view(spark, d)


def applicants(spark, d):
    return V.applicant_view(spark, d)
