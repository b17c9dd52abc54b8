"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

The queries live in ``plans/queries/`` by family; importing that package
registers them. Every query reads the driver tables (through the domain
views) whole.
"""

from __future__ import annotations

from .queries import ORACLE, QUERIES  # noqa: F401
from .queries.common import (  # noqa: F401
    cleaned,
    featured,
    feedback_raw,
    loans,
    plan_rule,
    scored,
    std_scored,
)
