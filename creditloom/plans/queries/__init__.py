"""Query families; importing the package registers every query."""

from . import (  # noqa: F401
    loans,
    collections,
    portfolio,
    job_log,
    alerts,
    requests,
    applicants,
    model,
)

from .common import ORACLE, QUERIES  # noqa: F401
