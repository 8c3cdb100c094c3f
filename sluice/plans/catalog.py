"""Imports every family so that its queries are registered."""

from sluice.plans import (  # noqa: F401
    align_queries, audit_queries, decision_queries, file_queries, fit_queries, forecast_queries, learner_queries, panel_queries, quality_queries,
    readiness_queries, report_queries, series_queries, source_queries, stream_queries, trial_queries)
from sluice.plans.registry import ORACLES, QUERIES  # noqa: F401
