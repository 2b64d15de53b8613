"""Query plans: name dispatch, the catalog of checked queries, their SQL."""

from postlens.plans.catalog import Models, queries
from postlens.plans.dispatch import ANALYSES, ANALYSIS_NAMES, chart, resolve, run, run_many
from postlens.plans.oracle import oracle_sql

__all__ = ["ANALYSES", "ANALYSIS_NAMES", "Models", "oracle_sql", "queries", "resolve", "run", "run_many", "chart"]
