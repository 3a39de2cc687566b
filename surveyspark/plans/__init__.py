"""Operators bound to the driver's test tables, each with its oracle SQL."""

from surveyspark.plans import q_bundle, q_core, q_eval, q_io, q_model, q_prep, q_profile, q_score  # noqa: F401
from surveyspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
