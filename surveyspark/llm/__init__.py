"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

from surveyspark.llm import queries  # noqa: F401
from surveyspark.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
