"""The catalogue of runnable queries, each with its SQL statement where SQL can express it."""

from creditlake.plans.catalogue import clean_queries, feature_queries, history_queries, model_queries, score_queries, scoring_queries, stat_queries  # noqa: F401
from creditlake.plans.catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
