"""All named queries."""

from newsflow.plans import crawling, models, prep, scoring, tokens  # noqa: F401
from newsflow.plans.registry import QUERIES

__all__ = ["QUERIES"]
