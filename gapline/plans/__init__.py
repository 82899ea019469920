"""Query plans over the test tables, with their oracle SQL."""

from gapline.plans import evidence, learning, parsing, places, quality, queues, relations, scoring  # noqa: F401
from gapline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
