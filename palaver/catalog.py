"""All queries of the conversation engine and their SQL, by name."""

from palaver.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
