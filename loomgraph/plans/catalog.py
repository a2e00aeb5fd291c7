"""All queries of the engine: each module registers its own in base.py."""

from . import lookups, queries, scores, searches, upkeep  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
