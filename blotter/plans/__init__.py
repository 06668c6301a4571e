"""Query catalogue over the driver's test tables (keys of SURVEY §7.3)."""

from blotter.plans import catalogue_explore, catalogue_ml, catalogue_quality  # noqa: F401  (register on import)
from blotter.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
