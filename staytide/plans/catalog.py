"""All registered queries; importing a module of queries registers them."""

from staytide.plans import basics, cohorts, modelling, relations  # noqa: F401
from staytide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
