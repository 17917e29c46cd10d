"""All registered queries: importing the modules registers them."""

from corvid.plans import queries, workflows
from corvid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries", "workflows"]
