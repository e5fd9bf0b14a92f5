"""All queries of the library by name, each with SQL for the same rows where SQL can say it."""

from minuteloom.plans import admin, crawl, entities, forms, governance, merges, metrics, portal, store
from minuteloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "admin", "crawl", "entities", "forms", "governance", "merges", "metrics", "portal", "store"]
