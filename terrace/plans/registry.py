"""All registered queries and their SQL."""

from terrace.plans import areas, catalogue, catalogue_reads, changes, entities, imports, matching, names, places, reads, sync, texts, trees  # noqa: F401  they register their queries
from terrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
