"""All queries of the library; importing a module registers its queries."""

from netweft.plans import annotation, clusters, expression, formats, growth, mining, network, ontology, scoring, strings  # noqa: F401
from netweft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
