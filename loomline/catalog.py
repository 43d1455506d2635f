"""All queries of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from loomline.plans import conversations, documents, evidence, insights, metrics, questions, relational, retrieval, streams
from loomline.registry import ORACLES, QUERIES

FLAGSHIP = "h10_weighted_hybrid"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
assert all((conversations, documents, evidence, insights, metrics, questions, relational, retrieval, streams))
