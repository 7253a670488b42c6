"""All registered queries; importing this package fills the registry."""

from millrace.plans import aggregates, boosting, boxes, features, learning, ordered, relational, scalars, storage, streams  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
