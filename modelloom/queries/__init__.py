"""Named queries over the benchmark tables, each with its SQL counterpart."""

from modelloom.queries import encoding, learning, preparing, profiling, scoring, splitting  # noqa: F401
from modelloom.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
