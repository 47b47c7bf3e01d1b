"""All registered queries of the record-linkage operators, and their SQL."""

from __future__ import annotations

from erspark.plans import queries_io, queries_more  # noqa: F401
from erspark.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
